"""Quality by co-training two views of a document: its text, and its metadata.

Each view has a logistic model of its own. In every round a view labels all unlabelled documents and hands the labels that it is
sure of to the other view, which trains on them beside the true labels. Then each view is calibrated on held-out
labels, and the calibrated views are combined to score all documents. Only the labelled documents are a bounded sample, held by
the driver; the unlabelled ones stay where they are, and each step of the descent adds up their losses and gradients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, flat_binary, partitions, pieces_of, tidy
from tidewater.llm.linear import BITS, STATS, Descent, Rows, Vocabulary, featurise, fit_logistic, sigmoid, unpacked
from tidewater.llm.linear import features as features_of

#: Views: text, metadata. Sums of the tasks are added up in pieces of so many numbers.
VIEWS, PIECE = 2, 8192


def metadata(columns: list[str], docs: DataFrame, size_col: str | None) -> Column:
    """Hashed features of the metadata: each column's value, each pair of columns, and the size's power of two."""
    has = [c for c in columns if c in docs.columns]
    hashed = lambda name, *c: F.pmod(F.xxhash64(F.lit(name), *c), F.lit(1 << BITS)).cast("int")
    parts = [hashed(c, F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in has]
    parts += [hashed(f"{a}*{b}", a, b) for i, a in enumerate(has) for b in has[i + 1 :]]
    if size_col and size_col in docs.columns:
        parts.append(hashed(size_col, F.floor(F.log2(F.greatest(F.coalesce(F.col(size_col).cast("double"), F.lit(0.0)), F.lit(1.0))))))
    return F.array(*parts) if parts else F.array().cast("array<int>")


@dataclass
class View:
    words: Vocabulary
    weights: np.ndarray
    scale: np.ndarray  # of the calibration: slope and intercept


@dataclass
class Judge:
    content: View
    meta: View
    combined: np.ndarray
    held_out: float  # the share of held-out labels that the combined views get right
    used: list  # per round and view: how many unlabelled documents it was fitted on

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        """Of rows (id, content, stats, meta), see compact()."""
        n = batch.num_rows
        stats = flat_binary(batch.column(2))[0].view(np.float64).reshape(n, len(STATS))
        c = self.content.words.logits(*rows_of(batch.column(1), n), stats, self.content.weights)
        m = self.meta.words.logits(*rows_of(batch.column(3), n), np.zeros((n, 0)), self.meta.weights)
        return self.combine(c, m)

    def combine(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        views = np.stack([plain(x[:, None]).times(v.scale) for x, v in ((c, self.content), (m, self.meta))], 1)
        return np.stack([*sigmoid(views).T, sigmoid(plain(views).times(self.combined))], 1)


def plain(x: np.ndarray) -> Rows:
    """Dense columns alone."""
    return Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, x)


def rows_of(columns: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of a batch's binary lists of int16."""
    flat, at = flat_binary(columns)
    return np.repeat(np.arange(n, dtype=np.int32), np.diff(at) // 2), flat.view(np.int16)


def compact(docs: DataFrame, id_col: str, text_col: str, meta: Column, words: Vocabulary, names: Vocabulary) -> DataFrame:
    """(id, content, stats, meta) of all documents: the columns of the views' models that a document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1):
            n = batch.num_rows
            docs, ids, stats = features_of(batch.column(1))
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            who = np.repeat(np.arange(n), np.diff(batch.column(2).offsets.to_numpy()))
            lists = []
            for rows, columns in (words.hits(docs, ids), names.hits(who, flat)):
                cuts = np.searchsorted(rows, np.arange(n + 1))
                columns = columns.astype(np.int16)
                lists.append(pa.array([columns[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists[0], pa.array([x.tobytes() for x in stats], pa.binary()), lists[1]], ["id", "content", "stats", "meta"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col), meta.alias("meta")).mapInArrow(run, f"id {kind}, content binary, stats binary, meta binary")


class Far:
    """All unlabelled documents, as compact() has them."""

    def __init__(self, rows: DataFrame, words: Vocabulary, names: Vocabulary, sure: float):
        self.rows, self.vocabularies, self.sure = rows.select("content", "stats", "meta"), (words, names), sure

    def sums(self, teachers: list[np.ndarray], weights: list[np.ndarray], active: list[bool]) -> list[tuple[int, float, np.ndarray, np.ndarray]]:
        """Per view: documents, log loss, gradient and the Hessian's diagonal over those that the other view's teacher is sure of."""
        vocabularies, sure = self.vocabularies, self.sure
        sizes = [len(w) for w in weights]
        ends = np.cumsum([2 + 2 * m for m in sizes])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(ends[-1])
            for whole in batches:
                for start in range(0, whole.num_rows, 4096):
                    batch = whole.slice(start, 4096)
                    n = batch.num_rows
                    stats = [flat_binary(batch.column(1))[0].view(np.float64).reshape(n, len(STATS)), np.zeros((n, 0))]
                    views = [Rows(*rows_of(batch.column(c), n), v.size, x) for c, v, x in zip((0, 2), vocabularies, stats, strict=True)]
                    judged = [sigmoid(x.times(t)) for x, t in zip(views, teachers, strict=True)]
                    for v in range(VIEWS):
                        p = judged[1 - v]
                        some = np.flatnonzero((p >= sure) | (p <= 1 - sure))
                        if not active[v] or not len(some):
                            continue
                        m, at = sizes[v], ends[v] - (2 + 2 * sizes[v])
                        loss, grad, curve = views[v].take(some).loss(weights[v], (p[some] > 0.5).astype(float))
                        total[at : at + 2] += len(some), loss
                        total[at + 2 : at + 2 + m] += grad
                        total[at + 2 + m : ends[v]] += curve
            pieces = range(0, len(total), PIECE)
            yield pa.RecordBatch.from_arrays([pa.array([i // PIECE for i in pieces], pa.int32()), pa.array([total[i : i + PIECE].tobytes() for i in pieces], pa.binary())], ["piece", "sums"])
            tidy()

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found[i] = found.get(i, 0) + np.frombuffer(x, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["piece", "sums"])

        kind = "piece int, sums binary"
        total = np.zeros(ends[-1])
        for r in self.rows.mapInArrow(run, kind).repartition(6, "piece").mapInArrow(add_up, kind).collect():  # four vectors, whatever the input
            total[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.sums, np.float64)
        parts = [total[e - (2 + 2 * m) : e] for e, m in zip(ends, sizes, strict=True)]
        return [(int(x[0]), float(x[1]), x[2 : 2 + m], x[2 + m :]) for x, m in zip(parts, sizes, strict=True)]


def fit_far(xs: list[Rows], y: np.ndarray, far: Far, before: list[np.ndarray], l2: float = 0.3, steps: int = 60, tolerance: float = 1e-5) -> tuple[list[np.ndarray], list[int]]:
    """fit_logistic for both views, on the labelled rows here and the documents of far that the other view, with its weights
    before, is sure of. Also how many documents those were."""
    found, used = [Descent(w, l2, tolerance=tolerance) for w in before], [0] * VIEWS
    for _ in range(steps):
        active = [not d.done for d in found]
        if not any(active):
            break
        sums = far.sums(before, [d.w for d in found], active)
        for v, x in enumerate(xs):
            if active[v]:
                own = x.loss(found[v].w, y)
                used[v] = sums[v][0]
                found[v].tell(*(a + b for a, b in zip(own, sums[v][1:], strict=True)))
    return [d.w if d.done else d.base for d in found], used


def co_train(xs: list[Rows], y: np.ndarray, held: np.ndarray, vocabularies: tuple[Vocabulary, Vocabulary], far: Far, rounds: int = 3) -> Judge:
    """y: 1 or 0 of the labelled rows xs. Those that are held out are for calibration."""
    fit = np.setdiff1d(np.arange(len(y)), held)
    own, known = [x.take(fit) for x in xs], y[fit].astype(float)
    weights = [fit_logistic(x, known) for x in own]
    used = []
    for _ in range(rounds):
        weights, n = fit_far(own, known, far, weights)
        used.append(n)
    out = [x.take(held).times(w) for x, w in zip(xs, weights, strict=True)]
    known = y[held].astype(float)
    scales = [fit_logistic(plain(o[:, None]), known, 0.1) for o in out]
    views = np.stack([plain(o[:, None]).times(s) for o, s in zip(out, scales, strict=True)], 1)
    combined = fit_logistic(plain(views), known, 0.1)
    right = float(((plain(views).times(combined) > 0) == (known == 1)).mean()) if len(held) else 0.0
    return Judge(*(View(v, w, s) for v, w, s in zip(vocabularies, weights, scales, strict=True)), combined, right, used)


def train(docs: DataFrame, labels: DataFrame, meta: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 8000, features: int = 1500) -> tuple[Judge, DataFrame] | None:
    """Fits on at most `most` labelled documents that are among docs, those of least hash, with at most so many features a view, and on
    all documents without a label. Also compact() of all documents. None with fewer than ten labels of either kind.

    A null label is no label; of several labels of one id the largest counts; of several rows with one id the one of least hash.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    # Labels of documents that aren't there don't count against the bound.
    there = docs.select(F.col(id_col).alias("id")).join(known, "id").distinct()
    some = there.orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(most)  # the bound of the broadcast
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), meta.alias("meta")).join(F.broadcast(some), "id")
    rows = rows.groupBy("id").agg(F.min_by(F.struct("text", "meta", "y"), F.xxhash64("text", "meta")).alias("r")).select("r.text", "id", "r.meta", "r.y")
    sample = rows.mapInArrow(lambda b: featurise(pieces_of(b, 0)), f"id {rows.schema['id'].dataType.simpleString()}, meta array<int>, y int, ids binary, stats binary").toArrow().sort_by("id")
    y = sample["y"].to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < 10:
        return None
    lists, stats = unpacked(sample["ids"], np.int32), np.array(unpacked(sample["stats"], np.float64))
    own = [np.unique(np.array(m, np.int32)) for m in sample["meta"].to_pylist()]
    held = np.arange(len(y))[::5]
    fit = np.setdiff1d(np.arange(len(y)), held)
    words = Vocabulary.choose([lists[i] for i in fit], [y[fit] == 1], features)
    names = Vocabulary.choose([own[i] for i in fit], [y[fit] == 1], features, least=5)
    scratch = Scratch(docs.sparkSession, "quality")
    every = scratch.put(compact(docs, id_col, text_col, meta, words, names), "compact")
    free = every.join(known.select("id"), "id", "left_anti").select("content", "stats", "meta")
    # Every step of the descent reads this table: it has a file for each 20,000 documents, not one for each of many small tasks.
    files = max(1, -(-every.count() // 20_000))
    free = scratch.put(free.coalesce(files) if files < partitions(docs.sparkSession) else free, "unlabelled")
    xs = [words.rows(lists, stats), names.rows(own, np.zeros((len(own), 0)))]
    del sample, lists
    tidy()
    return co_train(xs, y, held, (words, names), Far(free, words, names, 0.95)), every


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"), size_col: str | None = "n_chars", least: float = 0.5, most: int = 8000, features: int = 1500) -> DataFrame:
    """(id, p_content, p_metadata, quality, kept) per row; kept if the combined quality is at least `least`.

    Null texts count as empty, null metadata is a value of its own, metadata columns that are missing are left out. With fewer
    than ten labels of either kind nothing is learnt: all scores are 0.5 and all rows are kept. Null ids are scored like others, and count as
    unlabelled. Long texts are read whole. Equal rows get equal scores, so ties are kept or go together; an
    empty table gives none; other columns are not read. See train() for the bounds of the fit.
    """
    meta = metadata(list(meta_cols), docs, size_col)
    found = train(docs, labels, meta, id_col=id_col, text_col=text_col, most=most, features=features)
    kind = docs.schema[id_col].dataType.simpleString()
    if found:
        judge, every = found

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = judge.scores(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p.T.copy())], ["id", "p_content", "p_metadata", "quality"])

        out = every.mapInArrow(run, f"id {kind}, p_content double, p_metadata double, quality double")
    else:
        out = docs.select(F.col(id_col).alias("id"), *[F.lit(0.5).alias(c) for c in ("p_content", "p_metadata", "quality")])
    return out.select(F.col("id").alias(id_col), "p_content", "p_metadata", "quality", (F.col("quality") >= least).alias("kept"))
