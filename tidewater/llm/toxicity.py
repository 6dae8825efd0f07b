"""Toxicity by a chain of linear classifiers.

Each category has a logistic model over hashed words, word beginnings and shape statistics, and over the probabilities of the
categories before it. While training, those are out-of-fold predictions, so a later model sees earlier ones as they
will be on texts that they have not seen. Models are fitted on a bounded sample of labelled documents; all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import pieces_of, tidy
from tidewater.llm.linear import STATS, Rows, Vocabulary, featurise, fit_logistic, sigmoid, unpacked
from tidewater.llm.linear import features as features_of


@dataclass
class Chain:
    names: list[str]
    words: Vocabulary
    weights: list[np.ndarray]
    thresholds: list[float]
    held_out: dict[str, float]  # each category's F1 on out-of-fold predictions

    def probabilities(self, column: pa.Array) -> np.ndarray:
        docs, ids, stats = features_of(column)
        docs, columns = self.words.hits(docs, ids)
        known = stats
        for w in self.weights:
            known = np.hstack([known, sigmoid(self.words.logits(docs, columns, known, w))[:, None]])
        return known[:, len(STATS) :]


def best_threshold(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The threshold of the best F1 on held-out predictions, midway to the next lower one, and that F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(np.argmax(f1))
    sorted_p = p[order]
    return float((sorted_p[k] + sorted_p[min(k + 1, len(p) - 1)]) / 2), float(f1[k])


def fit_chain(words: Vocabulary, x: Rows, labels: np.ndarray, names: list[str], folds: int = 4, l2: float = 0.3) -> Chain:
    """labels: a column per category, 0 or 1; rows come in a fixed order, and row i is in fold i % folds."""
    fold = np.arange(len(x)) % folds
    weights, thresholds, held = [], [], {}
    for j, name in enumerate(names):
        y = labels[:, j].astype(float)
        out = np.zeros(len(x))
        for f in range(folds):
            a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(b):
                out[b] = sigmoid(x.take(b).times(fit_logistic(x.take(a), y[a], l2)))
        weights.append(fit_logistic(x, y, l2))
        t, f1 = best_threshold(out, y) if len(y) and 0 < y.sum() < len(y) else (0.5, 0.0)
        # too few labels to tell a threshold by: an even chance is asked for
        thresholds.append(min(max(t, 0.2), 0.95) if f1 >= 0.5 else 0.5)
        held[name] = f1
        x = x.beside(out)
    return Chain(list(names), words, weights, thresholds, held)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text", most: int = 10_000, features: int = 1500) -> Chain | None:
    """Fits on at most `most` labelled documents that are among docs, those of least hash, with at most so many features. None without labels.

    A category's label that is null counts as 0; of several labels of one id the largest counts; of several rows with one id the
    one of least hash.
    """
    flags = [F.coalesce(c.cast("int"), F.lit(0)).alias(f"y{j}") for j, c in enumerate(categories.values())]
    some = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *flags)
    some = some.groupBy("id").agg(*[F.max(f"y{j}").alias(f"y{j}") for j in range(len(flags))])
    # Labels of documents that aren't there don't count against the bound.
    there = docs.select(F.col(id_col).alias("id")).join(some, "id").distinct()
    some = there.orderBy(F.xxhash64(F.lit("toxicity"), "id"), "id").limit(most)  # the bound of the broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    rows = rows.withColumn("h", F.xxhash64("text")).groupBy("id").agg(F.min_by(F.struct("text", *[f"y{j}" for j in range(len(flags))]), "h").alias("r")).select("id", "r.*")
    rows = rows.select("text", "id", F.array(*[f"y{j}" for j in range(len(flags))]).alias("y"))
    sample = rows.mapInArrow(lambda b: featurise(pieces_of(b, 0)), f"id {rows.schema['id'].dataType.simpleString()}, y array<int>, ids binary, stats binary").toArrow()
    if not sample.num_rows:
        return None
    sample = sample.sort_by("id")
    lists, stats, y = unpacked(sample["ids"], np.int32), np.array(unpacked(sample["stats"], np.float64)), np.array(sample["y"].to_pylist())
    words = Vocabulary.choose(lists, [y[:, j] for j in range(y.shape[1])], features)
    x = words.rows(lists, stats)
    del sample, lists
    tidy()
    chain = fit_chain(words, x, y, list(categories))
    tidy()
    return chain


def score(docs: DataFrame, chain: Chain | None, *, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """The rows with p_<category> double and is_<category> boolean per category; all columns stay.

    Null texts count as empty; null ids are scored like others; long texts are read whole. Without a chain (no labels) probabilities are 0 and flags false. Equal rows get equal scores; an empty
    table gives none. Columns of those names, after the prefix, are replaced.
    """
    names = tuple(chain.names) if chain else names
    new = [x for n in names for x in (f"{prefix}p_{n}", f"{prefix}is_{n}")]
    docs = docs.drop(*new)
    if chain is None:
        return docs.withColumns({c: F.lit(False) if i % 2 else F.lit(0.0) for i, c in enumerate(new)})
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, place):
            p = chain.probabilities(batch.column(place))
            more = [x for j, t in enumerate(chain.thresholds) for x in (pa.array(p[:, j]), pa.array(p[:, j] >= t))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[f"c{i}" for i in range(len(batch.columns) + len(more))])

    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    kinds = [f.dataType for f in docs.schema.fields] + [DoubleType(), BooleanType()] * len(names)
    return docs.mapInArrow(run, StructType([StructField(f"c{i}", t) for i, t in enumerate(kinds)])).toDF(*docs.columns, *new)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 10_000, features: int = 1500, prefix: str = "") -> DataFrame:
    """Scores all documents on the two categories that the labels table knows: junk (quality 0), then toxic given junk. See train and score."""
    categories = {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = train(docs, labels, categories, id_col=id_col, text_col=text_col, most=most, features=features)
    return score(docs, chain, id_col=id_col, text_col=text_col, names=tuple(categories), prefix=prefix)
