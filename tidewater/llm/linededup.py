"""Line dedup: lines that many documents share stay in one of them.

Line hashes are range-partitioned by (hash, document), so even a line that a third of all documents holds is dealt over
many tasks, and sorted by document and position within them. Each task streams its runs of equal hashes. A run that may
go on in a neighbouring partition stays open: its count and last document, two rows a task at most, are summed over
tasks and then settle the open lines. What comes back is a compressed keep bitmap per document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, partitions, pieces_of, tidy

STRIP = b" \t\n\x0b\x0c\r"


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(h1, h2, doc, pos) of every line whose key has at least `least` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in pieces_of(batches, 1):
            hashes, pos, counts = [], [], []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                before = len(pos)
                for i, line in enumerate((text or b"").split(b"\n")):
                    if len(line) >= least:
                        line = line.strip(STRIP)
                        n = len(line)
                        if n >= least and (n >= 4 * least or len(line.decode()) >= least):
                            hashes.append(digest(line.lower()))  # bytes: folds A-Z alone
                            pos.append(i)
                counts.append(len(pos) - before)
            two = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), ids, pa.array(pos, pa.int32())], ["h1", "h2", "doc", "pos"])

    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "h1 long, h2 long, doc long, pos int")


def stream_runs(most_docs: int, part: int = 1_000_000):
    """Per sorted partition: rows (kind, h1, h2, doc, pos, n). kind 0: drop this line; 1: an open run's line; 2: what an open run
    holds (n documents, doc the last)."""

    def settle(held: list[np.ndarray], first_open: bool, last_open: bool, counted: bool) -> Iterator[pa.RecordBatch]:
        """counted: the first row's document was counted with the part before."""
        h1, h2, doc, pos = held
        n = len(h1)
        if not n:
            return
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        fresh[0] = not counted
        n_docs = np.bincount(run, weights=fresh).astype(np.int64)
        last = doc[np.append(starts[1:], n) - 1]
        is_open = np.zeros(len(starts), bool)
        is_open[0], is_open[-1] = first_open, is_open[-1] | last_open
        is_open[0] |= first_open
        dropped = (n_docs[run] >= most_docs) & (doc != last[run]) & ~is_open[run]
        waits = is_open[run]
        for k, some in ((0, dropped), (1, waits)):
            if some.any():
                m = int(some.sum())
                yield batch_of(k, h1[some], h2[some], doc[some], pos[some], np.zeros(m, np.int64))
        if is_open.any():
            at = starts[is_open]
            yield batch_of(2, h1[at], h2[at], last[is_open], np.zeros(len(at), np.int32), n_docs[is_open])

    def batch_of(kind, h1, h2, doc, pos, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h1), kind, np.int32)), *map(pa.array, (h1, h2, doc, pos, n))], ["kind", "h1", "h2", "doc", "pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, before = None, True, None  # before: the key and document that a part of a run ended with
        known = lambda: (held[0][0], held[1][0], held[2][0]) == before
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = new if held is None else [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
            h1, h2, doc, pos = held
            # All but the last run is complete; a last run of great length is passed on open, in parts.
            ends = np.flatnonzero((h1 != h1[-1]) | (h2 != h2[-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from settle([x[:cut] for x in held], first, False, known())
                held, first, before = [x[cut:] for x in held], False, None
            elif len(h1) > part:
                yield from settle(held, True, True, known())
                held, first, before = None, True, (h1[-1], h2[-1], doc[-1])
        if held is not None:
            yield from settle(held, first, True, known())
        tidy()

    return run


def n_lines(text_col: str) -> Column:
    text = F.coalesce(text_col, F.lit(""))
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 20, most_docs: int = 3) -> DataFrame:
    """(id, n_lines, n_dropped, keep) per row: keep is a zlib-compressed bitmap of the lines that stay, null if all do.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least `least` code points found in at
    least `most_docs` documents lose all their lines but those of the largest id. Null or empty text is one empty line; ids
    are integers; rows of one id count as one document (and ought to be equal); rows with a null id keep all lines and count nowhere; an
    empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    lines = scratch.put(keyed_lines(docs, id_col, text_col, least), "keyed")
    dealt = lines.repartitionByRange(partitions(spark), "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    found = scratch.put(dealt.mapInArrow(stream_runs(most_docs), "kind int, h1 long, h2 long, doc long, pos int, n long"), "runs")
    scratch.drop("keyed")
    runs = found.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= most_docs)
    # Two rows a task at most stand behind `runs`, whatever the input's size.
    waiting = found.filter("kind = 1").select("h1", "h2", "doc", "pos").join(F.broadcast(runs), ["h1", "h2"]).filter("doc <> last")
    drops = found.filter("kind = 0").select("doc", "pos").unionByName(waiting.select("doc", "pos"))
    per_doc = drops.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("drops"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if gone is None:
                    keep.append(None)
                    continue
                bits = np.ones(n, np.uint8)
                bits[[g for g in gone if g < n]] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(keep, pa.binary())], ["id", "n_lines", "n_dropped", "keep"])

    sizes = docs.select(F.col(id_col).cast("long").alias("id"), n_lines(text_col).alias("n_lines"))
    joined = sizes.join(per_doc, F.col("id") == F.col("doc"), "left").select("id", "n_lines", "drops", F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))
    joined = joined.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
    out = joined.mapInArrow(bitmaps, "id long, n_lines long, n_dropped long, keep binary")
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "keep")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents, all columns as they were, with only the kept lines in their text. Rows with equal ids must be equal.
    count_col: adds a column of this name, the lines dropped."""
    keep = "__keep"
    while keep in docs.columns:
        keep += "_"
    bits = bitmaps.filter("keep is not null").select(F.col(id_col).alias("__id"), F.col("keep").alias(keep), F.col("n_dropped").alias("__n")).dropDuplicates(["__id"])
    marked = docs.join(bits, docs[id_col] == F.col("__id"), "left").drop("__id")
    if count_col:
        docs = docs.withColumn(count_col, F.lit(0).cast("long"))
        marked = marked.withColumn(count_col, F.coalesce("__n", F.lit(0)).cast("long"))
    place, at = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, place):
            texts = batch.column(place).cast(pa.large_binary()).to_pylist()
            for i, bits in enumerate(batch.column(at).to_pylist()):
                if bits is not None:
                    lines = (texts[i] or b"").split(b"\n")
                    stay = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
                    texts[i] = b"\n".join([x for x, s in zip(lines, stay, strict=True) if s])
            columns = [batch.column(i) for i in range(at)]
            columns[place] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(at)])

    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])
    changed = marked.filter(F.col(keep).isNotNull()).select(*[F.col(c) for c in docs.columns], keep)
    whole = marked.filter(F.col(keep).isNull()).select(*[F.col(c) for c in docs.columns])
    return whole.unionByName(changed.mapInArrow(run, schema).toDF(*docs.columns))
