"""What several operators share: shared-folder tables, vectorised word splitting and connected components."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word and line rules: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only where a session (a test) has none, one is made."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
    return shared_dir(spark)


class Scratch:
    """Tables of one run in the shared folder. They cut lineage, and outlive the loss of executors. A result may read them whenever it is
    used, so they go when the session ends, or before by remove(), or by sweep() once a result is written."""

    open: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fs, path = self._path()
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        Scratch.open.append(self)

    def _path(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Removes a table that no later plan reads."""
        fs, path = self._path(name)
        fs.delete(path, True)

    def remove(self) -> None:
        """Removes all of the run's tables."""
        fs, path = self._path()
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)
        Scratch.open.remove(self)

    @staticmethod
    @contextmanager
    def sweep() -> Iterator[None]:
        """Removes the tables of all runs that began inside, when it ends: what they led to must be written by then."""
        before = list(Scratch.open)
        yield
        for run in [s for s in Scratch.open if s not in before]:
            run.remove()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes a query's shuffle files when its result is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def tidy() -> None:
    """Gives free memory of this Python worker back, as it may stay for other tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def per_worker(key: tuple, make):
    """What a Python worker makes once and its later tasks find again."""
    import sys
    import types

    kept = sys.modules.setdefault("_tidewater_worker", types.ModuleType("_tidewater_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and its offsets (nulls are empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column without nulls as one byte array, of its own, and its offsets."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]].copy(), at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a batch starts and ends; words end with their document. apart: the bytes between words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~apart[data]
    first, last = inside.copy(), inside.copy()  # a word starts here; a word ends here
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fold: bool = True, beginnings: int = 0) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of every span of bytes (spans of up to 8 bytes and one length never share it); with `beginnings` also the first so many
    bytes of each longer span, else 0. Spans are hashed eight bytes at a time, with their length, so that all work is done by whole arrays."""
    n = len(data)
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = LOWER[data] if fold else data
    blocks = np.lib.stride_tricks.as_strided(wide.view(), (n + 1, 8), (1, 1))
    hashed = mix(lengths.astype(np.uint64) * MULT)
    left = np.arange(len(starts))
    k = 0
    masks = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
    while len(left):
        some = np.ascontiguousarray(blocks[starts[left] + 8 * k]).view(np.uint64)[:, 0]
        some = some & masks[np.minimum(lengths[left] - 8 * k, 8)]
        hashed[left] = mix((hashed[left] ^ some) * MULT + np.uint64(k + 1))
        k += 1
        left = left[lengths[left] > 8 * k]
    if not beginnings:
        return (hashed,)
    head = np.ascontiguousarray(blocks[starts]).view(np.uint64)[:, 0] & masks[beginnings]
    return hashed, np.where(lengths > beginnings, head, np.uint64(0))


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True, apart: np.ndarray = SPACE, beginnings: int = 0) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of every word [^\\x20\\x09-\\x0D]+ of a batch, and the offsets of each document's words.

    apart: the bytes between words, if others. beginnings: a third array has the first so many bytes of each longer word, else 0.
    """
    if not len(data):
        none = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return (*none, none[0]) if beginnings else none
    starts, ends = word_spans(data, offsets, apart)
    hashed, *head = hash_spans(data, starts, ends - starts, fold, beginnings)
    return hashed, np.searchsorted(starts, offsets), *head


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every k-word shingle (repeats included) and each document's offsets; a document of fewer words has its
    whole sequence as one shingle, one without words none."""
    n = len(hashes)
    counts = np.diff(offsets)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(sizes)])
    if not n:
        return np.zeros(0, np.uint64), at
    rolled = np.zeros(n, np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        rolled = mix(rolled * MULT + padded[j : j + n])
    doc = np.repeat(np.arange(len(counts)), sizes)
    out = rolled[offsets[:-1][doc] + np.arange(len(doc)) - at[:-1][doc]]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        h = np.full(1, counts[d], np.uint64)
        for x in hashes[offsets[d] : offsets[d + 1]]:
            h = mix(h * MULT + x)
        out[at[d]] = h[0] ^ MIX1
    return out, at


def distinct_sets(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in ascending order."""
    parts = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    sizes = np.array([len(x) for x in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def set_id(ids: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    return int.from_bytes(hashlib.blake2b(np.ascontiguousarray(ids).tobytes(), digest_size=8).digest(), "little", signed=True)


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, comp), comp the smallest node reachable.

    Alternating large-star and small-star rounds; each shuffles one row per edge, and never holds a component in one
    task: every round is a partial aggregation and a join whose large keys Spark can split. Nodes without an edge have no row.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.put(edges, f"{name}-0")
    # The rounds' tables have about as many rows as there are edges, often few: no file of a few rows for each shuffle partition.
    files = -(-edges.count() // 50_000) or 1
    put = lambda df, part: scratch.put(df.coalesce(files) if files < partitions(scratch.spark) else df, f"{name}-{part}")
    before, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Tables of their own, so that a join deals both sides anew and Spark may split the rows of a large component.
        least = put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"m{k}")
        # large star: every larger neighbour goes to the least one
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = put(large, f"l{k}")
        # small star: all smaller neighbours go to the least of them
        low = put(large.groupBy("u").agg(F.min("v").alias("m")), f"n{k}")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = put(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{k + 1}")
        for part in "lmn":
            scratch.drop(f"{name}-{part}{k}")
        scratch.drop(f"{name}-{k}")
        edges, k = new, k + 1
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def pieces_of(batches, column: int, most: int = 4 << 20):
    """The batches, cut so that each has at most `most` bytes of text (a longer text is alone): array work takes memory by
    the bytes at hand."""
    for batch in batches:
        at = np.concatenate([[0], np.cumsum(np.asarray(_lengths(batch.column(column))))])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    tidy()


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
