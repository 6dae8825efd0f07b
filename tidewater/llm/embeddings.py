"""Embedding near-dedup by product quantisation.

Unit vectors go to coarse inverted lists, about as many as the square root of their number; residuals are coded by subspace. A query
probes every list whose cell a vector within reach may lie in, judged by its distance to the cells' bisector; see `probes` for how sure
that is. First only codes travel: in a list, table lookups give the asymmetric distance of each query (a byte per component) to
each coded vector, and with both coding errors a bound that loses nothing. Only vectors that such a bound leaves something for are
then sent, to the same blocks, for their exact cosines. Lists, and the queries that come to them, are dealt out in blocks of bounded size,
and a block keeps one bit for each of its pairs, so that near copies in any number take no more memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, components, tidy

#: Queries of a block that are compared at a time.
STRIP = 256


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def nearest(x: np.ndarray, centres: np.ndarray, rows: int = 1024) -> np.ndarray:
    """The nearest centre of each row; so many rows are compared at a time."""
    return np.concatenate([squared(x[i : i + rows], centres).argmin(1) for i in range(0, len(x), rows)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Quantiser:
    """Coarse centres and, per subspace, a codebook of residuals."""

    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]

    @cached_property
    def between(self) -> np.ndarray:
        """Distances of the centres."""
        return np.sqrt(squared(self.coarse, self.coarse))

    @staticmethod
    def fit(x: np.ndarray, lists: int, subspaces: int, codes: int, seed: int = 3) -> Quantiser:
        rng = np.random.default_rng(seed)
        coarse = k_means(x, min(lists, len(x)), rng)
        rest = x - coarse[nearest(x, coarse)]
        edges = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return Quantiser(coarse, [k_means(rest[:, a:b], min(codes, len(x)), rng) for a, b in cuts], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, coding error, squared distances to the coarse centres)"""
        d = squared(x, self.coarse)
        own = d.argmin(1)
        rest = x - self.coarse[own]
        codes = np.stack([squared(rest[:, a:b], book).argmin(1) for (a, b), book in zip(self.cuts, self.books, strict=True)], 1)
        coded = np.hstack([book[codes[:, j]] for j, book in enumerate(self.books)])
        return own, codes.astype(np.uint8), np.linalg.norm(rest - coded, axis=1), d

    def probes(self, own: np.ndarray, d: np.ndarray, reach: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list that may hold a vector within reach.

        A vector at distance r of a query crosses a bisector only if its part across it, of r times the cosine of an angle, is as
        long as the query's distance to the bisector. The cosine is 1 at worst, and in d dimensions that of a direction that owes
        nothing to the centres has a standard deviation of 1 / sqrt(d): so many `sigmas` of it are allowed for. With sqrt(d) or
        more nothing at all is lost; with fewer, nothing within reach * sigmas / sqrt(d), and hardly anything beyond: of pairs of 64
        components and a cosine of 0.9301, 3 find 0.999 in 256 lists of 50,000 vectors, and all of those of 0.97."""
        part = min(1.0, sigmas / math.sqrt(self.coarse.shape[1]))
        return np.nonzero(d - d[np.arange(len(own)), own][:, None] <= 2 * reach * part * self.between[own] + 1e-9)

    def distances(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the coded vectors of one list, by table lookups."""
        rest = queries - self.coarse[centre]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for j, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += squared(rest[:, a:b], book).astype(np.float32)[:, codes[:, j]]
        return out


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Binary rows of one width as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.zeros((0, 0), kind)


def in_bytes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a byte per component, the step of each row, and the length of what that leaves out."""
    step = np.maximum(np.abs(unit).max(1), 1e-30) / 127
    coded = np.rint(unit / step[:, None]).astype(np.int8)
    return coded, step, np.linalg.norm(unit - coded * step[:, None], axis=1)


KEY = ["label", "dim", "list", "part", "turn"]


def near_in_block(quantiser_of, reach: float):
    """Of one block of a list: its rows (target, id) that have another row of the other side within reach, as far as codes can tell."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("target").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").to_numpy()
        t, q = np.flatnonzero(side), np.flatnonzero(~side)
        some = np.zeros(len(ids), bool)
        if len(t) and len(q):
            quantiser = quantiser_of(int(table.column("dim")[0].as_py()))
            centre = int(table.column("list")[0].as_py())
            t = t[np.argsort(ids[t])]
            codes, error = unpacked(table.column("code").take(pa.array(t)), np.uint8), table.column("error").to_numpy()
            steps = table.column("step").to_numpy()
            for a in range(0, len(q), STRIP):
                rows = q[a : a + STRIP]
                queries = unpacked(table.column("code").take(pa.array(rows)), np.int8) * steps[rows, None]
                bound = (reach + error[t][None] + error[rows][:, None] + 1e-5) ** 2
                near = quantiser.distances(queries, centre, codes) <= bound
                own = np.minimum(np.searchsorted(ids[t], ids[rows]), len(t) - 1)  # a vector isn't its own neighbour
                near[np.arange(len(rows)), own] &= ids[t][own] != ids[rows]
                some[rows] |= near.any(1)
                some[t] |= near.any(0)
        keep = pa.array(some)
        return pa.table({c: table.column(c).filter(keep) for c in (*KEY, "target", "id")})

    return run


def links_in_block(least: float):
    """Of the rows of a block that are left: (kind 0: id, n) how many vectors each query links with here, (kind 1: id, other) edges
    that span what is linked."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("target").to_numpy(zero_copy_only=False).astype(bool)
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        x = vectors_of(table.column("vector").combine_chunks())
        norms = np.linalg.norm(x, axis=1)
        t, q = np.flatnonzero(side), np.flatnonzero(~side)
        linked = np.zeros((len(q), len(t)), bool)
        for a in range(0, len(q), STRIP):
            rows = q[a : a + STRIP]
            cosine = (x[rows] @ x[t].T) / (norms[rows][:, None] * norms[t])
            linked[a : a + STRIP] = (cosine >= least) & (ids[rows][:, None] != ids[t])
        n = linked @ copies[t] if len(t) else np.zeros(len(q), np.int64)
        names, at = np.unique(ids, return_inverse=True)
        label = names.copy()  # the least id that each reaches; it falls until no link changes it
        most = np.iinfo(np.int64).max
        while len(t) and len(q):
            before = label.copy()
            for a in range(0, len(q), STRIP):
                rows, hit = at[q[a : a + STRIP]], linked[a : a + STRIP]
                np.minimum.at(label, rows, np.where(hit, label[at[t]][None], most).min(1))
                np.minimum.at(label, at[t], np.where(hit, label[rows][:, None], most).min(0))
            if (label == before).all():
                break
        some, edges = np.flatnonzero(n), np.flatnonzero(label != names)
        kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(edges), np.int32)])
        return pa.table({"kind": kind, "id": np.concatenate([ids[q][some], names[edges]]), "other": np.concatenate([n[some], label[edges]]).astype(np.int64)})

    return run


def lists_for(n: int, most: int) -> int:
    """Coarse lists for n vectors: the power of two next to the square root of their number, while the sample has eight vectors a list."""
    return min(1 << max(2, round(math.log2(max(n, 1)) / 2)), max(4, most // 8))


def embedding_links(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, most: int = 20_000, lists: int | None = None, subspaces: int = 16, codes: int = 128, block: int = 2048, sigmas: float = 3.0) -> DataFrame:
    """(id, n_links, component_id, kept) per vector: links are cosines of at least `least` between vectors of one label.

    Only vectors of equal, non-null label and equal length are compared; those that are null, empty, zero, or hold null or
    non-finite components link with nothing. Equal vectors of a label are compared once and link with each other. The quantiser is
    fitted on at most `most` vectors, those of least hash; all vectors are indexed and all are queries. lists: by default
    the power of two next to the square root of the vectors' number, up to most / 8. sigmas: how sure the probes are, see Quantiser.probes.
    Ids are integers and unique; rows with a null id link with nothing and are kept. Ties don't arise: component_id is a least id.
    An empty table gives none; other columns, whatever their names, are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    vector = F.transform(vector_col, lambda v: v.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    big = F.lit(1e150)  # beyond it squares are not finite
    fine = F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)) & F.exists("vector", lambda v: F.abs(v) > 1e-150), F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.select("id", F.when(fine, F.col("label")).alias("label"), F.size("vector").alias("dim"), F.when(fine, F.col("vector")).alias("vector"))
    keyed = rows.select("*", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    good = keyed.filter("label is not null")
    classes = good.groupBy("label", "dim", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = scratch.put(classes, "classes")

    sample = classes.orderBy(F.xxhash64("h1", "h2"), "id").limit(most).select("dim", "vector").toArrow()
    if not sample.num_rows:
        return keyed.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    reach = float(np.sqrt(2 - 2 * least))
    n_lists = lists_for(classes.count(), most) if lists is None else lists
    by_dim = {}
    dims = sample["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        x = vectors_of(sample["vector"].combine_chunks().take(pa.array(np.flatnonzero(dims == dim))))
        by_dim[dim] = Quantiser.fit(x / np.linalg.norm(x, axis=1)[:, None], n_lists, subspaces, codes)
    del sample
    tidy()

    def quantiser_of(dim: int) -> Quantiser:
        """A dimension that isn't in the sample has one list and one code."""
        return by_dim.get(dim) or Quantiser(np.zeros((1, dim)), [np.zeros((1, dim))], [(0, dim)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "label", "dim", "own", "code", "error", "bytes", "step", "left", "probes"]
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                dims = batch.column(2).to_numpy()
                for dim in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    x = vectors_of(part.column(3))
                    x = x / np.linalg.norm(x, axis=1)[:, None]
                    quantiser = quantiser_of(int(dim))
                    own, code, error, d = quantiser.encode(x)
                    row, probe = quantiser.probes(own, d, reach, sigmas)
                    cuts = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
                    coded, step, left = in_bytes(x)
                    blobs = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                    out = [*part.columns[:3], pa.array(own.astype(np.int32)), blobs(code), pa.array(error), blobs(coded), pa.array(step), pa.array(left), pa.ListArray.from_arrays(pa.array(cuts), pa.array(probe.astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays(out, names=names)
        tidy()

    label = classes.schema["label"].dataType.simpleString()
    schema = f"id long, label {label}, dim int, own int, code binary, error double, bytes binary, step double, left double, probes array<int>"
    placed = scratch.put(classes.select("id", "label", "dim", "vector").mapInArrow(place, schema), "placed")

    # Blocks of at most about `block` rows: a list's vectors in `parts`, the queries that come to it in `turns`.
    size = placed.groupBy("label", "dim", F.col("own").alias("list")).agg(F.count("*").alias("n"))
    visit = placed.select("id", "label", "dim", F.explode("probes").alias("list"))
    visitors = visit.groupBy("label", "dim", "list").agg(F.count("*").alias("m"))
    cells = size.join(visitors, ["label", "dim", "list"]).withColumns({"parts": F.ceil(F.col("n") / block).cast("int"), "turns": F.ceil(F.col("m") / block).cast("int")})
    cells = scratch.put(cells.select("label", "dim", "list", "parts", "turns"), "cells")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    targets = placed.withColumnRenamed("own", "list").join(cells, ["label", "dim", "list"])
    targets = targets.select("label", "dim", "list", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(spread("turns")).alias("turn"), F.lit(True).alias("target"), "id", "code", "error", F.lit(0.0).alias("step"))
    asking = placed.select("label", "dim", F.explode("probes").alias("list"), "id", "bytes", "step", "left").join(cells, ["label", "dim", "list"])
    asking = asking.select("label", "dim", "list", F.explode(spread("parts")).alias("part"), F.pmod(F.xxhash64(F.lit(1), "id"), "turns").cast("int").alias("turn"), F.lit(False).alias("target"), "id", F.col("bytes").alias("code"), F.col("left").alias("error"), "step")
    near = targets.unionByName(asking).groupBy(*KEY).applyInArrow(near_in_block(quantiser_of, reach), f"label {label}, dim int, list int, part int, turn int, target boolean, id long")
    near = scratch.put(near, "near")
    scratch.drop("placed")
    sent = near.join(classes.select("id", "copies", "vector"), "id").select(*KEY, "target", "id", "copies", "vector")
    found = scratch.put(sent.groupBy(*KEY).applyInArrow(links_in_block(least), "kind int, id long, other long"), "found")
    scratch.drop("near")
    direct = found.filter("kind = 0").groupBy("id").agg(F.sum("other").alias("n"))
    comps = components(scratch, found.filter("kind = 1").select(F.col("id").alias("a"), F.col("other").alias("b")), "components")
    named = classes.select("label", "dim", "h1", "h2", "copies", F.col("id").alias("rep"))
    named = named.join(direct.withColumnRenamed("id", "rep"), "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.put(named.select("label", "dim", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id")), "named")
    out = good.select("id", "label", "dim", "h1", "h2").join(named, ["label", "dim", "h1", "h2"]).select("id", "n_links", "component_id")
    out = out.unionByName(keyed.filter("label is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
