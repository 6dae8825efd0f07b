"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order: rare before frequent (by counts over all documents, in a sketch of fixed size), then by
hash. The order decides nothing but the work. A document's prefix in it, long enough that two documents over the threshold
share an n-gram there, finds candidates. The global order is cut into fragments of like volume; candidates' overlaps are
counted in each fragment separately and summed per pair, which gives the exact Jaccard similarity.

Copies with equal sets are one node. Prefixes are dealt by ranges of (n-gram, place) and streamed, so that an n-gram of very many
documents is dealt over many tasks too. Within the documents that share a prefix n-gram each is first compared with one pivot, the first
in that order; then the pairs that those links leave apart are compared. That gives the connected components at about the cost of the
rows. Every link is within a component, so all pairs of sets of a component of three or more can be compared, in blocks of sets that meet
in one task each, for the number of links of each document or the links themselves. Where rows of a group have to meet each other they do so in such
blocks, and only pairs that pass a bound on their overlap (by parities of each set, about one for each n-gram) come out, before any n-grams are sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, bytes_of, components, distinct_sets, partitions, pieces_of, shingles, tidy, word_hashes

#: Bits of the sketch's cells, and counters of a row of it.
BITS, CHUNK = 18, 4096
LOW = np.uint64(64 - BITS)
#: Rows of a block, at most about twice as many of which meet in a task.
BLOCK = 512


def word_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of a batch of texts, ascending by hash, and each text's offsets."""
    data, at = bytes_of(column)
    return distinct_sets(*shingles(*word_hashes(data, at), k))


def names_of(hashes: np.ndarray, twice: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Two signed 64-bit names of a set of hashes. The first is what it goes by; where another set has the same first name, and
    so it is in `twice`, the second."""
    digest = hashlib.blake2b(np.ascontiguousarray(hashes).tobytes(), digest_size=16).digest()
    a, b = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))
    return (b if a in twice else a), b


def describe(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """kind 0: (doc, text_h, n, set, second, bits), text_h a hash of the text that tells an id's texts apart; kind 1: (chunk, counts), what a task counted in the cells of the sketch.

    bits: see parities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.uint32)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        names = ["kind", "doc", "text_h", "n", "set", "second", "chunk", "counts", "bits"]
        for batch in pieces_of(batches, 1):
            hashes, at = word_sets(batch.column(1), k)
            counts += np.bincount(hashes >> LOW, minlength=1 << BITS).astype(np.uint32)
            n = batch.num_rows
            sets, second = zip(*(names_of(hashes[at[i] : at[i + 1]]) if at[i + 1] > at[i] else (None, None) for i in range(n)), strict=True)
            parts = [parities(hashes[at[i] : at[i + 1]]) for i in range(n)]
            bits = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))
            rows = [np.zeros(n, np.int32), batch.column(0), batch.column(2), np.diff(at), sets, second, [None] * n, [None] * n, bits]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)
        m = (1 << BITS) // CHUNK
        rows = [[1] * m, *[[None] * m] * 5, range(m), [c.tobytes() for c in counts.reshape(m, CHUNK)], [None] * m]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col)).mapInArrow(run, "kind int, doc long, text_h long, n long, set long, second long, chunk int, counts binary, bits array<long>")


def parities(hashes: np.ndarray, least: int = 1 << 8, most: int = 1 << 15) -> np.ndarray:
    """A power of two of bits, as 64-bit words, about one for each of the hashes within bounds; each is the parity of those that fall on it. Two sets
    differ in at least as many hashes as bits. Halves laid over each other (xor) are the parities in half as many bits."""
    size = min(max(least, 1 << max(len(hashes) - 1, 0).bit_length()), most)
    return np.packbits((np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.int64)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[c] = sums.get(c, 0) + np.frombuffer(x, np.uint32).astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])


@dataclass
class Order:
    """The global n-gram order: each cell's rank, and the ranks at which fragments begin. Its size is fixed."""

    rank: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def of(sketch: DataFrame, fragments: int) -> Order:
        m = (1 << BITS) // CHUNK
        summed = sketch.repartition(m, "chunk").mapInArrow(add_up, "chunk int, counts binary")
        counts = np.zeros((m, CHUNK), np.uint64)
        for r in summed.collect():  # 2**18 counters, whatever the input
            counts[r.chunk] += np.frombuffer(r.counts, np.uint64)
        flat = counts.reshape(-1)
        by = np.argsort(flat, kind="stable")
        rank = np.empty(len(flat), np.uint64)
        rank[by] = np.arange(len(flat), dtype=np.uint64)
        volume = np.cumsum(flat[by].astype(np.float64))
        at = np.searchsorted(volume, volume[-1] * np.arange(1, fragments) / fragments) if volume[-1] else np.zeros(0, np.int64)
        return Order(rank, np.unique(at).astype(np.uint64))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Where the n-grams stand in the order: a bijection of their hashes."""
        return (self.rank[hashes >> LOW] << LOW) | (hashes & ((np.uint64(1) << LOW) - np.uint64(1)))


def prefixes(docs: DataFrame, text_col: str, k: int, percent: int, order: Order, twice: frozenset[int]) -> DataFrame:
    """(gram, own, set) of each n-gram of each set's prefix; own: its place in the prefix, and the set's size in the lower 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces_of(batches, 0):
            hashes, at = word_sets(batch.column(0), k)
            keys = order.keys(hashes)
            grams, sets, sizes = [np.zeros(0, np.uint64)], [], []
            for i in range(batch.num_rows):
                a, b = int(at[i]), int(at[i + 1])
                if a == b or (name := names_of(hashes[a:b], twice)[0]) in seen:
                    continue
                seen.add(name)
                n = b - a
                own = keys[a:b]
                p = n - -(-percent * n // 100) + 1
                grams.append(np.sort(np.partition(own, p - 1)[:p]) if p < n else np.sort(own))
                sets.append(name)
                sizes.append(n)
            counts = np.array([len(g) for g in grams[1:]], np.int64)
            pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            own = pos << 32 | np.repeat(np.array(sizes, np.int64), counts)
            out = [np.concatenate(grams).view(np.int64), own, np.repeat(np.array(sets, np.int64), counts)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["gram", "own", "set"])

    return docs.select(F.col(text_col)).mapInArrow(run, "gram long, own long, set long")


def partners(own: np.ndarray, at: np.ndarray, sizes: np.ndarray, percent: int, most: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of rows (at, sizes): whether a row can be linked with its run's first row, and whether it can with any other, by sizes and
    places (see possible). In runs of over `most` rows all may."""
    n, rest = own & 0xFFFFFFFF, (own & 0xFFFFFFFF) - (own >> 32)
    star, many = np.ones(len(own), bool), np.ones(len(own), bool)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= most)]).tolist():
        runs = at[sizes == size]
        for i in range(0, len(runs), step := max(1, (1 << 20) // size**2)):
            where = runs[i : i + step, None] + np.arange(size)
            a, b = n[where][:, :, None], n[where][:, None, :]
            ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            ok &= (100 + percent) * np.minimum(rest[where][:, :, None], rest[where][:, None, :]) >= percent * (a + b)
            ok[:, np.arange(size), np.arange(size)] = False
            star[where] = ok[:, 0, :]
            ok[:, 0, :] = ok[:, :, 0] = False
            many[where] = ok.any(2)
    return star, many


def streamed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Prefix rows sorted by (gram, own, set) to rows (open, gram, own, set, pivot_own, pivot, many).

    The pivot is the n-gram's first row here. Rows that can't be linked with another row of their n-gram go, and so do pivots; many: the row may be
    linked with another one than the pivot. The first and the last n-gram may go on in a neighbouring partition: all their rows
    stay, and each gives one more row, open, of its pivot.
    """

    def rows(is_open: bool, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), is_open)), *map(pa.array, columns)], ["open", "gram", "own", "set", "pivot_own", "pivot", "many"])

    held: list[np.ndarray] | None = None  # the last n-gram's last row, and its pivot
    alone = True  # the held row is the only one of its n-gram and hasn't been passed on
    first = True
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(new[0]):
            continue
        before = [x[:1] if held is None else h[:1] for x, h in zip(new, held or new, strict=False)]
        same = np.ones(len(new[0]), bool)  # as the row before: copies of a set from different tasks
        for x, b in zip(new, before, strict=True):
            same &= x == np.concatenate([b, x[:-1]])
        same[0] &= held is not None
        gram, own, name = (x[~same] for x in new)
        if not len(gram):
            continue
        goes_on = held is not None and gram[0] == held[0][0]
        starts = np.concatenate([[True], gram[1:] != gram[:-1]])
        run = np.cumsum(starts) - 1
        at = np.flatnonzero(starts)
        sizes = np.diff(np.append(at, len(gram)))
        pivot_own, pivot = own[at], name[at]
        if goes_on:
            pivot_own[0], pivot[0] = held[3][0], held[4][0]
        if held is not None and alone and (goes_on or first):
            yield rows(False, *held, np.array([True]))
        if held is not None and not goes_on and first:
            yield rows(True, held[0], *held[3:], *held[3:], np.array([True]))
            first = False
        keep = sizes > 1
        keep[0] |= goes_on or (first and len(at) > 1)
        last_alone = sizes[-1] == 1 and not (goes_on and len(at) == 1)
        keep[-1] &= not last_alone
        some = keep[run]
        star, many = partners(own, at, sizes, percent)
        ended = run != run[-1]  # runs that are here as a whole
        if goes_on or first:
            ended &= run != 0
        some &= ~ended | star | many
        many |= ~ended
        if some.any():
            yield rows(False, gram[some], own[some], name[some], pivot_own[run][some], pivot[run][some], many[some])
        if first and len(at) > 1:
            yield rows(True, gram[:1], pivot_own[:1], pivot[:1], pivot_own[:1], pivot[:1], np.array([True]))
            first = False
        held, alone = [gram[-1:], own[-1:], name[-1:], pivot_own[-1:], pivot[-1:]], bool(last_alone)
    if held is not None:
        if alone:
            yield rows(False, *held, np.array([True]))
        yield rows(True, held[0], *held[3:], *held[3:], np.array([True]))
    tidy()


def fragments_of(rows: DataFrame, k: int, order: Order, twice: frozenset[int]) -> DataFrame:
    """(set, n, part, grams) of rows (doc, set, text): an ascending array per fragment. Rows whose text isn't that set go (another text of
    the same id), and repeated rows that follow each other; a null set stands for whatever the text's set is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, seen = None, set()
        for batch in pieces_of(batches, 2):
            hashes, at = word_sets(batch.column(2), k)
            keys = order.keys(hashes)
            sets, sizes, parts, grams = [], [], [], []
            for i, (d, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if d != doc:
                    doc, seen = d, set()
                if at[i] == at[i + 1]:
                    continue
                name = names_of(hashes[at[i] : at[i + 1]], twice)[0]
                if wanted not in (None, name) or name in seen:
                    continue
                seen.add(name)
                own = np.sort(keys[at[i] : at[i + 1]])
                ends = [0, *np.searchsorted(own, order.cuts << LOW).tolist(), len(own)]
                for f, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if b > a:
                        sets.append(name)
                        sizes.append(len(own))
                        parts.append(f)
                        grams.append(own[a:b].view(np.int64))
            flat = pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, grams)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parts, pa.int32()), lists], ["set", "n", "part", "grams"])

    return rows.select("doc", "set", "text").mapInArrow(run, "set long, n int, part int, grams array<long>")


def dealt(rows: DataFrame, key: str, m: str, block: int) -> DataFrame:
    """Rows with (i, j, own): those of a key, m of them, are dealt into blocks of about `block` by their set, and each two blocks meet once."""
    own = F.pmod(F.xxhash64("set"), F.col("blocks"))
    out = rows.withColumn("blocks", F.expr(f"({m} + {block - 1}) div {block}")).withColumn("own", own)
    out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return out.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other", m)


def by_group(rows: DataFrame, keys: list[str], more: list[str], solve: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """solve() of the rows of each value of the keys, which come sorted by `more`. A group must be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a group that may go on in the next batch
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(c).to_numpy() for c in range(len(keys))], 1)
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(values)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(values[x]) != key:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                key = tuple(values[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield solve(pa.Table.from_batches(held))
        tidy()

    rows = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, *more).mapInArrow(run, schema)


def overlaps(hashes: np.ndarray, at: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many hashes each two of the sets have in common; so many different hashes are counted at a time."""
    names, which = np.unique(hashes, return_inverse=True)
    m = len(at) - 1
    row = np.repeat(np.arange(m), np.diff(at))
    by = np.argsort(which, kind="stable")
    which, row = which[by], row[by]
    out = np.zeros((m, m), np.float32)  # counts below 2 ** 24 are exact
    if len(names) and np.diff(at).max() >= 1 << 24:
        out = out.astype(np.float64)
    for start in range(0, len(names), width):
        a, b = np.searchsorted(which, [start, start + width])
        x = np.zeros((m, min(width, len(names) - start)), np.float32)
        x[row[a:b], which[a:b] - start] = 1
        out += x @ x.T
    return out


def within(members: DataFrame, parts: DataFrame, percent: int, pairs: bool, block: int = BLOCK) -> DataFrame:
    """Of all linked pairs of sets within components: (a, b, n_a, n_b, common) of each, or (set, others), the copies that a set is linked
    with. members: (set, comp, m, copies), m the component's sets; parts: (set, n, part, grams), the fragments of each."""
    rows = dealt(members, "comp", "m", block).join(parts.select("set", "n", "grams"), "set").select("comp", "i", "j", "own", "set", "copies", "n", "grams")

    def solve(group: pa.Table) -> pa.RecordBatch:
        sets, sides, copies, n = (group.column(c).to_numpy() for c in ("set", "own", "copies", "n"))
        lists = group.column("grams").combine_chunks()
        at = lists.offsets.to_numpy()
        new = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]]))  # a set's fragments stand together
        sets, sides, copies, n = sets[new], sides[new], copies[new], n[new].astype(np.int64)
        common = overlaps(lists.values.to_numpy()[at[0] : at[-1]], np.append(at[new], at[-1]) - at[0])
        linked = 100 * common >= percent * (n[:, None] + n - common)
        np.fill_diagonal(linked, False)
        if group.column("i")[0].as_py() != group.column("j")[0].as_py():
            linked &= sides[:, None] != sides
        if not pairs:
            others = linked @ copies
            some = others > 0
            return pa.RecordBatch.from_arrays([pa.array(sets[some]), pa.array(others[some])], ["set", "others"])
        a, b = np.nonzero(linked & (sets[:, None] < sets))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (sets[a], sets[b], n[a].astype(np.int32), n[b].astype(np.int32), common[a, b].astype(np.int64))], ["a", "b", "n_a", "n_b", "common"])

    return by_group(rows, ["comp", "i", "j"], ["own", "set"], solve, "a long, b long, n_a int, n_b int, common long" if pairs else "set long, others long")


class Folded:
    """Rows of parities of several sizes."""

    def __init__(self, column: pa.ListArray):
        at, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        self.size = np.diff(at)
        self.rows = {}
        for m in np.unique(self.size).tolist():
            some = np.flatnonzero(self.size >= m)
            rows = np.zeros((len(at) - 1, m), np.uint64)
            for i in some.tolist():
                rows[i] = np.bitwise_xor.reduce(flat[at[i] : at[i + 1]].reshape(-1, m), axis=0)
            self.rows[m] = rows

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits rows differ, in the smaller size of the two."""
        out, size = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        for m, rows in self.rows.items():
            some = np.flatnonzero(size == m)
            for i in range(0, len(some), step := max(1, (1 << 18) // m)):
                k = some[i : i + step]
                out[k] = np.bitwise_count(rows[a[k]] ^ rows[b[k]]).sum(1, dtype=np.int64)
        return out


def apart_pairs(rows: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): the pairs of sets of different components that share a prefix n-gram and pass the bounds. rows: (gram, set, place, comp, bits, m),
    m the n-gram's rows."""

    def solve(group: pa.Table) -> pa.RecordBatch:
        sets, sides, place, comp = (group.column(c).to_numpy() for c in ("set", "own", "place", "comp"))
        n, pos = place & 0xFFFFFFFF, place >> 32
        bits = Folded(group.column("bits").combine_chunks())
        cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        for x in range(0, len(sets), 128):
            s = slice(x, x + 128)
            both = n[s, None] + n
            ok = (comp[s, None] != comp) & (sets[s, None] < sets)
            ok &= 100 * np.minimum(n[s, None], n) >= percent * np.maximum(n[s, None], n)
            ok &= (100 + percent) * np.minimum((n - pos)[s, None], n - pos) >= percent * both
            if cross:
                ok &= sides[s, None] != sides
            a, b = np.nonzero(ok)
            a += x
            differ = bits.differ(a, b)
            most = n[a] + n[b] - differ  # twice the overlap at most
            fine = 100 * most >= percent * (2 * (n[a] + n[b]) - most)
            found.append(np.stack([sets[a[fine]], sets[b[fine]]], 1))
        out = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return by_group(dealt(rows, "gram", "m", block), ["gram", "i", "j"], ["set"], solve, "a long, b long").distinct()


def alike(percent: int) -> Column:
    """A bound on a pair's overlap by bits_a and bits_b."""
    m = F.least(F.size("bits_a"), F.size("bits_b"))
    whole = lambda c, i: F.aggregate(F.sequence(F.lit(0), (F.size(c) / m).cast("int") - 1), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(c, (i + j * m).cast("int"))))
    differ = F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0), lambda s, i: s + F.bit_count(whole("bits_a", i).bitwiseXOR(whole("bits_b", i))))
    most = F.col("n_a") + F.col("n_b") - differ  # twice the overlap at most
    return 100 * most >= percent * (2 * (F.col("n_a") + F.col("n_b")) - most)


def possible(percent: int) -> str:
    """Length and position filters on a pair that shares the n-gram at pos_a and pos_b."""
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {100 + percent} * least(n_a - pos_a, n_b - pos_b) >= {percent} * (n_a + n_b)"


class JaccardJoin:
    """sets: (doc, text_h, n, set) per row; comps: (node, comp) of the linked sets. Links are within components, and are counted or listed
    when they are asked for."""

    def __init__(self, sets: DataFrame, nodes: DataFrame, comps: DataFrame, parts: DataFrame, percent: int, scratch: Scratch):
        self.sets, self.nodes, self.comps, self.parts, self.percent, self.scratch = sets, nodes, comps, parts, percent, scratch
        self._members = None

    def members(self) -> DataFrame:
        """(set, comp, m, copies) of the sets that are linked, m the component's sets."""
        if self._members is None:
            every = self.comps.select(F.col("node").alias("set"), "comp").unionByName(self.comps.select(F.col("comp").alias("set"), "comp")).distinct()
            every = self.scratch.put(every.join(self.nodes.select("set", "copies"), "set"), "linked")
            sizes = every.groupBy("comp").agg(F.count("*").alias("m"))
            self._members = self.scratch.put(every.join(sizes, "comp"), "members")
        return self._members

    @property
    def links(self) -> DataFrame:
        """(a, b, n_a, n_b, common): all pairs a < b of different sets that are linked."""
        return within(self.members(), self.parts, self.percent, True)

    def by_set(self, counted: bool = True) -> DataFrame:
        """(set, component, component_id, n_links) per set; n_links of each of its documents, copies included. component is a set's name."""
        comps = self.members().select("set", "comp")
        least = comps.join(self.nodes.select("set", "doc"), "set").groupBy("comp").agg(F.min("doc").alias("component_id"))
        out = self.nodes.select("set", "doc", "copies").join(comps.join(least, "comp").select("set", F.col("comp").alias("component"), "component_id"), "set", "left")
        n_links = F.col("copies") - 1
        if counted:
            others = within(self.members(), self.parts, self.percent, False).groupBy("set").agg(F.sum("others").alias("others"))
            out = out.join(others, "set", "left")
            n_links = n_links + F.coalesce("others", F.lit(0))
        component_id = F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("component_id"))
        return out.select("set", F.coalesce("component", "set").alias("component"), component_id.alias("component_id"), n_links.alias("n_links"))

    def link_counts(self) -> DataFrame:
        """(doc, n_links) per row: how many other rows it is linked with, copies of its own set included."""
        return self.classes(counted=True).select("doc", "n_links")

    def classes(self, counted: bool = False) -> DataFrame:
        """(doc, n, component_id) per row: the smallest document reachable by links; and n_links if counted."""
        columns = ["doc", "n", "component_id"] + ["n_links"] * counted
        named = self.scratch.put(self.by_set(counted), f"named-{int(counted)}")
        some = self.sets.filter("set is not null").join(named, "set").select(*columns)
        none = self.sets.filter("set is null").select("doc", "n", F.col("doc").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
        return some.unionByName(none.select(*columns))

    def others(self) -> tuple[DataFrame, DataFrame]:
        """What goes if one row of each component stays: (id_h, text_h) of rows that aren't it, and of those that stay but are there more than
        once; id_h is xxhash64 of the id. The one that stays has the least id (null last) and, of an id's texts, the least hash. Rows without
        words are in no component."""
        rows = self.sets.filter("set is not null").join(self.by_set(False).select("set", "component"), "set")
        rows = rows.groupBy("component", "doc", "text_h").agg(F.count("*").alias("rows"))
        rows = self.scratch.put(rows.select("component", F.struct(F.col("doc").isNull().alias("none"), "doc", "text_h").alias("row"), "rows"), "rows")
        least = self.scratch.put(rows.groupBy("component").agg(F.min("row").alias("first"), F.sum("rows").alias("n")).filter("n > 1"), "least")
        both = rows.join(least, "component").select(F.xxhash64("row.doc").alias("id_h"), "row.text_h", (F.col("row") == F.col("first")).alias("stays"), "rows")
        return both.filter("not stays").select("id_h", "text_h"), both.filter("stays and rows > 1").select("id_h", "text_h")


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, fragments: int = 8) -> JaccardJoin:
    """Links documents whose sets of k-word shingles have a Jaccard similarity of at least percent / 100.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text of fewer than k words has its whole sequence as one shingle; null
    texts and texts without words have an empty set, which links with nothing. Ids are integers. Repeated rows have equal sets and so link.
    Rows with a null id are documents that link others like any; a component's id is its least id that isn't null, and null if it has none. Ties don't
    arise. A very long text has one large set. An empty table gives empty results. Other columns are not read. Sets go by
    64-bit hashes of their shingles, and are told apart by 128 bits.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    described = scratch.put(describe(docs, id_col, text_col, k), "sets")
    rows = described.filter("kind = 0").select("doc", "text_h", "n", "set", "second", "bits")
    known = rows.filter("set is not null")
    # Different sets of one name: with N sets about N * N / 2 ** 65 of them.
    twice = [r.set for r in known.groupBy("set").agg(F.min("second").alias("x"), F.max("second").alias("y")).filter("x <> y").select("set").collect()]
    if twice:
        rows = rows.withColumn("set", F.when(F.col("set").isin(twice), F.col("second")).otherwise(F.col("set")))
    sets = rows.select("doc", "text_h", "n", "set")
    nodes = rows.filter("set is not null").groupBy("set").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies"))
    nodes = scratch.put(nodes, "nodes")
    order = Order.of(described.filter("kind = 1").select("chunk", "counts"), fragments)
    names = frozenset(twice)
    found = scratch.put(prefixes(docs, text_col, k, percent, order, names), "prefixes")
    ranged = found.repartitionByRange(partitions(spark), "gram", "own", "set").sortWithinPartitions("gram", "own", "set")
    near = scratch.put(ranged.mapInArrow(lambda batches: streamed(batches, percent), "open boolean, gram long, own long, set long, pivot_own long, pivot long, many boolean"), "near")
    scratch.drop("prefixes")

    def pairs_of(a: str, own_a: str, b: str, own_b: str) -> list[str]:
        return [f"least({a}, {b}) a", f"greatest({a}, {b}) b", f"{own_a} & 4294967295 n_a", f"{own_b} & 4294967295 n_b", f"{own_a} >> 32 pos_a", f"{own_b} >> 32 pos_b"]

    stars = near.filter("not open and set <> pivot").selectExpr(*pairs_of("set", "own", "pivot", "pivot_own"))
    # N-grams that go on over partitions, two of a task at most: their pivots meet the least of them.
    ends = near.filter("open").select("gram", "own", "set")
    ends = ends.join(ends.groupBy("gram").agg(F.min(F.struct("own", "set")).alias("p")), "gram").filter("set <> p.set")
    stars = stars.unionByName(ends.selectExpr(*pairs_of("set", "own", "p.set", "p.own")))
    stars = scratch.put(stars.filter(possible(percent)).select("a", "b").distinct(), "stars")

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def fetch(wanted: DataFrame, name: str, hint: list[str]) -> DataFrame:
        """The fragments of some sets, from the text of one document of each; of sets that only documents without an id have, from those."""
        docs_of = scratch.put(nodes.join(wanted, "set", "left_semi").select("set", "doc"), f"{name}-docs")
        chosen = docs_of.filter("doc is not null")
        found = fragments_of(texts.join(chosen.hint(*hint) if hint else chosen, "doc"), k, order, names)
        others = fragments_of(texts.filter("doc is null").withColumn("set", F.lit(None).cast("long")), k, order, names)
        others = others.join(docs_of.filter("doc is null").select("set"), "set", "left_semi").dropDuplicates(["set", "part"])
        return scratch.put(found.unionByName(others), f"{name}-parts")

    def bounded(pairs: DataFrame) -> DataFrame:
        side = lambda s: nodes.select(F.col("set").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(alike(percent)).select("a", "b")

    def compare(pairs: DataFrame, parts: DataFrame, name: str) -> DataFrame:
        """The pairs that are linked: overlaps by fragment, summed per pair."""
        a = parts.select(F.col("set").alias("a"), "part", F.col("n").alias("n_a"), F.col("grams").alias("of_a"))
        b = parts.select(F.col("set").alias("b"), "part", F.col("n").alias("n_b"), F.col("grams").alias("of_b"))
        both = pairs.select("a", "b").join(a, "a").join(b, ["b", "part"])
        partial = both.select("a", "b", "n_a", "n_b", "part", F.size(F.array_intersect("of_a", "of_b")).alias("overlap")).distinct()
        done = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("common")).filter(f"100 * common >= {percent} * (n_a + n_b - common)")
        return scratch.put(done.select("a", "b"), f"{name}-linked")

    ends_of = lambda pairs: pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    first = scratch.put(bounded(stars), "star-pairs")
    # How many are wanted has no bound, so both sides are dealt by document at every size.
    parts = fetch(ends_of(first), "star", ["merge"])
    links = compare(first, parts, "star")
    comps = components(scratch, links, "first")

    # Pairs that share a prefix n-gram and that the links so far leave apart
    apart = near.filter("not open and many").join(comps, F.col("set") == F.col("node"), "left").select("gram", "set", F.col("own").alias("place"), F.coalesce("comp", "set").alias("comp"))
    apart = scratch.put(apart, "apart")
    scratch.drop("near")
    mixed = apart.groupBy("gram").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).filter("x <> y").select("gram", "m")
    apart = apart.join(scratch.put(mixed, "mixed"), "gram").join(nodes.select("set", "bits"), "set")
    second = scratch.put(apart_pairs(apart, percent).join(stars, ["a", "b"], "left_anti"), "apart-pairs")
    scratch.drop("apart")
    scratch.drop("stars")
    parts = parts.unionByName(fetch(ends_of(second).join(ends_of(first), "set", "left_anti"), "apart", []))
    links = links.unionByName(compare(second, parts, "apart"))
    comps = components(scratch, links, "all")
    return JaccardJoin(sets, nodes, comps, parts, percent, scratch)
