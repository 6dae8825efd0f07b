"""Suffix-array dedup: bytes covered by a long string that also starts earlier in the corpus.

A window of `least` bytes belongs to the smallest hash of its k-byte strings, so equal windows, wherever they are, belong
together, and a run of windows with one owner is a segment. Owners are counted over all documents; most have one segment and
are done. Segments with equal bytes are collapsed first: all but the earliest are covered. What is left of an owner, segments
whose bytes differ but whose windows may be equal, goes to one shard; a suffix array of the shard by induced sorting
and its permuted common prefixes group equal windows, and all but the first of each group are covered. An owner whose segments have too many
bytes for a shard (the edge of a passage that very many documents hold) is split: its windows get owners anew, by another hash, which equal
windows share as before, and so on in rounds; each leaves an owner only a small part of what it had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import MULT, Scratch, bytes_of, mix, partitions, pieces_of, powers, tidy
from tidewater.llm.suffix import permuted_prefixes, suffix_array

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at a time, for the processor's caches.
PIECE = 1 << 17


class Hasher:
    def __init__(self):
        self.up, self.down = powers(PIECE + 4096, BASE), powers(PIECE + 4096, INVERSE)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(n + n // 4, BASE), powers(n + n // 4, INVERSE)

    def owners(self, data: np.ndarray, k: int, least: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the text's bytes by powers, a hash of each k-byte string, and each window's owner. turn: which of the hashes gives owners."""
        n = len(data)
        self.grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        grams = mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        if turn:
            grams = mix(grams + np.uint64(turn * int(MULT) & 0xFFFFFFFFFFFFFFFF))
        low, width, span = grams, 1, least - k + 1
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        return sums, grams, low

    def shared(self, data: np.ndarray, inside: np.ndarray, k: int, least: int, turn: int) -> np.ndarray:
        """Which windows, of those that begin inside, may have an equal one: their owner by this hash has another run of windows, or stands
        twice in its one run."""
        _, grams, low = self.owners(data, k, least, turn)
        at = np.flatnonzero(inside[: len(low)])
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]])]))
        start, stop = at[new], at[np.append(new[1:], len(at)) - 1] + 1
        _, which, count = np.unique(low[start], return_inverse=True, return_counts=True)
        once = np.flatnonzero(count[which] == 1)
        sizes = stop[once] - start[once] + least - k
        place = np.arange(sizes.sum()) + np.repeat(start[once] - np.cumsum(sizes) + sizes, sizes)
        alive = np.ones(len(start), bool)
        if len(once):
            alive[once] = np.add.reduceat(grams[place] == np.repeat(low[start[once]], sizes), np.cumsum(sizes) - sizes) > 1
        return at[np.repeat(alive, np.diff(np.append(new, len(at))))]

    def segments(self, data: np.ndarray, k: int, least: int, turn: int = 0) -> tuple[np.ndarray, ...]:
        """(owner, content, check, start, windows, repeats) of one text of at least `least` bytes. content and check are 128 bits of a hash of the
        segment's bytes that has nothing to do with the sums: those collide for made texts, which costs work elsewhere but here would lose text."""
        import xxhash

        _, grams, low = self.owners(data, k, least, turn)
        new = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        end = np.append(new[1:], len(low))
        owner = low[new]
        stop = end - 1 + least
        raw = memoryview(np.ascontiguousarray(data))
        two = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(new.tolist(), stop.tolist(), strict=True)]), np.int64).reshape(-1, 2)
        # windows of a segment can only be equal if its owner stands in it twice
        sizes = stop - k + 1 - new
        at = np.arange(sizes.sum()) + np.repeat(new - np.cumsum(sizes) + sizes, sizes)
        hits = np.add.reduceat(grams[at] == np.repeat(owner, sizes), np.cumsum(sizes) - sizes)
        return owner, two[:, 0], two[:, 1], new, end - new, hits > 1


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that neither is sent to every executor nor sends the other: segments of copies are so alike that a file of a few MB, by
    which Spark would choose, stands for hundreds in the driver's memory."""
    return df.hint("merge")


def segments_of(docs: DataFrame, id_col: str, text_col: str, k: int, least: int) -> DataFrame:
    """(owner, content, check, doc, start, windows, repeats) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in pieces_of(batches, 1, 8 << 20):
            data, at = bytes_of(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts, who = [], []
            for i in np.flatnonzero(np.diff(at) >= least):
                parts.append(hasher.segments(data[at[i] : at[i + 1]], k, least))
                who.append(np.full(len(parts[-1][0]), ids[i], np.int64))
            if parts:
                owner, content, check, start, windows, repeats = (np.concatenate(x) for x in zip(*parts, strict=True))
                out = [owner.view(np.int64), content, check, np.concatenate(who), start.astype(np.int32), windows.astype(np.int32), repeats]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["owner", "content", "check", "doc", "start", "windows", "repeats"])

    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "owner long, content long, check long, doc long, start int, windows int, repeats boolean")


def segments_again(pieces: DataFrame, k: int, least: int, turn: int) -> DataFrame:
    """(owner, content, check, doc, start, windows, repeats, piece) of pieces (doc, start, piece), by another hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in pieces_of(batches, 2, 1 << 20):
            rows = []
            for doc, start, piece in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                owner, content, check, new, windows, repeats = hasher.segments(np.frombuffer(piece, np.uint8), k, least, turn)
                cut = [piece[a : a + n + least - 1] for a, n in zip(new.tolist(), windows.tolist(), strict=True)]
                rows.append((owner.view(np.int64), content, check, np.full(len(new), doc, np.int64), (start + new).astype(np.int32), windows.astype(np.int32), repeats, cut))
            if rows:
                *arrays, cuts = zip(*rows, strict=True)
                out = [*(pa.array(np.concatenate(x)) for x in arrays), pa.array([c for cut in cuts for c in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["owner", "content", "check", "doc", "start", "windows", "repeats", "piece"])
        tidy()

    return pieces.select("doc", "start", "piece").mapInArrow(run, "owner long, content long, check long, doc long, start int, windows int, repeats boolean, piece binary")


def windows_by_content(rows: DataFrame, least: int) -> DataFrame:
    """(doc, a, b): the exact way for what no hash splits, such as a run of one byte that is longer than a shard. Each window goes by a
    128-bit hash of its own bytes; the first of each is found by partial aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def batch_of(hashes: list[bytes], docs: list[int], at: list[int]) -> pa.RecordBatch:
            two = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(docs, pa.int64()), pa.array(at, pa.int32())], ["h1", "h2", "doc", "at"])

        for batch in batches:
            for doc, start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for a in range(0, len(piece) - least + 1, 1 << 16):
                    some = range(a, min(a + (1 << 16), len(piece) - least + 1))
                    yield batch_of([xxhash.xxh3_128_digest(piece[j : j + least]) for j in some], [doc] * len(some), [start + j for j in some])
        tidy()

    windows = rows.select("doc", "start", "piece").mapInArrow(run, "h1 long, h2 long, doc long, at int")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = spread(windows).join(spread(first), ["h1", "h2"]).filter("struct(doc, at) <> first")
    return later.select("doc", F.col("at").alias("a"), (F.col("at") + least).alias("b"))


def covered_in_shards(least: int, k: int, shard_bytes: int):
    """Per partition, sorted by owner: (doc, a, b) of windows that an earlier one of their shard equals. Shards end between owners. Most windows
    of segments that differ equal no other: those whose owner by two more hashes nothing shares aren't sorted."""

    def reduced(hasher: Hasher, doc: np.ndarray, start: np.ndarray, pieces: list[bytes], turn: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The parts of pieces whose windows may have an equal one."""
        sizes = np.array([len(p) for p in pieces])
        at = np.cumsum(sizes + 1) - sizes - 1
        whole = b"\0".join(pieces) + b"\0"
        n = sizes - least + 1
        inside = np.zeros(len(whole), bool)
        inside[np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = True
        alive = hasher.shared(np.frombuffer(whole, np.uint8), inside, k, least, turn)
        if not len(alive):
            return doc[:0], start[:0], []
        # windows of one piece whose bytes overlap or touch are one part
        new = np.flatnonzero(np.concatenate([[True], alive[1:] > alive[:-1] + least]))
        a, b = alive[new], alive[np.append(new[1:], len(alive)) - 1] + least
        piece = np.searchsorted(at, a, "right") - 1
        return doc[piece], start[piece] + a - at[piece], [whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]

    def solve(hasher: Hasher, doc: np.ndarray, start: np.ndarray, pieces: list[bytes]) -> pa.RecordBatch | None:
        by = np.lexsort((start, doc))  # a place in the shard's text then is a place in the order of (document, start)
        doc, start, pieces = doc[by], start[by], [pieces[i] for i in by]
        for turn in (-1, -2):
            doc, start, pieces = reduced(hasher, doc, start, pieces, turn)
            if not pieces:
                return None
        sizes = np.array([len(p) for p in pieces])
        at = np.cumsum(sizes + 1) - sizes - 1
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        text = data.astype(np.uint16) + 1
        text[at + sizes] = 0
        inside = np.zeros(len(text), bool)
        n = sizes - least + 1
        offsets = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        inside[offsets] = True
        sa = suffix_array(text)
        prefix = permuted_prefixes(data, sa, least, inside)
        order = sa[inside[sa]]
        group = np.cumsum(prefix[order] < least) - 1
        firsts = np.full(group[-1] + 1, len(text))
        np.minimum.at(firsts, group, order)
        later = np.sort(order[order != firsts[group]])
        if not len(later):
            return None
        seg = np.searchsorted(at, later, "right") - 1
        new = np.concatenate([[True], (later[1:] != later[:-1] + 1) | (seg[1:] != seg[:-1])])
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(later)) - 1
        seg = seg[first]
        a, b = later[first] - at[seg] + start[seg], later[last] - at[seg] + start[seg] + least
        return pa.RecordBatch.from_arrays([pa.array(doc[seg]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        owners, docs, starts, pieces, size = [], [], [], [], 0
        for batch in batches:
            for owner, doc, start, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size > shard_bytes and owner != owners[-1]:
                    if (found := solve(hasher, np.array(docs), np.array(starts), pieces)) is not None:
                        yield found
                    owners, docs, starts, pieces, size = [], [], [], [], 0
                owners.append(owner)
                docs.append(doc)
                starts.append(start)
                pieces.append(piece)
                size += len(piece)
        if pieces and (found := solve(hasher, np.array(docs), np.array(starts), pieces)) is not None:
            yield found
        tidy()

    return run


def settled(found: DataFrame, scratch: Scratch, name: str, least: int, owner_bytes: int, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Of a table of segments: the spans (doc, a, b) of all but the earliest of equal ones, and of owners with segments that differ (owner, hot,
    doc, start, piece) of each; hot: they have more than owner_bytes together."""
    owners = found.groupBy("owner").agg(F.count("*").alias("n"), F.min("content").alias("x"), F.max("content").alias("y"), F.min("check").alias("z"), F.max("check").alias("w"), F.max("repeats").alias("repeats"))
    owners = scratch.put(owners.filter("n > 1 or repeats").select("owner", (F.expr("x <> y or z <> w") | F.col("repeats")).alias("differ")), f"{name}-owners")
    some = scratch.put(spread(found.drop("repeats")).join(spread(owners), "owner"), f"{name}-some")
    scratch.drop(f"{name}-segments")
    where = F.struct("doc", "start", "windows", *[c for c in found.columns if c == "piece"])
    first = scratch.put(some.groupBy("owner", "content", "check", "differ").agg(F.min(where).alias("first"), F.count("*").alias("n")), f"{name}-first")
    earliest = first.filter("n > 1").select("owner", "content", "check", "first.doc", "first.start").toDF("owner", "content", "check", "d", "s")
    copies = spread(some.drop("piece")).join(spread(earliest), ["owner", "content", "check"]).filter("doc <> d or start <> s")
    spans = scratch.put(copies.select("doc", F.col("start").alias("a"), (F.col("start") + F.col("windows") + (least - 1)).alias("b")), f"{name}-copies")
    scratch.drop(f"{name}-some")
    differ = first.filter("differ").select("owner", "first.*")
    many = differ.groupBy("owner").agg(F.sum(F.col("windows") + (least - 1)).alias("bytes"))
    pieces = fetch(spread(differ).join(spread(many), "owner").withColumn("hot", F.col("bytes") > owner_bytes).drop("bytes"))
    pieces = scratch.put(pieces.select("owner", "hot", "doc", "start", "piece"), f"{name}-pieces")
    scratch.drop(f"{name}-first")
    return spans, pieces


def covered_spans(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", least: int = 100, k: int = 32, shard_bytes: int = 1 << 20, owner_bytes: int = 1 << 18, turns: int = 6) -> DataFrame:
    """(doc, a, b): byte spans, possibly overlapping, that strings of `least` bytes that also start earlier cover. An owner of more than
    owner_bytes is split by other hashes, `turns` times at most; what is left then goes by its windows' own bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1, 8 << 20):
            rows = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows += [(w["owner"], w["hot"], doc, w["start"], text[w["start"] : w["start"] + w["windows"] + least - 1]) for w in wanted]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["owner", "hot", "doc", "start", "piece"])

    def from_texts(wanted: DataFrame) -> DataFrame:
        wanted = scratch.put(wanted.groupBy("doc").agg(F.collect_list(F.struct("owner", "hot", "start", "windows")).alias("wanted")), "wanted")
        texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        texts = spread(texts).join(spread(wanted), "doc").dropDuplicates(["doc"])
        return texts.mapInArrow(cut, "owner long, hot boolean, doc long, start int, piece binary")

    found = scratch.put(segments_of(docs, id_col, text_col, k, least), "0-segments")
    spans, pieces = settled(found, scratch, "0", least, owner_bytes, from_texts)
    scratch.drop("wanted")
    cold, hot = pieces.filter("not hot"), pieces.filter("hot")
    for turn in range(1, turns + 1):
        if hot.isEmpty():
            break
        found = scratch.put(segments_again(hot, k, least, turn), f"{turn}-segments")
        more, pieces = settled(found, scratch, f"{turn}", least, owner_bytes, lambda wanted: wanted)
        spans, cold, hot = spans.unionByName(more), cold.unionByName(pieces.filter("not hot")), pieces.filter("hot")
    ranged = cold.select("owner", "doc", "start", "piece").repartition(partitions(docs.sparkSession), "owner").sortWithinPartitions("owner")
    shards = ranged.mapInArrow(covered_in_shards(least, k, shard_bytes), "doc long, a int, b int")
    return spans.unionByName(shards).unionByName(windows_by_content(hot, least))


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 100) -> DataFrame:
    """(id, n_bytes, n_removed, removed, kept) per row: removed is an array of maximal byte spans, kept the bytes that are left.

    A byte goes if a string of `least` bytes that covers it also starts earlier, in a smaller id or before in the same
    text; strings are judged on the input and never cross documents. Null texts count as empty; texts shorter than `least` stay;
    ids are integers; rows of one id count as one document (and ought to be equal); rows with a null id stay whole; an empty
    table gives none; other columns are not read. Bytes that are left may cut characters, so kept is binary.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    spans = covered_spans(docs, scratch, id_col=id_col, text_col=text_col, least=least)
    spans = scratch.put(spans.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    for turn in range(8):
        for name in ("pieces", "copies", "owners"):
            scratch.drop(f"{turn}-{name}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = spread(rows).join(spread(spans), F.col("id") == F.col("doc"), "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1, 8 << 20):
            sizes, gone, removed, kept = [], [], [], []
            for text, spans in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), len(text)]
                sizes.append(len(text))
                gone.append(sum(b - a for a, b in merged))
                removed.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "removed", "kept"])

    out = rows.mapInArrow(run, "id long, n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "removed", "kept")
