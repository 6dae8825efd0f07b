"""Phrase collocation mining: phrases whose words stand together far more often than each does alone.

First passes, one for each number of words from one to `most_words`: every task counts the cells of its n-grams in the rows of a count-min sketch; the
tasks' counts are merged slice by slice, and of each slice only a bitmap stays: the cells that reach `least`. The sketch never counts too few, so an n-gram
with a cell below `least` in any row is rare. An n-gram that holds a rare one is rare, and isn't sent. Last pass: n-grams that no sketch rules out are counted exactly, each task's as sorted,
packed blocks by a hash of language and phrase, which meet and are summed. Those that are frequent are scored by their weakest cut, give way to longer ones that hold most of them, and are ranked by language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import LOWER, MULT, Scratch, bytes_of, flat_binary, hash_spans, mix, partitions, pieces_of, shuffles_dropped, tidy, word_spans

#: Bytes between pieces, and between words: [.,;:!?\x0A-\x0D] and [\x20\x09].
BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
GAPS = BREAKS.copy()
GAPS[[9, 32]] = True
#: Bits of a cell's number within its slice; rows of the sketch; cells that a task holds before it sends them.
SLICE, ROWS, HELD = 16, 2, 1 << 23
#: Bytes of text whose n-grams are counted at a time; of counts that a task gathers before it sums them; of text for each part in which they meet, at most.
STRETCH, GATHERED, PART = 4 << 20, 48 << 20, 32 << 20


@dataclass
class Grams:
    """The words of some documents and which n-grams begin at each."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    lang: np.ndarray  # of each word, as a place among the batch's languages
    words: np.ndarray  # hashes, different for each language
    together: list[np.ndarray]  # [n]: words at which n + 1 words of one piece begin

    def hashes(self) -> Iterator[tuple[int, np.ndarray]]:
        """(n, hashes of the n-grams that begin at the words of together[n - 1])."""
        rolled = self.words
        for n, at in enumerate(self.together, 1):
            if n > 1:
                rolled = mix(rolled[: len(self.words) - n + 1] * MULT + self.words[n - 1 :])
            yield n, rolled[at]


def grams(batch: pa.RecordBatch, names: list[str], most_words: int) -> Grams:
    """Of a batch (lang, text); names: the batch's languages in the order of their codes."""
    data, offsets = bytes_of(batch.column(1))
    starts, ends = word_spans(data, offsets, GAPS)
    of = np.searchsorted(offsets, starts, "right") - 1
    codes = batch.column(0).to_numpy(zero_copy_only=False)[of] if len(of) else np.zeros(0, np.int32)
    raw = [np.frombuffer(x.encode(), np.uint8) for x in names]
    sizes = np.array([len(x) for x in raw], np.int64)
    whole = np.concatenate([*raw, np.zeros(0, np.uint8)])
    salts = hash_spans(whole, np.cumsum(sizes) - sizes, sizes, False)[0] if len(whole) else np.zeros(len(raw), np.uint64)
    lengths = ends - starts
    words = mix(hash_spans(data, starts, lengths)[0] * MULT + salts[codes]) if len(starts) else np.zeros(0, np.uint64)
    # the next word is of the same piece: no break between, and the same document
    breaks = np.cumsum(BREAKS[data], dtype=np.int64)
    near = (breaks[starts[1:]] == breaks[ends[:-1] - 1]) & (of[1:] == of[:-1]) if len(starts) > 1 else np.zeros(0, bool)
    together, ok = [np.arange(len(starts))], np.ones(len(starts), bool)
    for n in range(1, most_words):
        ok = ok[:-1] & near[n - 1 :] if len(ok) else ok
        together.append(np.flatnonzero(ok))
    return Grams(data, starts, lengths, codes, words, together)


def with_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Stretches (code of the language, text) and their languages."""
    for batch in pieces_of(batches, 1, STRETCH):
        if batch.num_rows:
            named = pc.dictionary_encode(batch.column(0))
            yield pa.RecordBatch.from_arrays([named.indices, batch.column(1)], ["lang", "text"]), named.dictionary.to_pylist()


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """An n-gram's cell in a row of the sketch."""
    return (mix(hashes + np.uint64(row) * MULT) >> np.uint64(64 - bits)).astype(np.uint32)


def passes(hashes: np.ndarray, bits: int, bitmaps: list[np.ndarray]) -> np.ndarray:
    """Which n-grams no row of a sketch rules out."""
    ok = np.ones(len(hashes), bool)
    for row in range(ROWS):
        at = cells(hashes[ok], row, bits)
        ok[ok] = (bitmaps[row][at >> np.uint32(3)] >> (np.uint32(7) - (at & np.uint32(7))).astype(np.uint8)) & np.uint8(1) > 0
    return ok


def sketch(texts: DataFrame, bits: int, least: int, shorter: list[tuple]) -> DataFrame:
    """(row, slice, bits): which cells of a slice of a row reach `least`, over all n-grams of one number of words in all texts. shorter: the bits and
    broadcast bitmaps of the sketches of one word, two, and so on to one word less; n-grams that hold one that they rule out are rare, and aren't sent.

    A task sends its cells as steps in ascending order; a cell that it meets more than `least` times is sent so often, which is enough."""

    def send(held: list[np.ndarray], row: int) -> Iterator[pa.RecordBatch]:
        own = np.sort(np.concatenate(held))
        more = np.zeros(len(own), bool)
        more[least:] = own[least:] == own[: max(len(own) - least, 0)]
        own = own[~more]
        part = own >> np.uint32(SLICE)
        at = np.flatnonzero(np.diff(part, prepend=part[0] ^ 1))
        codec = pa.Codec("zstd", 1)
        data = []
        for x in np.split((own & np.uint32((1 << SLICE) - 1)).astype(np.uint16), at[1:]):
            steps = np.diff(x, prepend=np.uint16(0))
            data.append(len(x).to_bytes(4, "little") + codec.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 2).T).tobytes(), asbytes=True))
        for i in range(0, len(at), 1024):
            some = at[i : i + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row, np.int32)), pa.array(part[some].astype(np.int32)), pa.array(data[i : i + 1024], pa.binary())], ["row", "slice", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        n = 0
        for batch, names in with_codes(batches):
            own = grams(batch, names, len(shorter) + 1)
            for k, h in own.hashes():
                if k > 1:
                    h, at = h[ok := frequent[at := own.together[k - 1]] & frequent[at + 1]], at[ok]
                else:
                    at = own.together[0]
                if k <= len(shorter):
                    frequent = np.zeros(len(own.starts), bool)  # the n-grams of k words that begin here
                    frequent[at[passes(h, shorter[k - 1][0], shorter[k - 1][1].value)]] = True
            for row in range(ROWS):
                held[row].append(cells(h, row, bits))
            n += len(h)
            if n >= HELD:
                for row in range(ROWS):
                    yield from send(held[row], row)
                    held[row] = []
                n = 0
        if n:
            for row in range(ROWS):
                yield from send(held[row], row)
        tidy()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        key, counts, waiting, n = None, np.zeros(1 << SLICE, np.int64), [], 0

        def add() -> None:
            nonlocal n
            if waiting:
                counts[:] += np.bincount(np.concatenate(waiting), minlength=1 << SLICE)
                waiting.clear()
                n = 0

        def full() -> pa.RecordBatch:
            add()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], ["row", "slice", "bits"])

        for batch in batches:
            for row, part, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != (row, part):
                    if key is not None:
                        yield full()
                    key, counts[:] = (row, part), 0
                size = int.from_bytes(data[:4], "little")
                flat = np.frombuffer(codec.decompress(data[4:], decompressed_size=2 * size, asbytes=True), np.uint8)
                waiting.append(np.cumsum(np.ascontiguousarray(flat.reshape(2, -1).T).view(np.uint16)[:, 0], dtype=np.int32))
                n += size
                if n > 1 << 19:
                    add()
        if key is not None:
            yield full()

    sent = texts.mapInArrow(run, "row int, slice int, cells binary")
    dealt = sent.repartition(partitions(texts.sparkSession), "row", "slice").sortWithinPartitions("row", "slice")
    return dealt.mapInArrow(merge, "row int, slice int, bits binary")


def counted(texts: DataFrame, sketches: list[tuple], least: int, size: int) -> DataFrame:
    """(lang, phrase, words, f): exact counts, over all texts, of the n-grams that occur `least` times; with 0 words, of all words. sketches: bits and
    broadcast bitmaps, by the number of words; n-grams that one rules out are rare. size: the texts' bytes.

    A task sums what it meets by language and phrase, and sends sorted blocks: rows of the same counts took 3.6 times the disk on 0.5 GB."""
    shuffled = partitions(texts.sparkSession)
    parts = shuffled * -(-size // (shuffled * PART) or 1)
    may = lambda hashes, n: passes(hashes, sketches[n - 1][0], sketches[n - 1][1].value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for batch, names in with_codes(batches):
            for keys, n in counts_of(batch, names, len(sketches), may):
                held.add(keys, n)
            if held.sums >= GATHERED:
                yield from blocks(held, parts)
                held = Tally()
        yield from blocks(held, parts)
        del held
        tidy()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, Tally()
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != key:
                    yield from held.frequent(least)
                    key, held = part, Tally()
                held.add(*unpacked(data.as_buffer()))
        yield from held.frequent(least)
        del held
        tidy()

    sent = texts.mapInArrow(run, "part int, counts binary")
    dealt = sent.repartitionById(shuffled, F.col("part") % shuffled).sortWithinPartitions("part")
    return dealt.mapInArrow(merge, "lang string, phrase string, words int, f long")


def counts_of(batch: pa.RecordBatch, names: list[str], most_words: int, may) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(keys, counts) of a batch's languages and of its n-grams that may be frequent, by the number of words. A key is the language, a line feed and the
    phrase, which has none; a language's own key has no phrase, and counts its words."""
    import pandas as pd

    own = grams(batch, names, most_words)
    of = pa.array(names, pa.string())
    keyed = lambda lang, phrase: pc.binary_join_element_wise(of.take(pa.array(lang)), phrase, "\n")
    yield keyed(np.arange(len(names)), pa.array([""] * len(names), pa.string())), np.bincount(own.lang, minlength=len(names))
    frequent = np.zeros(len(own.starts), bool)  # the n-grams of one word less that begin here,
    rank = np.zeros(len(own.starts), np.int64)  # and their places among the distinct
    word, words, spelled = rank, None, None
    for n, hashes in own.hashes():
        at = own.together[n - 1]
        if n == 1:
            ok = may(hashes, n)
            keys = hashes[ok]
        else:  # both shorter ones within are frequent too
            ok = frequent[at] & frequent[at + 1]
            ok[ok] = may(hashes[ok], n)
            keys = rank[at[ok]] << 32 | word[at[ok] + n - 1]  # exact: the shorter one's place and the last word's
        at = at[ok]
        rank_of, distinct = pd.factorize(keys)
        first = np.empty(len(distinct), np.int64)
        first[rank_of[::-1]] = at[::-1]
        if n == 1:
            spelled = words = texts_of(own, first)
        else:
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(distinct >> 32)), words.take(pa.array(distinct & 0xFFFFFFFF)), " ")
        frequent[:] = False
        frequent[at] = True
        rank = np.zeros(len(own.starts), np.int64)
        rank[at] = rank_of
        if n == 1:
            word = rank
        yield keyed(own.lang[first], spelled), np.bincount(rank_of, minlength=len(distinct))


class Tally:
    """Sums of counts by key. They are summed whenever the gathered ones have `GATHERED` bytes and as many as the sums, so it holds about twice the distinct keys."""

    def __init__(self) -> None:
        self.tables: list[pa.Table] = []  # the first has each key once
        self.sums = self.more = 0  # bytes of the sums and of what isn't summed yet

    def add(self, keys: pa.Array, n: np.ndarray) -> None:
        self.tables.append(pa.table({"key": keys, "n": pa.array(n, pa.int64())}))
        self.more += self.tables[-1].nbytes
        if self.more >= max(GATHERED, self.sums):
            self.table()

    def table(self) -> pa.Table:
        """(key, n): each key once."""
        if self.more:
            whole = pa.concat_tables(self.tables).group_by("key", use_threads=False).aggregate([("n", "sum")])
            self.tables = [whole.select(["key", "n_sum"]).rename_columns(["key", "n"])]
            self.sums, self.more = self.tables[0].nbytes, 0
        return self.tables[0] if self.tables else pa.table({"key": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

    def frequent(self, least: int) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, words, f) of the phrases that occur `least` times and, with 0 words, of the languages."""
        for batch in self.table().to_batches(max_chunksize=1 << 16):
            apart = pc.split_pattern(batch.column(0), "\n", max_splits=1, reverse=True)
            lang, phrase = pc.list_element(apart, 0), pc.list_element(apart, 1)
            words = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
            some = pa.RecordBatch.from_arrays([lang, phrase, words, batch.column(1)], ["lang", "phrase", "words", "f"])
            yield some.filter(pc.or_(pc.greater_equal(some["f"], least), pc.equal(words, 0)))


def blocks(held: Tally, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, counts): the sums, packed in ascending order of their keys; a key's hash gives its part."""
    table = held.table()
    if not table.num_rows:
        return
    keys, n = table["key"].combine_chunks(), table["n"].to_numpy()
    data, offsets = flat_binary(keys)
    part = (hash_spans(data, offsets[:-1], np.diff(offsets), False)[0] % np.uint64(parts)).astype(np.int32)
    order = pc.sort_indices(keys).to_numpy()
    order = order[np.argsort(part[order], kind="stable")]
    keys, n, part = keys.take(pa.array(order)), n[order], part[order]
    at = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    for i in range(0, len(at) - 1, 1024):
        some = at[i : i + 1025]
        data = [packed(keys[j:k], n[j:k]) for j, k in zip(some[:-1], some[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[some[:-1]]), pa.array(data, pa.binary())], ["part", "counts"])


def packed(keys: pa.Array, n: np.ndarray) -> bytes:
    """Keys and counts: the lengths' and counts' bytes, the lowest of all first, then the keys'."""
    data, offsets = flat_binary(keys)
    numbers = np.stack([np.diff(offsets), n]).astype("<i8")
    raw = np.ascontiguousarray(numbers.view(np.uint8).reshape(2, len(n), 8).transpose(0, 2, 1)).tobytes() + data.tobytes()
    return len(n).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpacked(data: pa.Buffer) -> tuple[pa.Array, np.ndarray]:
    m, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
    flat = np.frombuffer(pa.Codec("zstd").decompress(data[12:], decompressed_size=size), np.uint8)
    numbers = np.ascontiguousarray(flat[: 16 * m].reshape(2, 8, m).transpose(0, 2, 1)).view("<i8")[:, :, 0]
    offsets = np.concatenate([[0], np.cumsum(numbers[0])]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), m, [None, pa.py_buffer(offsets), pa.py_buffer(flat[16 * m :])]), numbers[1]


def texts_of(own: Grams, at: np.ndarray) -> pa.Array:
    """The words at some places, with A-Z lower-cased."""
    lengths = own.lengths[at]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.repeat(own.starts[at] - offsets[:-1], lengths) + np.arange(offsets[-1])
    data = LOWER[own.data[flat]] if len(flat) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def bitmaps_of(found: DataFrame, bits: int) -> list[np.ndarray]:
    """A sketch's rows as bitmaps, of 2**(bits - 3) bytes each."""
    filled = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
    width = 1 << (SLICE - 3)
    for batch in found.toArrow().to_batches():
        for row, part, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            filled[row][part * width : (part + 1) * width] = np.frombuffer(data, np.uint8)
    return filled


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly: in decimals of 38 digits, for counts up to 10**16."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right)).cast("long")


def collocations(
    docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", most_words: int = 3, least: int = 10, held: int = 50, top: int = 2000, most_bits: int = 29
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `most_words` words that occur at least `least` times.

    Texts are lower-cased (A-Z only) and split at [.,;:!?\\x0A-\\x0D] into pieces and those at [\\x20\\x09] into words; phrases stay within
    pieces; all counts are by language (null: `und`). a: how often the phrase occurs; cut after its first k words, its parts occur l and r times, and
    its score is floor(1000000 * a * a / (l * r)); its lowest cut counts (ties: smallest k). A phrase goes if one of one word more, `least` times there,
    holds it and 100 * f(longer) >= `held` * a (still longer ones occur no more often). n: the language's words. Rank: score and a descending, phrase ascending.

    Null and empty texts have no words; a very long text is a stretch of its own; repeated rows count each; an empty table, or one
    without frequent phrases, gives none; other columns, whatever their names, are not read. A sketch has about half as many cells as there are words, two to the `most_bits - 1`-th
    power at most and 2**16 at least (32 MB a row as bits, the size of what is broadcast), that of single words a quarter of it; with more n-grams for each cell it rules out fewer, and the last pass counts more: no result changes. Distinct words of over 8 bytes
    are told apart by 64-bit hashes within 4 MB of text, all else by their bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # about two n-grams a cell, with six bytes for a word and what follows it; words repeat more, so they have fewer
    bits_for = lambda n: max(min((size // 12).bit_length(), most_bits - 1, 32) - 2 * (n == 1), SLICE)
    sketches: list[tuple] = []
    with shuffles_dropped(spark):
        for n in range(1, most_words + 1):
            found = scratch.put(sketch(texts, bits_for(n), least, sketches), f"sketch-{n}")
            sketches.append((bits_for(n), spark.sparkContext.broadcast(bitmaps_of(found, bits_for(n)))))
        counts = scratch.put(counted(texts, sketches, least, size), "counts")
    for _, bitmaps in sketches:  # files on the disks of the driver and of every executor, which no later plan reads
        bitmaps.destroy()
    totals = counts.filter("words = 0").select(F.col("lang").alias("lang_n"), F.col("f").alias("n"))
    ranked = best(counts.filter("words > 0"), most_words, held, top)
    return ranked.join(totals, F.col("lang") == F.col("lang_n")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best(counts: DataFrame, most_words: int, held: int, top: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, score) from exact counts (lang, phrase, words, f) of all frequent n-grams."""
    part = lambda first, n: F.array_join(F.slice("parts", first, n), " ")
    phrases = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("parts"))
    # every cut of a phrase asks for the counts of its two parts, which are at least as frequent
    ways = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.col("words") - k).alias("right")))
    cuts = phrases.select("lang", "phrase", "a", F.explode(ways).alias("cut")).select("lang", "phrase", "a", "cut.*")
    of = lambda side, n: counts.select(F.col("lang").alias(f"lang_{side}"), F.col("phrase").alias(f"phrase_{side}"), F.col("f").alias(n))
    cuts = cuts.join(of("l", "l"), (F.col("lang") == F.col("lang_l")) & (F.col("left") == F.col("phrase_l")))
    cuts = cuts.join(of("r", "r"), (F.col("lang") == F.col("lang_r")) & (F.col("right") == F.col("phrase_r")))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    # what a phrase of one word more takes of the two that it holds
    inner = phrases.filter("words > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("within"))
    longer = inner.groupBy(F.col("lang").alias("lang_w"), "within").agg(F.max("a").alias("longer"))
    left = lowest.join(longer, (F.col("lang") == F.col("lang_w")) & (F.col("phrase") == F.col("within")) & (100 * F.col("longer") >= held * F.col("a")), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = left.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(partitions(counts.sparkSession))))
    # the best of each of many parts of a language first, so that no language is ranked whole in one task
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("salt")
