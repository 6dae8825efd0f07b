"""Mixing sources to target weights, with DataFrame functions alone.

Each source's words are packed, document after document, into blocks of one fixed length. Its target gives it slots; each
slot draws its output shard at random, so a shard's counts by source are multinomial given the sources' totals, which are fixed so
that the targets are met. Slot j of a source goes through a pseudorandom permutation of the source's block indices (swap-or-not, one
key per pass over the source), so a pass takes each block once, and blocks are joined to slots by index. What a slot takes of a document
is counted there, and the document's words are then cut for all its slots at once, so that each text is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, partitions

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space behind it.
SPACED = WORD + r"[\x20\x09-\x0D]*"
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, rank, source_size, target): sources by code point, null last, share all words by weight; a target stops at
    `most` times the source's size and the excess is shared again. One row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * most).cast("double")
    rows = by_source.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weigh = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level at which the first source in order of cap / weight isn't stopped.
    rows = rows.withColumn("level", F.greatest(left / weigh, F.lit(0.0)))
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every), F.lit(0.0))
    return rows.select("source", "rank", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def permuted(df: DataFrame, index: str, n: str, keys: list[str], seed: int, rounds: int, back: bool = False) -> DataFrame:
    """Replaces index by its image under a pseudorandom permutation of [0, n) for each value of the keys (swap-or-not). back: by what
    it is the image of; each round undoes itself."""
    keyed = F.xxhash64(F.lit(seed), *keys)

    def turn(i: Column, r: Column) -> Column:
        # F.transform over one element names the partner, so that it is computed once
        other = F.array(F.pmod(F.pmod(F.xxhash64(keyed, r), n) - i, n))
        swap = lambda j: F.when(F.xxhash64(r, keyed, F.greatest(i, j)).bitwiseAND(F.lit(1)) == 1, j).otherwise(i)
        return F.element_at(F.transform(other, swap), 1)

    order = (rounds, 1) if back else (1, rounds)
    return df.withColumn(index, F.aggregate(F.sequence(*map(F.lit, order)), F.col(index), turn))


def ranges() -> Column:
    """A document's pieces, one per block: the block, the document's word that it begins with, its place in the block and its number of words."""
    start, size, length = F.col("start"), F.col("size"), F.col("length")

    def piece(block: Column) -> Column:
        first = F.greatest(block * length - start, F.lit(0))
        n = F.least((block + 1) * length - start, size) - first
        return F.struct(block.alias("block"), first.alias("first"), (start + first - block * length).alias("at"), n.alias("words"))

    return F.transform(F.sequence(F.expr("start div length"), F.expr("(start + size - 1) div length")), piece)


class Mixture:
    """documents: per row of the input its columns id, size, source_size, target and taken. slots: (shard, rank, slot, pass,
    block, words): which block of which source each slot of an output shard takes, and how many of its first words.
    sources: (source, rank, source_size, target, length, n_blocks, words). blocks: (rank, block, id, start, first, at, words):
    the words of a document that stand in a block, from its word `first` on, at the block's word `at`; start is the document's
    place in its source. shards: slots joined to their words, (shard, rank, slot, pass, block, id, start, first, at, words, text), a row per
    document of a slot, in the session's shared folder."""

    def __init__(self, documents: DataFrame, slots: DataFrame, sources: DataFrame, blocks: DataFrame, shards: DataFrame):
        self.documents, self.slots, self.sources, self.blocks, self.shards = documents, slots, sources, blocks, shards

    def texts(self) -> DataFrame:
        """(shard, rank, slot, text): each slot's words with the white space of their documents, and a line's end between two documents."""
        parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"])
        return self.shards.groupBy("shard", "rank", "slot").agg(F.array_join(parts, "\n").alias("text"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, length: int = 64, per_shard: int = 8192, per_chunk: int = 500, seed: int = 17, rounds: int = 12) -> Mixture:
    """Takes words of all documents until each source comes to its target, rounded to a word; see Mixture.

    length: words of a block; only a source's last block may have fewer. A document's size is its count of [^\\x20\\x09-\\x0D]+; null or
    empty texts have size 0 and nothing taken. A null source is a source, the last; null ids are ids. Repeated rows are documents of their own; rows
    that tie (equal id and text) take places next to each other, in either order. A very long text is packed into many blocks. An
    empty table, or one without words, gives targets of 0. Other columns are not read. The seed fixes every draw, so reruns agree.
    per_chunk: documents, about, of one source whose places are summed up together.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    texts = docs.select(F.xxhash64(id_col).alias("id_h"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sizes = scratch.put(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("h")), "sizes")
    n_rows = sizes.count()
    sources = targets(sizes, weights, most).withColumn("length", F.lit(length).cast("long"))
    sources = sources.withColumn("n_blocks", F.expr("(source_size + length - 1) div length"))
    sources = sources.withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * most))
    # Whole passes over the source, then blocks of one more pass, then the first words of one more block. Where the source's last,
    # shorter block is among them, the slots behind it make up for what it lacks.
    some = F.col("source_size") > 0
    sources = sources.withColumn("pass", F.when(some, F.expr("words div source_size")).otherwise(F.lit(0).cast("long")))
    sources = sources.withColumn("rest", F.when(some, F.expr("words % source_size")).otherwise(F.lit(0).cast("long")))
    sources = sources.withColumn("lacks", F.expr("n_blocks * length - source_size")).withColumn("short_at", F.col("n_blocks") - 1)
    sources = permuted(sources.withColumn("n_blocks", F.greatest("n_blocks", F.lit(1).cast("long"))), "short_at", "n_blocks", ["rank", "pass"], seed + 2, rounds, back=True)
    sources = sources.withColumn("rest", F.expr("rest + if(lacks > 0 and least(rest - short_at * length, length) > length - lacks, lacks, 0)"))
    sources = sources.withColumn("part", F.expr("rest % length"))
    sources = sources.withColumn("n_slots", F.expr("pass * n_blocks + rest div length + if(part > 0, 1, 0)"))
    sources = scratch.put(sources, "sources")

    # Each document's place in its source: chunks of a bounded number of rows are summed, then the rows within each.
    n_chunks = max(1, -(-n_rows // per_chunk))
    own = sources.select("source", "rank", "source_size", "length", "n_slots")
    both = sizes.join(own, sizes["source"].eqNullSafe(own["source"])).drop(own["source"])
    # Rows without words take no place, and texts tell null ids apart, so neither makes a chunk large.
    dealt = both.filter("size > 0").withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "id", "h"), F.lit(n_chunks)))
    sums = dealt.groupBy("rank", "chunk", "source_size", "n_slots").agg(F.sum("size").alias("in_chunk"))
    base = F.sum("in_chunk").over(Window.partitionBy("rank").orderBy("chunk")) - F.col("in_chunk")
    chunks = scratch.put(sums.withColumn("base", base), "chunks")
    within = Window.partitionBy("rank", "chunk").orderBy("id", "size", "h").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("upto", F.sum("size").over(within)).join(chunks.select("rank", "chunk", "base"), ["rank", "chunk"])
    placed = scratch.put(placed.withColumn("start", F.expr("base + upto - size")).select("id", "h", "rank", "size", "start", "length"), "placed")
    blocks = placed.select("rank", "id", "h", "start", F.explode(ranges()).alias("p")).select("rank", "p.block", "id", "h", "start", "p.first", "p.at", "p.words")

    # Slots: each chunk makes its share of its source's slot numbers.
    upto = lambda at: F.floor(F.col("n_slots") * (at / F.col("source_size"))).cast("long")
    some = chunks.filter("in_chunk > 0 and n_slots > 0").withColumn("lo", upto(F.col("base"))).withColumn("hi", upto(F.col("base") + F.col("in_chunk")))
    # The table of chunks is small and so is read by one task; what it makes is dealt out before.
    some = some.filter("hi > lo").repartition(partitions(spark), "rank", "chunk")
    slots = some.select("rank", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("slot"))
    slots = slots.join(sources.select("rank", "n_blocks", "n_slots", "length", "part"), "rank")
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    slots = slots.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "rank", "slot"), F.lit(max(1, -(-total // per_shard)))))
    slots = slots.withColumn("pass", F.expr("slot div n_blocks")).withColumn("block", F.expr("slot % n_blocks"))
    slots = permuted(slots, "block", "n_blocks", ["rank", "pass"], seed + 2, rounds)
    last = (F.col("slot") == F.col("n_slots") - 1) & (F.col("part") > 0)
    slots = slots.select("shard", "rank", "slot", "pass", "block", F.when(last, F.col("part")).otherwise(F.col("length")).alias("words"))

    # Blocks are joined by index: each slot gets its block's words, the last one of a source perhaps only the first of them.
    joined = blocks.withColumnRenamed("words", "n").join(slots, ["rank", "block"]).filter("at < words").withColumn("words", F.least("n", F.expr("words - at")))
    piece = F.struct("shard", "slot", "pass", "block", "first", "at", "words")
    wanted = joined.groupBy("rank", "start").agg(F.first("id").alias("id"), F.first("h").alias("h"), F.sum("words").alias("taken"), F.collect_list(piece).alias("pieces"))
    wanted = scratch.put(wanted, "wanted")
    # Of rows with one id and text, one gives its words to all. Both sides go by hashes without nulls, so that each text is shuffled once.
    same = Window.partitionBy("id_h", "h").orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)
    once = texts.withColumn("before", F.count("*").over(same)).filter("before = 0").select("id_h", "h", "text")
    full = wanted.withColumn("id_h", F.xxhash64("id")).join(once, ["id_h", "h"])
    words = F.regexp_extract_all("text", F.lit(SPACED), F.lit(0))
    cut = lambda own: F.transform("pieces", lambda p: F.struct(p.alias("p"), F.array_join(F.slice(own, (p["first"] + 1).cast("int"), p["words"].cast("int")), "").alias("text")))
    # F.transform over one element names the words, so that they are found once
    cuts = full.select("rank", "id", "start", F.explode(F.element_at(F.transform(F.array(words), cut), 1)).alias("c"))
    shards = scratch.put(cuts.select("c.p.shard", "rank", "c.p.slot", "c.p.pass", "c.p.block", "id", "start", "c.p.first", "c.p.at", "c.p.words", "c.text"), "shards")
    shares = sources.select("source", "rank", "source_size", "target")
    taken = placed.join(wanted.select("rank", "start", "taken"), ["rank", "start"], "left").join(shares, "rank").select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    none = sizes.filter("size = 0").join(shares, sizes["source"].eqNullSafe(shares["source"])).select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    out = taken.unionByName(none).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")
    return Mixture(out, slots, sources.select("source", "rank", "source_size", "target", "length", "n_blocks", "words"), blocks.drop("h"), shards)
