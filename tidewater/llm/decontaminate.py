"""Benchmark decontamination: short test items inside long documents, with DataFrame functions alone.

Containment search by MinHash: a min-hash of an item is one of its shingles, drawn evenly, and lies in a document with a
probability of the item's containment there. Items are partitioned by size; each partition has its own number of hash functions,
and small items keep all their shingles. A document that holds none of an item's min-hashes holds at least 80 % of the item
with a probability of 0.2 ** 16 or less. The document's side stays whole, so its length doesn't matter. Candidates are verified
by exact containment of the distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch

#: Hash functions by size of an item, up to and with so many shingles; None keeps all. Beyond the last size, the last number.
PARTITIONS = ((16, None), (32, 16), (64, 20), (256, 24))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat != "", F.split(flat, " ")).otherwise(F.array().cast("array<string>"))


def shingle_hashes(hashes: Column, k: int) -> Column:
    """A hash of each k-word shingle from the words' hashes; of the whole sequence if it has fewer words."""
    n = F.size(hashes)
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(n, hashes))).otherwise(F.array().cast("array<bigint>"))


def runs_of(hashes: Column, m: int) -> Column:
    """A hash of each run of m words, as a whole item of m words has it."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - m), lambda i: F.xxhash64(F.lit(m), F.slice(hashes, i + 1, F.lit(m))))
    return F.when(F.size(hashes) >= m, runs).otherwise(F.array().cast("array<bigint>"))


def shingled(rows: DataFrame, keys: list[str], text_col: str, k: int, short: tuple[int, ...] = ()) -> DataFrame:
    """(keys, h) for every shingle, repeats included, and for every run of as many words as `short` names."""
    hashed = rows.select(*keys, F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("w"))
    return hashed.select(*keys, F.explode(F.concat(shingle_hashes(F.col("w"), k), *[runs_of(F.col("w"), m) for m in short])).alias("h"))


def min_hashes(items: DataFrame) -> DataFrame:
    """(item, h): the min-hashes of each item, from rows (item, size, h)."""
    most = max(m for _, m in PARTITIONS if m)
    all_of = items.filter(F.col("size") <= PARTITIONS[0][0]).select("item", "h")
    large = items.filter(F.col("size") > PARTITIONS[0][0])
    count = F.lit(PARTITIONS[-1][1])
    for size, m in reversed(PARTITIONS[1:-1]):
        count = F.when(F.col("size") <= size, m).otherwise(count)
    mins = large.groupBy("item", "size").agg(F.array(*[F.min_by("h", F.xxhash64(F.lit(j), "h")) for j in range(most)]).alias("mins"))
    return all_of.unionByName(mins.select("item", F.explode(F.array_distinct(F.slice("mins", F.lit(1), count))).alias("h")))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, item, n_shingles, n_common): the items of which a document holds at least `percent` % of the distinct shingles.

    Words are lower-cased runs of letters and digits. An item of fewer than k words is one shingle, its whole sequence, and is found in
    every document that holds these words in a row. Null and empty texts and items have no shingle and match nothing. Repeated rows of one
    id count once; a null id never matches. Empty tables give none. Other columns are not read. Joins with the
    items broadcast them only while they are below Spark's own size threshold, and shuffle beyond it.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    items = shingled(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), ["item"], "text", k).distinct()
    sizes = items.groupBy("item").agg(F.count("*").alias("size"))
    items = scratch.put(items.join(sizes, "item"), "items")
    searched = scratch.put(min_hashes(items).distinct(), "min_hashes")
    # How many words items of fewer than k have, at most k - 1 numbers: documents are searched for runs of so many words as well.
    n_words = F.size(words(F.col(item_text_col)))
    short = tuple(sorted(r[0] for r in benchmark.select(n_words.alias("m")).filter(f"m between 1 and {k - 1}").distinct().collect()))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
    candidates = scratch.put(shingled(texts, ["doc"], "text", k, short).join(searched, "h").select("doc", "item").distinct(), "candidates")
    some = scratch.put(candidates.select("doc").distinct(), "documents")
    held = shingled(texts.join(some, "doc", "left_semi"), ["doc"], "text", k, short).join(items, "h").select("doc", "item", "size", "h")
    common = held.join(candidates, ["doc", "item"], "left_semi").groupBy("doc", "item", "size").agg(F.count_distinct("h").alias("n_common"))
    found = common.filter(F.col("n_common") * 100 >= F.col("size") * percent)
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("size").alias("n_shingles"), "n_common")
