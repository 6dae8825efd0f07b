"""A corpus pipeline of five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes
each result as Parquet into the session's shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch
from tidewater.llm.decontaminate import contaminated
from tidewater.llm.jaccard import jaccard_join
from tidewater.llm.linededup import apply_bitmaps, line_dedup
from tidewater.llm.mixing import mix_sources
from tidewater.llm.toxicity import toxicity


#: Hashes by which a row is known, while a stage works.
ID_H, TEXT_H = "__id_h", "__text_h"


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id isn't among the ids."""
    gone = ids.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go.

    A null text counts as empty; null ids are scored like others; rows that are equal, or score the same, go or stay together; texts are read
    whole; without labels, or in an empty table, none goes. Other columns stay, whatever their names.
    """
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), prefix="__")
    return scored.filter("not __is_toxic").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay in the last of them, the largest id; no document goes.

    A null text stays null; rows with a null id keep all lines and don't count; rows of one id count as one document; a document of many lines,
    or lines that very many documents hold, are dealt over tasks. Other columns stay.
    """
    return apply_bitmaps(docs, line_dedup(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group that similarities of 0.8 or more on 5-word shingles connect: of the least id (a null id comes last)
    and, if that id has several texts there, of the text with the least hash.

    Of repeated rows one stays; if they differ in other columns, the one whose columns have the least hash. Null texts and texts without words
    are in no group and all stay, repeated or not. Very long texts are compared whole. Other columns stay.
    """
    gone, repeated = jaccard_join(docs, k=5, percent=80).others()
    keyed = docs.withColumns({ID_H: F.xxhash64("doc_id"), TEXT_H: F.xxhash64("text")})
    key = lambda df: df.select(F.col("id_h").alias(ID_H), F.col("text_h").alias(TEXT_H)).distinct()
    kept = keyed.join(key(gone), [ID_H, TEXT_H], "left_anti")
    if not repeated.isEmpty():
        row = F.struct(*docs.columns)
        once = kept.join(key(repeated), [ID_H, TEXT_H], "left_semi").groupBy(ID_H, TEXT_H).agg(F.min_by(row, F.xxhash64(row)).alias("row"))
        kept = kept.join(key(repeated), [ID_H, TEXT_H], "left_anti").select(*docs.columns).unionByName(once.select("row.*"))
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of a benchmark item's 5-word shingles go.

    Null texts and items hold nothing and stay; a null id never matches, so its rows stay; all rows of an id that matches go; without
    items none goes. Long texts are searched whole. Other columns stay.
    """
    return without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mixture takes of each document that is left.

    A row per row: null texts have size 0 and nothing is taken; null ids are ids; a null source is the last one; repeated rows count each; an
    empty table gives none. Other columns aren't returned.
    """
    return mix_sources(docs).documents


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

#: SQL can express neither the trained classifier nor the pseudorandom mixture; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        with Scratch.sweep():  # the stage's own tables
            docs = scratch.put(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs
