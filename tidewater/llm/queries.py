"""The queries opN_<name>: thin digests of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.jaccard import jaccard_join

    found = jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.classes(counted=True).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.linededup import apply_bitmaps, line_dedup, n_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.withColumn("n_lines", n_lines("text"))
    kept = apply_bitmaps(lines, line_dedup(docs), count_col="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewater.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.quality import quality

    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_content", "p_metadata", "quality")], "kept")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.substrings import substring_dedup

    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.toxicity import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("p_junk", 6).alias("p_junk"), F.round("p_toxic", 6).alias("p_toxic"), "is_toxic")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).documents


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.embeddings import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.secrets import KINDS, secret_spans

    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.spelling import letter_runs, spelling_variants, words_of

    runs = letter_runs(table(spark, sf_dir, "documents"), "doc_id", "text", 7)  # shorter runs give no word of 7 letters
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, less).otherwise(F.col("run")).alias("word"))
    return spelling_variants(words_of(words, 7, 2), times=10)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewater.llm.common import Scratch
    from tidewater.llm.tokenfiles import write_token_files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = write_token_files(docs, f"{Scratch(spark, 'tokens').root}/files", public_tokenizers.path("word_bpe_49k.json"))
    found = files.read(docs.select("doc_id").distinct(), "doc_id")
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
