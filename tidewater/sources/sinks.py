"""JSON Lines: inspection samples, margin logs and their reader."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the columns of a margin log.
MARGIN_LOG = T.StructType(
    [T.StructField("epoch", T.DoubleType()), T.StructField("step", T.LongType()), T.StructField("batch_size", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("mean", "std", "min", "p10", "median", "p90", "max", "pos_frac")]
    + [T.StructField("sample", T.ArrayType(T.DoubleType())), T.StructField("npy", T.StringType())]
)


def write_samples(df: DataFrame, path: str) -> None:
    """A bounded sample as JSON Lines, in place of what was there; characters stay as they are."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_margins(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_full_margins(df: DataFrame, path: str) -> None:
    """All margins, a folder per step. A step that is written again is replaced, the others stay; an empty table changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def read_full_margins(spark: SparkSession, path: str, steps: list[int] | None = None) -> DataFrame:
    """The margins of these steps, or of all; other steps' folders aren't opened."""
    df = spark.read.parquet(path)
    return df if steps is None else df.filter(F.col("step").isin(*steps))


def read_margins(spark: SparkSession, path: str) -> DataFrame:
    """The margin log's fixed columns, missing ones null, also the step. Blank lines go; raises if there is no row, and, when read, if a line is
    broken."""
    df = spark.read.schema(MARGIN_LOG).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"no margins at {path}")
    return df


def margin_dataset_name(model: str | None, explicit: str | None = None) -> str:
    """The name of a model's margin dataset, unless one is given."""
    if not (explicit or model):
        raise ValueError("a margin dataset needs a name or a model's name")
    return explicit or f"{model}-margin"


def write_card(spark: SparkSession, path: str, name: str, rows: int, *, run: dict[str, str | None] | None = None, mixer: dict[str, float] | None = None) -> None:
    """A short description beside a margin dataset: rows, columns, what is known of the run, and the mixture of its data."""
    facts = "".join(f"- {k}: {v}\n" for k, v in (run or {}).items())
    text = f"# {name}\n\nMargins by optimizer step: {rows} rows with the columns {', '.join(MARGIN_LOG.names)}.\n{facts}mixer: {json.dumps(mixer, sort_keys=True)}\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
