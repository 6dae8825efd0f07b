"""Tables that cut lineage, in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where a local session has none, one is made."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
    return shared_folder(spark)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place in the shared folder; it goes when the session ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """The table in `buckets` files by the key's hash, each sorted by key, and read back: joins of such tables on the key need no shuffle (tasks sort their bucket)."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as one Parquet file a partition, in the partitions' order; it goes when the session ends."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.option("maxRecordsPerFile", 0).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
