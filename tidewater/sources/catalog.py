"""Named sources: name, config and split to a table with stored row ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.sources.shared import written


@dataclass
class Source:
    path: str | dict[str, DataFrame]  # a folder, or tables by split
    format: str = "canonical"  # or "transcript"
    subdir: bool = False  # whether a config names a folder


@dataclass
class Catalog:
    spark: SparkSession
    root: str = ""
    sources: dict[str, Source] = field(default_factory=dict)

    def register(self, name: str, path: str | dict[str, DataFrame], *, format: str = "canonical", subdir: bool = False) -> None:
        self.sources[name] = Source(path, format, subdir)

    def is_transcript(self, name: str) -> bool:
        return name in self.sources and self.sources[name].format == "transcript"

    def load(self, name: str, split: str, config: str | None = None) -> DataFrame:
        """A source's split; if it isn't registered or not there, the folder <root>/<name>/<split>. A clear error names both."""
        tried = []
        if name in self.sources:
            s = self.sources[name]
            if isinstance(s.path, dict):
                if split in s.path:
                    return s.path[split]
                raise FileNotFoundError(f"source {name!r} has no split {split!r}; it has {sorted(s.path)}")
            tried.append("/".join([s.path, *([config] if config and s.subdir else []), f"{split}.parquet"]))
        tried.append(f"{self.root}/{name}/{split}".lstrip("/") if not self.root else f"{self.root}/{name}/{split}")
        for path in tried:
            try:
                return self.spark.read.parquet(path)
            except AnalysisException:
                continue
        raise FileNotFoundError(f"no data for source {name!r}, split {split!r}, config {config!r}; looked at {tried}")

    @staticmethod
    def numbered(df: DataFrame, order: list[str] | None = None) -> DataFrame:
        """With row_id 0 to n - 1. One that is stored is taken as it is (renumbered without gaps). The range-sorted table is written once to the
        shared folder; a row's number is its place in its file and the rows of the files before, so the numbers hold however often the result
        is read, ties keep one order, and no task sees all rows."""
        by = order or (["row_id"] if "row_id" in df.columns else None)
        if by:
            df = df.orderBy(*by)
        kept = df.drop("row_id")
        empty = [f.name for f in kept.schema if f.dataType.typeName() == "void"]  # Parquet has no such type
        table = written(kept.drop(*empty).withColumn("__row", F.lit(True)), "numbered")
        part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")
        marked = table.select("*", part.alias("__part"), F.col("_metadata.row_index").alias("__at"))
        sizes = marked.groupBy("__part").agg(F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shifts = sizes.select("__part", before.alias("__shift"))  # one row a file
        return marked.join(F.broadcast(shifts), "__part").withColumn("row_id", F.col("__at") + F.col("__shift")).select(*[F.lit(None).alias(c) if c in empty else F.col(f"`{c}`") for c in kept.columns], "row_id")


def non_empty_column(df: DataFrame, name: str) -> DataFrame:
    """One column, stripped, without empty values; repeats stay."""
    from tidewater.functions.text import strip

    return df.select(strip(F.col(name)).alias(name)).filter(F.length(name) > 0)
