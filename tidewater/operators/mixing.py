"""Mixing named sources: prefix samples, concatenation, seeded order, seeded and weighted samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.pairs import keep_columns, normalise
from tidewater.sources.catalog import Catalog


def prefix_sample(df: DataFrame, fraction: float, row_id: str = "row_id") -> DataFrame:
    """The first int(fraction * rows) rows in row_id order. Row ids are 0 to n - 1, so it is a filter that a scan can take."""
    if fraction < 0:
        raise ValueError("a fraction is negative")
    return df.filter(F.col(row_id) < int(float(fraction) * df.count()))


def shuffle_key(row_id: str | Column = "row_id", seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id))


def seeded_shuffle(df: DataFrame, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Rows in an order that the seed fixes, by a range partitioning and no global task."""
    return df.orderBy(shuffle_key(row_id, seed), row_id)


def k_sample(df: DataFrame, count: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """At most count rows at the places that Python's seeded sample draws; none if count is not positive. Fixed value: the draw is this call of
    the standard library, so that samples can be reproduced from the seed alone."""
    n = df.count()
    if n <= 0 or count <= 0:
        return df.limit(0)
    return df.filter(F.col(row_id).isin(random.Random(seed).sample(range(n), k=min(n, count))))


def eval_batch(df: DataFrame, batch_size: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """The rows that an evaluation generates from: at most a batch, at places that the seed fixes."""
    return k_sample(df, batch_size, seed, row_id)


def weighted_sample(df: DataFrame, weight: str, rho: float, *, keys: tuple[str, ...] = (), row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Adds kept: max(1, int(n * rho)) rows per group without replacement, by exponential keys -ln(u) / weight. If all weights of a
    group are 0, all count alike. Each group is a batch, so its window is bounded by the batch's size."""
    from pyspark.sql import Window

    group = Window.partitionBy(*keys)
    u = (F.conv(F.substring(shuffle_key(row_id, seed), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    w = F.when(F.sum(weight).over(group) <= 0, 1.0).otherwise(F.col(weight))
    df = df.withColumn("__key", F.when(w > 0, -F.ln(u) / w).otherwise(F.lit(float("inf"))))
    keep = F.greatest(F.lit(1), F.floor(F.count("*").over(group) * F.lit(float(rho)))).cast("long")
    rank = F.row_number().over(group.orderBy("__key", row_id))
    return df.withColumn("__keep", keep).withColumn("kept", rank <= F.col("__keep")).drop("__key", "__keep")


def mix(catalog: Catalog, mixer: dict[str, float], *, splits: tuple[str, ...] = ("train", "test"), configs: list[str | None] | None = None, columns: tuple[str, ...] = ("messages", "chosen", "rejected", "prompt", "completion", "label"), shuffle: bool = True, seed: int = 42) -> dict[str, DataFrame]:
    """Train and test tables of a mixer {name: fraction}: each source is loaded, normalised and pruned; train splits give a
    prefix, test splits everything; a fraction holds for all of its source's train splits."""
    if not isinstance(mixer, dict):
        raise ValueError(f"a mixer is a dict of name and fraction, not {type(mixer).__name__}")
    configs = configs or [None] * len(mixer)
    if len(configs) != len(mixer):
        raise ValueError("there must be as many configs as sources")
    parts: dict[str, list[DataFrame]] = {"train": [], "test": []}
    for (name, fraction), config in zip(mixer.items(), configs, strict=True):
        for split in splits:
            side = "train" if "train" in split else "test" if "test" in split else None
            if side is None:
                raise ValueError(f"split {split!r} is neither train nor test")
            df = catalog.load(name, split, config)
            if fraction < 0:
                raise ValueError("a fraction is negative")
            if catalog.is_transcript(name):
                df = normalise(df)
            if side == "train":
                df = prefix_sample(catalog.numbered(df), fraction)
            parts[side].append(keep_columns(df, (*columns, "row_id", "chosen_text", "rejected_text")).withColumn("source", F.lit(name)))
    out = {}
    for side, dfs in parts.items():
        if dfs:
            whole = dfs[0]
            for df in dfs[1:]:
                whole = whole.unionByName(df, allowMissingColumns=True)
            order = F.concat_ws("/", "source", F.col("row_id").cast("string"))
            out[side] = whole.orderBy(shuffle_key(order, seed)) if shuffle and side == "train" else whole
    if not out:
        raise ValueError(f"nothing was loaded for {list(mixer)}")
    return out
