"""Summaries by optimizer step, means of batch means, running statistics and censuses."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_step(df: DataFrame, microbatch: str = "microbatch", accumulation: int = 1) -> DataFrame:
    """Adds step: micro-batches, numbered from 0, of one optimizer step count together."""
    return df.withColumn("step", F.expr(f"{microbatch} div {int(accumulation)} + 1").cast("long"))


def margin_summary(df: DataFrame, margin: str = "margin", order: str = "pair_id", log_steps: int = 1, sample: bool = False) -> DataFrame:
    """One row per logged step: size, mean, population deviation, least, 10 %, median, 90 %, greatest, positive share."""
    if log_steps <= 0:
        return margin_summary(df, margin, order, 1, sample).limit(0)
    v = F.col(margin).cast("double")
    p = F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    aggregates = [F.count("*").alias("batch_size"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), p.alias("p"), F.max(v).alias("max"), F.avg((v > 0).cast("double")).alias("pos_frac")]
    if sample:
        aggregates.append(F.transform(F.array_sort(F.collect_list(F.struct(order, v.alias("v")))), lambda s: s["v"]).alias("sample"))
    rows = df.filter(F.col("step") % log_steps == 0).groupBy("step").agg(*aggregates)
    names = ["step", "batch_size", "mean", "std", "min", F.col("p")[0].alias("p10"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p90"), "max", "pos_frac"]
    return rows.select(*names, *(["sample"] if sample else []))


def mean_of_means(df: DataFrame, keys: list[str], batch: str, values: list[str]) -> DataFrame:
    """Each batch's means, then their means: small batches weigh as much as large ones."""
    means = df.groupBy(*keys, batch).agg(*[F.avg(v).alias(v) for v in values])
    return means.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def batch_stats(df: DataFrame, value: str, step: str = "step", sample_std: bool = False) -> DataFrame:
    std = F.stddev_samp if sample_std else F.stddev_pop
    return df.groupBy(step).agg(F.avg(value).alias("mean"), std(value).alias("std"))


def running(stats: DataFrame, decay: float, *, step: str = "step", first: tuple[float, float] | None = (0.0, 1.0), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, step, mean, std) of the exponential moving averages after each step.

    first: the state before the first step, or None to begin with its values. Steps are whole numbers; keys aren't null. A scan in blocks of
    steps: averages within each are sums over a window, and only the blocks' ends, one row each, are folded in order.
    """
    rows = stats.select(*keys, F.col(step).cast("long").alias("step"), F.col("mean").cast("double").alias("mean"), F.col("std").cast("double").alias("std"))
    if decay == 0:
        return rows
    size = max(1, min(128, int(250 / max(-math.log10(abs(decay)), 1e-9))))  # within it, powers of the decay are finite
    rows = rows.withColumn("__block", F.expr(f"step div {size}"))
    block = Window.partitionBy(*keys, "__block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    place = F.count("*").over(block)
    power = lambda n: F.pow(F.lit(float(decay)), n)
    rows = rows.withColumn("__i", place)
    own = lambda c: (1 - decay) * power(F.col("__i")) * F.sum(F.col(c) * power(-F.col("__i"))).over(block)
    rows = rows.withColumns({"__mean": own("mean"), "__std": own("std")})
    ends = rows.groupBy(*keys, "__block").agg(F.max("__i").alias("n"), *[F.max_by(f"__{c}", "__i").alias(c) for c in ("mean", "std")], *[F.min_by(c, "__i").alias(f"first_{c}") for c in ("mean", "std")])
    kinds = ", ".join(f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds + ', ' if keys else ''}__block long, mean double, std double"
    width = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m, s = None, 0.0, 1.0
        for batch in batches:
            before = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, mean, std, first_mean, first_std = row[width + 1 :]
                if row[:width] != key:
                    key, (m, s) = row[:width], first or (first_mean, first_std)
                before.append((m, s))
                m, s = decay**n * m + mean, decay**n * s + std
            out = list(zip(*before, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], *(pa.array(x, pa.float64()) for x in out)], names=[*keys, "__block", "mean", "std"])

    dealt = ends.repartition(*keys) if keys else ends.coalesce(1)
    carried = dealt.sortWithinPartitions(*keys, "__block").select(*keys, "__block", "n", "mean", "std", "first_mean", "first_std").mapInArrow(fold, schema)
    carried = carried.withColumnsRenamed({"mean": "__m", "std": "__s"})
    joined = rows.join(carried, [*keys, "__block"])
    return joined.select(*keys, "step", (F.col("__mean") + power(F.col("__i")) * F.col("__m")).alias("mean"), (F.col("__std") + power(F.col("__i")) * F.col("__s")).alias("std"))


def update_state(state: tuple[float, float] | None, stats: DataFrame, decay: float, *, step: str = "step") -> tuple[float, float] | None:
    """The state after more steps, to go on from; without a state it begins with the first step's values."""
    last = running(stats, decay, step=step, first=state).orderBy(F.desc("step")).first()
    return (last["mean"], last["std"]) if last else state


def beta_path(steps: DataFrame, beta: float, eps: float, *, step: str = "step", mean: str = "mean_steps") -> DataFrame:
    """(step, beta, mean_steps): the beta in use at each optimizer step, before the update by beta / (1 + mean_steps * eps). Products within
    blocks of 1,024 steps, and of the blocks before."""
    rows = steps.select(F.col(step).cast("long").alias("step"), F.col(mean).cast("double").alias("mean_steps"))
    rows = rows.withColumns({"__block": F.expr("step div 1024"), "__f": 1 + F.col("mean_steps") * eps})
    before = lambda w: F.coalesce(F.product("__f").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    own = rows.withColumn("__own", before(Window.partitionBy("__block").orderBy("step")))
    blocks = rows.groupBy("__block").agg(F.product("__f").alias("__f"))
    blocks = blocks.withColumn("__all", before(Window.orderBy("__block"))).select("__block", "__all")
    return own.join(blocks, "__block").select("step", (F.lit(float(beta)) / (F.col("__all") * F.col("__own"))).alias("beta"), "mean_steps")


def beta_rows(df: DataFrame, *, beta: float = 0.1, alpha: float = 0.6, rho: float = 0.8, decay: float = 0.9, least: float = 1e-3, state: tuple[float, float] | None = None, training: bool = True, deterministic_eval: bool = True, row_id: str = "pair_id", seed: int = 42) -> DataFrame:
    """Rows (step, c, r, rc, rr, ...) with gap, mean, std, kept, beta_raw, beta_used and loss: each step's batch moves the running statistics, keeps
    a weighted share of its pairs, and takes its beta from those.

    Out of training the statistics stay at `state` ((0, 1) by default) and, if deterministic_eval, all pairs are kept.
    """
    from tidewater.functions.losses import beta_gap, gap_weight
    from tidewater.functions.scoring import log_sigmoid
    from tidewater.operators.mixing import weighted_sample

    rows = df.withColumn("gap", beta_gap(F.col("c"), F.col("r"), F.col("rc"), F.col("rr")))
    state = state or (0.0, 1.0)
    if training:
        rows = rows.join(running(batch_stats(rows, "gap"), decay, first=state), "step")
    else:
        rows = rows.withColumns({"mean": F.lit(float(state[0])), "std": F.lit(float(state[1]))})
    if not training and deterministic_eval:
        rows = rows.withColumn("kept", F.lit(True))
    else:
        rows = weighted_sample(rows.withColumn("__w", gap_weight(F.col("gap"), F.col("mean"), F.col("std"))), "__w", rho, keys=("step",), row_id=row_id, seed=seed).drop("__w")
    batch = Window.partitionBy("step")
    raw = beta * (1 + alpha * (F.avg(F.when(F.col("kept"), F.col("gap"))).over(batch) - F.col("mean")))
    rows = rows.withColumn("beta_raw", raw).withColumn("beta_used", F.greatest("beta_raw", F.lit(least)))
    return rows.withColumn("loss", -log_sigmoid(F.col("beta_used") * F.col("gap")))


def beta_summary(rows: DataFrame) -> DataFrame:
    """(step, loss, beta_raw, beta_used, kept_share) of beta_rows: the loss is the mean over kept pairs."""
    return rows.groupBy("step").agg(masked_mean(F.col("loss"), F.col("kept")).alias("loss"), F.first("beta_raw").alias("beta_raw"), F.first("beta_used").alias("beta_used"), F.avg(F.col("kept").cast("double")).alias("kept_share"))


def margin_extremes(df: DataFrame, margin: str = "margin", step: str = "step") -> DataFrame:
    """(step, mean, min, max, std) of an adaptive margin by batch; std with n - 1."""
    return df.groupBy(step).agg(F.avg(margin).alias("mean"), F.min(margin).alias("min"), F.max(margin).alias("max"), F.stddev_samp(margin).alias("std"))


def masked_mean(value: Column, mask: Column) -> Column:
    """Sum over the mask by its size, at least 1."""
    return F.sum(F.when(mask, value).otherwise(0.0)) / F.greatest(F.sum(mask.cast("int")), F.lit(1))


def census(df: DataFrame, value: str) -> DataFrame:
    """How many values are NaN, infinite either way, and all."""
    v = F.col(value)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return df.agg(count(F.isnan(v)).alias("n_nan"), count(v == float("inf")).alias("n_pos_inf"), count(v == float("-inf")).alias("n_neg_inf"), F.count("*").alias("n_total"))


def compare(a: DataFrame, b: DataFrame, key: str, values: list[str], atol: float = 1e-5, rtol: float = 1e-5) -> DataFrame:
    """(name, n, n_far): per vector how many values of b lie further than atol + rtol * |b| from a's, or are missing."""
    both = a.select(key, *[F.col(v).alias(f"{v}_a") for v in values]).join(b.select(key, *[F.col(v).alias(f"{v}_b") for v in values]), key, "full")
    near = lambda v: F.coalesce(F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")) <= atol + rtol * F.abs(F.col(f"{v}_b")), F.lit(False))
    sums = both.agg(F.count("*").alias("n"), *[F.sum((~near(v)).cast("long")).alias(v) for v in values])
    return sums.select("n", F.explode(F.create_map(*[x for v in values for x in (F.lit(v), F.col(v))])).alias("name", "n_far")).select("name", "n", "n_far")


def resumed(stats: DataFrame, state: DataFrame, decay: float, *, key: str, step: str = "step") -> DataFrame:
    """running() gone on with from a table of states, a row of (key, mean, std) each: what the steps give from nothing, and the decayed state. A key without a state
    starts from (0, 1)."""
    columns = stats.select(key, F.col(step).alias("step"), "mean", "std")
    own = running(columns, decay, first=(0.0, 0.0), keys=(key,))
    left = running(columns.withColumns({"mean": F.lit(1.0), "std": F.lit(1.0)}), decay, first=(0.0, 0.0), keys=(key,)).select(key, "step", (1 - F.col("mean")).alias("__left"))
    start = state.select(key, F.col("mean").alias("__m"), F.col("std").alias("__s"))
    both = own.join(left, [key, "step"]).join(start, key, "left")
    ahead = lambda c, s, none: (F.col(c) + F.col("__left") * F.coalesce(F.col(s), F.lit(none))).alias(c)
    return both.select(key, "step", ahead("mean", "__m", 0.0), ahead("std", "__s", 1.0))


def attach_reference(pairs: DataFrame, reference: DataFrame, key: str = "pair_id") -> DataFrame:
    """Reference log-probabilities by key, never by place; raises where one is missing or not finite."""
    joined = pairs.join(reference, key, "left")
    names = [c for c in reference.columns if c != key]
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    bad = F.raise_error(F.lit("a reference log-probability is missing or not finite")).cast("double")
    return joined.withColumns({c: F.when(fine(c), F.col(c)).otherwise(bad) for c in names})


def evaluation(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(loss, logits_chosen, logits_rejected, label): what an evaluation step returns, from per-pair loss and mean logits; ignored
    ones are left out."""
    parts = {"loss": F.avg("loss").alias("loss"), "logits_chosen": F.avg("logits_chosen").alias("logits_chosen"), "logits_rejected": F.avg("logits_rejected").alias("logits_rejected")}
    return df.agg(*[c for n, c in parts.items() if n not in ignore]).withColumn("label", F.lit(0))
