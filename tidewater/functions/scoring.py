"""Log-probabilities from logits, as folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def sum_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once: what a lambda names from outside is worked out again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def log_sum_exp(logits: Column) -> Column:
    return bound(logits, lambda a: bound(F.array_max(a), lambda top: top + F.ln(sum_of(F.transform(a, lambda x: F.exp(x - top))))))


def sanitise(x: Column, limit: float = 1e4) -> Column:
    """NaN becomes 0 and what lies beyond the limit, infinities too, the limit."""
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(-limit)), F.lit(limit)))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def checked(x: Column, policy: str) -> Column:
    """policy: 'sanitize' repairs non-finite values, 'error' raises."""
    if policy not in ("error", "sanitize"):
        raise ValueError(f"unknown policy {policy!r}")
    bad = F.raise_error(F.lit("non-finite log-probability")).cast("double") if policy == "error" else sanitise(x)
    return F.when(is_finite(x), x).otherwise(bad)


def token_logp(logits: Column, label: Column) -> Column:
    return F.try_element_at(logits, label.cast("int") + 1) - log_sum_exp(logits)


def token_logp_long(chunks: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("seq", "pos"), *, width: int, pad: int = -100) -> DataFrame:
    """(keys, logp) from logits as rows (keys, chunk, values), values being `width` entries of the vocabulary from chunk * width on, and labels as rows
    (keys, label): no row holds a whole vocabulary. A chunk gives its maximum, its sum of exponentials below it, and the label's logit if it has that; three numbers
    a chunk are shuffled, once. Padded labels give no row; a label that no chunk holds gives null."""
    chosen = labels.filter(F.col("label") != pad).select(*keys, F.col("label").cast("long").alias("__label"))
    rows = chunks.join(chosen, list(keys))
    at = F.col("__label") - F.col("chunk").cast("long") * width
    own = F.when((at >= 0) & (at < width), F.try_element_at("values", (at + 1).cast("int")))
    top = F.array_max("values")
    parts = rows.select(*keys, top.alias("__top"), sum_of(F.transform("values", lambda x: F.exp(x - top))).alias("__sum"), own.alias("__own"))
    best = F.max("__top").over(Window.partitionBy(*keys))
    merged = parts.withColumn("__best", best).groupBy(*keys).agg(F.max("__best").alias("__best"), F.sum(F.col("__sum") * F.exp(F.col("__top") - F.col("__best"))).alias("__sum"), F.max("__own").alias("__own"))
    return merged.select(*keys, (F.col("__own") - F.col("__best") - F.ln("__sum")).alias("logp"))


def sequence_logp(logits: Column, labels: Column, *, average: bool = False, pad: int = -100, clamp: bool = True) -> Column:
    """Of a decoder: position i's logits predict label i + 1; padded labels don't count. Sum, or mean over those that do; of none,
    0 if clamp, else NaN. Raises if there isn't one row of logits for each label."""
    n = F.size(labels)
    pairs = F.zip_with(F.slice(logits, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    real = F.filter(pairs, lambda p: p["y"] != pad)
    total = sum_of(F.transform(real, lambda p: token_logp(p["x"], p["y"])))
    if average:
        count = F.size(real)
        total = F.when(count > 0, total / count).otherwise(F.lit(0.0) if clamp else F.lit(NAN))
    shape = F.raise_error(F.lit("logits and labels differ in length")).cast("double")
    return F.when(F.size(logits) == n, total).otherwise(shape)


def perturbed(policy: Column, reference: Column, eps: float) -> tuple[Column, Column]:
    """Logits moved away from and towards the reference's: (1 + eps) p - eps q and (1 - eps) p + eps q."""
    return F.zip_with(policy, reference, lambda p, q: (1 + eps) * p - eps * q), F.zip_with(policy, reference, lambda p, q: (1 - eps) * p + eps * q)


def step_of(up: Column, base: Column, down: Column) -> Column:
    """1 if the log-probability rises all the way, -1 if it falls all the way, else 0 (also with NaN)."""
    odd = F.isnan(up) | F.isnan(base) | F.isnan(down)
    return F.when(odd, 0).when((up > base) & (base > down), 1).when((down > base) & (base > up), -1).otherwise(0)


def length_weight(logits: Column, labels: Column, pad: int = -100) -> Column:
    """Mean over loss tokens (at least one counts) of logp - log sum exp(2 log softmax)."""
    def of(p: Column) -> Column:
        return bound(log_sum_exp(p["x"]), lambda lse: F.try_element_at(p["x"], p["y"].cast("int") + 1) - lse - log_sum_exp(F.transform(p["x"], lambda x: 2 * (x - lse))))

    n = F.greatest(F.size(labels) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(logits, F.lit(1), n), F.slice(labels, F.lit(2), n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    real = F.filter(pairs, lambda p: p["y"] != pad)
    return sum_of(F.transform(real, of)) / F.greatest(F.size(real), F.lit(1))


def cross_entropy(logits: Column, labels: Column, ignore: int = 0) -> Column:
    """Mean loss over labels other than `ignore`; masked ones were set to it before, so a real token of that id goes too."""
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(logits, F.lit(1), n), F.slice(labels, F.lit(2), n), lambda x, y: F.struct(x.alias("x"), F.when(y < 0, ignore).otherwise(y).alias("y")))
    real = F.filter(pairs, lambda p: p["y"] != ignore)
    return F.when(F.size(real) > 0, -sum_of(F.transform(real, lambda p: token_logp(p["x"], p["y"]))) / F.size(real)).otherwise(F.lit(NAN))


def token_nll(logits: Column, labels: Column, pad: int = -100) -> tuple[Column, Column]:
    """Sum of the negative log-probabilities of the labels that count, and their number."""
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(logits, F.lit(1), n), F.slice(labels, F.lit(2), n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    real = F.filter(pairs, lambda p: p["y"] != pad)
    return -sum_of(F.transform(real, lambda p: token_logp(p["x"], p["y"]))), F.size(real)


def mean_logit(logits: Column, labels: Column, pad: int = -100) -> Column:
    """Mean of all logits at loss positions; of all positions if no label counts."""
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(logits, F.lit(1), n), F.slice(labels, F.lit(2), n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    real = F.filter(pairs, lambda p: p["y"] != pad)
    flat = F.flatten(F.transform(F.when(F.size(real) > 0, real).otherwise(pairs), lambda p: p["x"]))
    return F.when(F.size(flat) > 0, sum_of(flat) / F.size(flat)).otherwise(F.lit(NAN))
