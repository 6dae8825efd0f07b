"""Preference losses over log-probability columns c, r (policy) and rc, rr (reference)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.scoring import log_sigmoid


def smoothed(x: Column, smoothing: float) -> Column:
    return -log_sigmoid(x) * (1 - smoothing) - log_sigmoid(-x) * smoothing


def by_type(x: Column, beta: float, kind: str, smoothing: float, types: tuple[str, ...]) -> Column:
    if kind not in types:
        raise ValueError(f"unknown loss type {kind!r}; one of {list(types)}")
    return F.greatest(F.lit(0.0), 1 - beta * x) if kind == "hinge" else smoothed(beta * x, smoothing)


def simpo(c: Column, r: Column, *, beta: float = 2.0, gamma: float = 1.0, kind: str = "sigmoid", smoothing: float = 0.0) -> dict[str, Column]:
    """c and r are length-normalised."""
    x = c - r - gamma / beta
    return {"loss": by_type(x, beta, kind, smoothing, ("sigmoid", "hinge")), "chosen_reward": beta * c, "rejected_reward": beta * r}


def alpha_dpo(c: Column, r: Column, rc: Column, rr: Column, mean: Column, std: Column, *, beta: float = 2.0, gamma: float = 1.0, alpha: float = 0.1, kind: str = "sigmoid", smoothing: float = 0.0) -> dict[str, Column]:
    """mean and std: the running statistics of the gap after this batch."""
    gap = (c - r) - (rc - rr)
    margin = alpha * (gap - mean) / F.greatest(std, F.lit(1e-8)) + gamma / beta
    loss = by_type((c - r) - margin, beta, kind, smoothing, ("sigmoid", "hinge", "alpha_dpo"))
    return {"loss": loss, "chosen_reward": beta * (c - alpha * (c - rc)), "rejected_reward": beta * (r - alpha * (r - rr)), "margin": margin}


def with_sft(loss: Column, nll: Column, tokens: Column, weight: float) -> Column:
    """A batch's mean preference loss and, weighted, the mean over all its chosen tokens of their negative log-probability; null without
    such tokens. Aggregates."""
    return F.avg(loss) + (F.try_divide(weight * F.sum(nll), F.sum(tokens)) if weight > 0 else 0.0)


def weighted(loss: Column, chosen_weight: Column, rejected_weight: Column) -> Column:
    """A pair's loss by its length weights: min(1, exp(w_c + w_r))."""
    return loss * F.least(F.lit(1.0), F.exp(chosen_weight + rejected_weight))


def beta_gap(c: Column, r: Column, rc: Column, rr: Column) -> Column:
    return (c - rc) - (r - rr)


def gap_weight(gap: Column, mean: Column, std: Column) -> Column:
    """The Gaussian weight by which a batch is sampled; non-finite weights are 0."""
    w = F.exp(-0.5 * F.pow((gap - mean) / F.greatest(std, F.lit(1e-6)), 2))
    return F.when(F.isnan(w) | (F.abs(w) == float("inf")), 0.0).otherwise(w)


def adaptive_beta(mean_kept: Column, mean: Column, *, beta: float = 0.1, alpha: float = 0.6, least: float = 1e-3) -> Column:
    return F.greatest(beta * (1 + alpha * (mean_kept - mean)), F.lit(least))


PROJECTIONS: dict[str, Callable[[Column, float], Column]] = {
    "reverse_kl": lambda u, a: u,
    "forward_kl": lambda u, a: -F.exp(-u),
    "js_divergence": lambda u, a: log_sigmoid(u),
    "alpha_divergence": lambda u, a: u if abs(a - 1) < 1e-6 else F.exp(F.least((a - 1) * u, F.lit(80.0))) / (a - 1),
}


def margin_dpo(c: Column, r: Column, rc: Column, rr: Column, *, beta: float = 0.1, divergence: str = "reverse_kl", alpha: float = 0.5) -> dict[str, Column]:
    if divergence not in PROJECTIONS:
        raise ValueError(f"unknown divergence {divergence!r}")
    project = PROJECTIONS[divergence]
    x = project(c - rc, alpha) - project(r - rr, alpha)
    return {"loss": -log_sigmoid(beta * x), "margin": (c - r) - (rc - rr), "chosen_reward": beta * (c - rc), "rejected_reward": beta * (r - rr)}


def epsilon_dpo(c: Column, r: Column, rc: Column, rr: Column, step: Column, *, beta: float = 0.1, eps: float = 0.01, smoothing: float = 0.0) -> dict[str, Column]:
    """Smoothing adds the same term twice, so it has no effect; kept as it is for equal results."""
    own = beta / (1 + eps * step)
    x = (c - r) - (rc - rr)
    loss = -log_sigmoid(own * x) * (1 - smoothing) - log_sigmoid(own * x) * smoothing
    return {"loss": loss, "beta": own, "chosen_reward": own * (c - rc), "rejected_reward": own * (r - rr)}


#: Loss name to its builder, for code that picks one by configuration.
REGISTRY: dict[str, Callable[..., dict[str, Column]]] = {"simpo": simpo, "alpha_dpo": alpha_dpo, "margin_dpo": margin_dpo, "epsilon_dpo": epsilon_dpo}


def accuracy(chosen: Column, rejected: Column) -> Column:
    """Share of rows whose chosen value is larger; NaN is never larger."""
    return F.avg(F.when(F.isnan(chosen) | F.isnan(rejected), 0.0).otherwise((chosen > rejected).cast("double")))
