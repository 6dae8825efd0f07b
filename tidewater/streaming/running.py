"""Running statistics over a stream of batches (an extension: the offline fold is operators.stats.running)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_stream(stream: DataFrame, key: str, step: str, mean: str, std: str, decay: float, first: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(key, step, mean, std) after each step of a stream of per-step statistics; one state row of two numbers per key. Steps
    count in the order of their batches, and by step within one. A batch's steps of a key are sorted and folded in Python: they are a row each, not
    one per pair."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, s = state.get if state.exists else first
        rows = pd.concat(list(frames)).sort_values(step)
        out = []
        for at, x, y in zip(rows[step], rows[mean], rows[std], strict=True):
            m, s = decay * m + (1 - decay) * x, decay * s + (1 - decay) * y
            out.append((k[0], int(at), m, s))
        state.update((m, s))
        yield pd.DataFrame(out, columns=["key", "step", "mean", "std"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"key {kind}, step long, mean double, std double", "mean double, std double", "append", GroupStateTimeout.NoTimeout)
