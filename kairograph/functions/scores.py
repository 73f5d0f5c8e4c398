"""Probabilities and weights as column expressions. Minus infinity is a null log-probability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Stands for minus infinity where log-probabilities are added up along a beam.
NO_SCORE = -1e9


def log_sum_exp(x: Column, group: WindowSpec) -> Column:
    """ln of the sum of exponentials over a window, by its greatest value; null without values."""
    top = F.max(x).over(group)
    return top + F.log(F.sum(F.exp(x - top)).over(group))


def log_softmax(x: Column, group: WindowSpec) -> Column:
    """Log-probabilities over a window; null stays null, all null is uniform."""
    uniform = -F.log(F.count(F.lit(1)).over(group).cast("double"))
    return F.when(F.max(x).over(group).isNull(), uniform).otherwise(x - log_sum_exp(x, group))


def softmax(x: Column, group: WindowSpec) -> Column:
    return F.coalesce(F.exp(log_softmax(x, group)), F.lit(0.0))


def minmax_softmax(x: Column, group: WindowSpec) -> Column:
    """Softmax of the values scaled to 0..1; equal values are uniform."""
    low, high = F.min(x).over(group), F.max(x).over(group)
    scaled = F.when(F.abs(high - low) < 1e-12, F.lit(1.0)).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))
    return softmax(scaled, group)


def clipped_share(x: Column, group: WindowSpec) -> Column:
    """Positive part as a share of the positive parts; uniform where there are none."""
    part = F.greatest(x, F.lit(0.0))
    total = F.sum(part).over(group)
    return F.when(total > 0, part / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(group))


def mix_log_probs(llm: Column, graph: Column, alpha: Column) -> Column:
    """ln((1 - alpha) e^llm + alpha e^graph); the ends take one side whole; null is minus infinity."""
    a = F.log(F.greatest(1 - alpha, F.lit(1e-12))) + llm
    b = F.log(F.greatest(alpha, F.lit(1e-12))) + graph
    top = F.greatest(a, b)
    both = top + F.log(F.coalesce(F.exp(a - top), F.lit(0.0)) + F.coalesce(F.exp(b - top), F.lit(0.0)))
    return F.when(alpha <= 0, llm).when(alpha >= 1, graph).otherwise(both)


def mix_probs(llm: Column, graph: Column, alpha: Column) -> Column:
    """ln of the mixed probability, never below 1e-300."""
    return F.log(F.greatest((1 - alpha) * llm + alpha * graph, F.lit(1e-300)))


def alpha_of_level(level: int, levels: Sequence[float] | None, final: float) -> float:
    """Weight of the graph score at a level (from 0): by list, else ``final`` at levels 2 and 3 only."""
    if levels is not None:
        return float(levels[level])
    return float(final) if level in (2, 3) else 0.0


def hop_weight(hops: Column, gamma: float) -> Column:
    return F.exp(-F.lit(gamma) * (hops - 1))


def frequency_weight(count: Column, gamma: float) -> Column:
    return F.lit(1.0) / (F.lit(gamma) * F.log(F.greatest(count, F.lit(1)).cast("double")) + 1.0)


def recency_weight(age: Column, gamma: float, delta: float) -> Column:
    return F.exp(-F.lit(gamma) * (age / F.lit(delta)))


def cooccurrence_weight(count: Column, gamma: float) -> Column:
    x = F.log(F.lit(1.0) + F.lit(gamma) * count)
    return x / (1.0 + x)


def hash_uniform(*keys: Column, seed: int = 0) -> Column:
    """A reproducible number in [0, 1): 52 bits of the md5 of the keys' texts."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(16.0**13)
