"""Numeric work on short arrays (one number for each letter), in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .letters import MODEL_ORDER


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def normalised(a: Column) -> Column:
    return let(a, lambda x: let(total(x), lambda s: F.transform(x, lambda v: v / s)))


def softmax(logits: Column) -> Column:
    return let(logits, lambda x: let(F.array_max(x), lambda m: normalised(F.transform(x, lambda v: F.exp(v - m)))))


def log_softmax(logits: Column) -> Column:
    return let(
        logits,
        lambda x: let(
            F.array_max(x),
            lambda m: let(F.log(total(F.transform(x, lambda v: F.exp(v - m)))), lambda z: F.transform(x, lambda v: v - m - z)),
        ),
    )


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def temperature_probs(logits: Column, temperature: Column, bias: Column, pos_bias: Column, omit: Column) -> Column:
    """softmax((logits + bias + pos_bias) / T - 1e8 * omit)."""
    shifted = F.zip_with(plus(plus(logits, bias), pos_bias), omit, lambda v, o: v / temperature - 1e8 * o)
    return softmax(shifted)


def letter_mask(wanted: str) -> Column:
    """1 for each letter of the model's order that is in wanted."""
    return F.array(*[F.lit(1.0 if c in wanted else 0.0) for c in MODEL_ORDER])


def blend(probs: Column, coef: Column, bias: Column, strength: float) -> Column:
    """(1 - m * coef) * p + m * coef * bias."""
    return F.zip_with(probs, bias, lambda p, b: (1 - strength * coef) * p + strength * coef * b)


def log_odds_gate(probs: Column, log_odds: Column, threshold: float) -> Column:
    """Weight 1.001 where the log-odds exceed the threshold, else 0.001; renormalised."""
    return normalised(F.zip_with(probs, log_odds, lambda p, o: p * F.when(o > threshold, 1.001).otherwise(0.001)))


def without(probs: Column, omit: Column) -> Column:
    """Omitted letters at zero; renormalised."""
    return normalised(F.zip_with(probs, omit, lambda p, o: p * (1 - o)))


def draw(probs: Column, u: Column) -> Column:
    """The least index whose running sum reaches u; the last one if none does."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
    step = lambda s, p: F.struct((s["sum"] + p).alias("sum"), (s["at"] + F.when(F.round(s["sum"] + p, 9) < u, 1).otherwise(0)).alias("at"))
    return F.least(F.aggregate(probs, start, step, lambda s: s["at"]), F.size(probs) - 1)


def running(probs: Column) -> Column:
    """Running sums to nine places, for many draws from one array."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    step = lambda s, p: F.struct((s["sum"] + p).alias("sum"), F.concat(s["all"], F.array(F.round(s["sum"] + p, 9))).alias("all"))
    return F.aggregate(probs, start, step, lambda s: s["all"])


def draw_from(sums: Column, u: Column) -> Column:
    """draw, from running sums."""
    return F.least(F.size(F.filter(sums, lambda v: v < u)), F.size(sums) - 1)
