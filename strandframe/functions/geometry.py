"""Geometry on coordinate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of b x c, b and c in the virtual CB.
CB_CROSS, CB_B, CB_C = -0.58273431, 0.56802827, -0.54067466


def distance(a: list[Column], b: list[Column], eps: float = 1e-6) -> Column:
    d = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        d = d + (x - y) * (x - y)
    return F.sqrt(d + eps)


def virtual_cbeta(n: list[Column], ca: list[Column], c: list[Column]) -> list[Column]:
    b = [y - x for x, y in zip(n, ca, strict=True)]
    d = [y - x for x, y in zip(ca, c, strict=True)]
    cross = [b[1] * d[2] - b[2] * d[1], b[2] * d[0] - b[0] * d[2], b[0] * d[1] - b[1] * d[0]]
    return [CB_CROSS * cross[i] + CB_B * b[i] + CB_C * d[i] + ca[i] for i in range(3)]


def rbf(d: Column, low: float = 2.0, high: float = 22.0, count: int = 16) -> Column:
    """Array of Gaussians of d around evenly spaced centres, each an expression of its own, so that they are compiled and one can be taken alone."""
    sigma = (high - low) / count
    scaled = [(d - (low + i * ((high - low) / (count - 1)))) / sigma for i in range(count)]
    return F.array(*[F.exp(-(t * t)) for t in scaled])


def relative_position(offset: Column, same_chain: Column, most: int = 32) -> Column:
    """Clipped offset as a class; one class more for pairs of different chains."""
    return F.when(same_chain == 1, F.least(F.greatest(offset + most, F.lit(0)), F.lit(2 * most))).otherwise(2 * most + 1)


def normal(*keys: Column) -> Column:
    """A standard normal number drawn by the keys: two uniforms from their MD5, then Box and Muller's formula."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary"))
    uniform = lambda at: (F.conv(F.substring(digest, at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * F.lit(3.141592653589793) * uniform(13))
