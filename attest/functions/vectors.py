"""Expressions over array columns: all JVM-side, usable in any projection."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v))


def l2_delta(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def argmax(values: Column) -> Column:
    """0-based position of the first largest element."""
    return F.array_position(values, F.array_max(values)) - 1


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def energy_score(logits: Column) -> Column:
    """Free energy of a logit vector, shifted by its maximum so it cannot overflow."""
    return -log_sum_exp(logits)


def entropy(probs: Column) -> Column:
    """Shannon entropy in nats with the logarithm floored at 1e-300."""
    return -F.aggregate(
        probs, F.lit(0.0), lambda a, p: a + p * F.log(F.greatest(p, F.lit(1e-300)))
    )


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    weights = F.transform(values, lambda v: F.exp(v - top))
    scale = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(weights, lambda w: w / scale)


def invalid_vector(values: Column) -> Column:
    """True for a null or empty vector or one holding a non-finite element."""
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return values.isNull() | (F.size(values) == 0) | bad


def channel_means(pixels: Column, channels: int, scale: float = 1.0) -> Column:
    """Mean of each interleaved channel divided by ``scale``; one value per channel."""
    count = F.size(pixels) / F.lit(channels)

    def one(channel: int) -> Column:
        return total(F.filter(pixels, lambda v, i: i % channels == channel)) / count / F.lit(scale)

    return F.array(*[one(c) for c in range(channels)])


def mask_region(
    pixels: Column, width: int, channels: int, x: int, y: int, w: int, h: int, value: float = 0.0
) -> Column:
    """Set a box of a row-major h x w x c array to ``value``."""
    def inside(i: Column) -> Column:
        cell = F.floor(i / F.lit(channels))
        col, row = F.pmod(cell, F.lit(width)), F.floor(cell / F.lit(width))
        return col.between(x, x + w - 1) & row.between(y, y + h - 1)

    return F.transform(pixels, lambda v, i: F.when(inside(i), F.lit(float(value))).otherwise(v))


def mask_positions(values: Column, positions: Column, value: float = 0.0) -> Column:
    """Set the listed 0-based positions (an array column) to ``value``."""
    return F.transform(
        values, lambda v, i: F.when(F.array_contains(positions, i), F.lit(float(value))).otherwise(v)
    )


def mask_channels(pixels: Column, channels: int, chosen: Sequence[int], value: float = 0.0) -> Column:
    """Set whole channels of an interleaved array to ``value``."""
    wanted = F.array(*[F.lit(int(c)) for c in chosen])
    return F.transform(
        pixels,
        lambda v, i: F.when(F.array_contains(wanted, F.pmod(i, F.lit(channels))), F.lit(float(value))).otherwise(v),
    )


def blend(image: Column, background: Column, alpha: float) -> Column:
    return F.zip_with(image, background, lambda a, b: a * F.lit(1.0 - alpha) + b * F.lit(alpha))


def linspace(low: float, high: float, parts: int) -> list[float]:
    """Bin edges by the start + i * step rule, last edge exact."""
    step = (high - low) / parts
    edges = [low + i * step for i in range(parts)] + [high]
    if not all(math.isfinite(e) for e in edges):
        raise ValueError("edges must be finite")
    return edges


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """0-based bin by comparing with explicit edges; the last bin is closed."""
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    return F.size(F.filter(inner, lambda e: e <= value)).cast("int")
