"""Scalar metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 9223372036854775807


def loc(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0)) + 1


def halstead_volume(n1: Column, n2: Column, big_n1: Column, big_n2: Column) -> Column:
    """length * log2(vocabulary); null for a vocabulary below 2 or an empty text."""
    vocabulary, length = n1 + n2, big_n1 + big_n2
    return F.when((vocabulary >= 2) & (length > 0), length * F.log2(vocabulary.cast("double")))


def maintainability_index(volume: Column, cyclomatic: Column, lines: Column) -> Column:
    """0 to 100; null without a positive volume."""
    raw = 171.0 - 5.2 * F.log(volume) - 0.23 * cyclomatic - 16.2 * F.log(lines.cast("double"))
    return F.when(volume > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100.0 / 171.0)))


def saturating_product(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a.cast("long"), b.cast("long")), F.when(a.isNotNull() & b.isNotNull(), F.lit(MOST)))


def instability(fan_in: Column, fan_out: Column) -> Column:
    """Ce / (Ca + Ce); null for an isolated module."""
    return F.when(fan_in + fan_out > 0, fan_out / (fan_in + fan_out))


def information_flow(fan_in: Column, fan_out: Column) -> Column:
    """(in * out)^2."""
    flow = saturating_product(fan_in, fan_out)
    return saturating_product(flow, flow)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def count_similarity(a: Column, b: Column) -> Column:
    """1 - |a - b| / max; 1 if both are 0."""
    most = F.greatest(a, b)
    return F.when(most == 0, 1.0).otherwise(1.0 - F.abs(a - b) / most)
