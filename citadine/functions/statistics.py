"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisson_llr(n_in: Column, size_in: Column, n_total: Column, size_total: Column) -> Column:
    """Log likelihood ratio of a region; 0 where it holds no more than its expectation, or everything."""
    expected = n_total * size_in / size_total
    rest = n_total - n_in
    value = n_in * F.log(n_in / expected) + rest * F.log(rest / (n_total - expected))
    return F.when((n_in > 0) & (expected > 0) & (n_in > expected) & (n_in < n_total), value).otherwise(0.0)


def entropy_term(count: Column, total: Column) -> Column:
    """-p ln p, 0 for an empty category."""
    p = count / total
    return F.when(count > 0, -p * F.log(p)).otherwise(0.0)


def location_quotient(in_zone: Column, in_city: Column, nodes: Column, city_nodes: Column) -> Column:
    return F.when(in_city == 0, 0.0).otherwise((in_zone / in_city) / (nodes / city_nodes))


def quantized(value: Column, low: Column, high: Column, steps: int = 65535) -> Column:
    """Rounded half to even on a grid of ``steps``; a range of no width counts as 1."""
    width = F.when(high > low, high - low).otherwise(1.0)
    return F.bround((value - low) / width * steps).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)
