"""Clocks: skew between two, ages, and the enum codes of states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew_seconds(remote: Column, before: Column, after: Column) -> Column:
    """How far a remote clock runs ahead of the middle of a request (all in microseconds)."""
    return (remote - (before + after) / 2) / 1e6


def skewed(skew: Column, tolerance: float = 0.5) -> Column:
    return F.abs(skew) > tolerance


def lag_seconds(now_us: Column, source_ms: Column) -> Column:
    """Never negative; null where the source time is unknown (0 or less)."""
    return F.when(source_ms > 0, F.greatest((now_us - source_ms * 1000) / 1e6, F.lit(0.0)))


def code_of(state: Column, codes: dict[str, int], other: int = -1) -> Column:
    out = None
    for name, n in codes.items():
        out = F.when(state == name, n) if out is None else out.when(state == name, n)
    return F.lit(other) if out is None else out.otherwise(other)
