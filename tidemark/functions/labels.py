"""Labels from numbers: ordered conditions, the first that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def momentum(near: Column, far: Column) -> Column:
    """From two revision percentages; a missing one is neutral."""
    both = lambda low: (near >= low) & (far >= low)
    neither = lambda high: (near <= high) & (far <= high)
    return (
        F.when(both(3.0), "Strong Positive").when(both(1.0), "Positive").when(neither(-3.0), "Strong Negative").when(neither(-1.0), "Negative").otherwise("Neutral")
    )


def revision_regime(near: Column, far: Column) -> Column:
    return (
        F.when(near.isNull() | far.isNull(), "Insufficient Data")
        .when((near < 0) & (far >= 5.0), "Back-end Loaded / Divergent")
        .when((near >= 5.0) & (far < 0), "Front-loaded / Divergent")
        .when((near >= 3.0) & (far >= 3.0), "Broad Upward Revision")
        .when((near <= -3.0) & (far <= -3.0), "Broad Downward Revision")
        .when((F.abs(near) < 1.0) & (F.abs(far) < 1.0), "Stable")
        .when((near > 0) & (far > 0), "Mild Upward")
        .when((near < 0) & (far < 0), "Mild Downward")
        .otherwise("Divergent / Mixed")
    )


def window_momentum(pct: Column) -> Column:
    """The older one-window label, with buckets at one and five percent."""
    return F.when(pct >= 5, "Strong Positive").when(pct >= 1, "Positive").when(pct <= -5, "Strong Negative").when(pct <= -1, "Negative").otherwise("Neutral")


def coverage_confidence(coverage: Column) -> Column:
    n = F.when(coverage >= 0, F.floor(coverage)).otherwise(F.ceil(coverage))
    return F.when(n >= 10, "High").when(n >= 5, "Medium").when(n >= 2, "Low").when(n == 1, "Single estimate").otherwise("Unknown")


def source_severity(pct: Column, coverage: Column, far_forward: Column) -> Column:
    """High needs a coverage of five or more; below, or where it is unknown, the size of the revision decides."""
    size = F.coalesce(F.abs(pct), F.lit(0.0))
    by_size = lambda least: F.when(size >= least, "medium").otherwise("low")
    thin = coverage.isNull() | (coverage < 5)
    return F.when(coverage.isNotNull() & (coverage < 5) & far_forward, by_size(10.0)).when(thin, by_size(5.0)).otherwise("high")


def worst(statuses: Column) -> Column:
    """The worst of an aggregated rank (0 healthy, 1 degraded, 2 failed)."""
    return F.when(statuses >= 2, "FAILED").when(statuses == 1, "DEGRADED").otherwise("HEALTHY")


def collection_failed(gaps: Column) -> Column:
    """A list of gap notes says that collection failed."""
    return F.coalesce(F.exists(gaps, lambda g: F.coalesce(F.lower(g).rlike("pull fail|collection fail|fetch fail"), F.lit(False))), F.lit(False))
