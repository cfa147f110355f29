"""Health of a history and its derived tables: one row per check, and the worst of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import month_key
from tidemark.functions.labels import worst
from tidemark.operators import history

HEALTHY, DEGRADED, FAILED = 0, 1, 2


def checked(rows: DataFrame, *checks: tuple[str, Column, int, bool]) -> DataFrame:
    """A row for each of ``checks`` (name, which rows count, level, whether there must be some instead of none), from one pass over ``rows``."""
    counts = rows.agg(*[F.count_if(counted).alias(name) for name, counted, _, _ in checks])
    found = [F.struct(F.lit(name).alias("check"), F.col(name).alias("n"), F.when((F.col(name) > 0) == some, HEALTHY).otherwise(level).alias("rank")) for name, _, level, some in checks]
    return counts.select(F.inline(F.array(*found)))


def history_health(rows: DataFrame, runtime: DataFrame, readiness: DataFrame, quarantined: DataFrame, freshness: DataFrame) -> DataFrame:
    """``check, n, rank``: conflicts, exact duplicates, emptiness, rows in a wrong month partition, difference to the runtime table, entities without a valid
    window, quarantined snapshots, stale entities."""
    columns = list(history.OBSERVATION)
    every, kind = F.lit(True), F.col("kind")
    misplaced = month_key(F.col("obs_date")) != F.col("month") if "month" in rows.columns else F.lit(False)
    checks = [
        checked(history.identity_groups(rows), ("conflicting_identities", kind == "conflict", FAILED, False), ("exact_duplicates", kind == "exact_duplicate", DEGRADED, False)),
        checked(rows, ("history_rows", every, FAILED, True), ("wrong_month", misplaced, FAILED, False)),
        checked(history.table_differences(rows.select(*columns), runtime.select(*columns)), ("runtime_differences", every, FAILED, False)),
        checked(readiness, ("not_ready", ~F.col("ready_30") & ~F.col("ready_60") & ~F.col("ready_90"), DEGRADED, False)),
        checked(quarantined, ("quarantined", every, DEGRADED, False)),
        checked(freshness, ("stale_entities", F.col("stale"), DEGRADED, False)),
    ]
    return reduce(DataFrame.unionByName, checks)


def overall(checks: DataFrame) -> DataFrame:
    return checks.agg(worst(F.max("rank")).alias("status"), F.count_if(F.col("rank") > HEALTHY).alias("n_findings"))
