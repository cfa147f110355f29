"""Valuation, growth, comparison and chart tables. A table of periods has ``entity, slot, value, price`` (a row per display year)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import cagr, growth_adjusted_pe, growth_label, growth_ratio, pe

#: Texts that sort after every number.
AFTER_NUMBERS = ("", "—", "N/M", "Data unavailable")
#: Rows from which the ranges of a ranking are chosen.
RANK_SAMPLE = 4096


def growth_from_prior(rows: DataFrame) -> DataFrame:
    """Growth of each display year over the one before, as a ratio or a label, never both."""
    prior = F.lag("value").over(Window.partitionBy("entity").orderBy("slot"))
    rows = rows.withColumn("prior_value", prior)
    return rows.withColumns({"growth_ratio": growth_ratio(F.col("prior_value"), F.col("value")), "growth_label": growth_label(F.col("prior_value"), F.col("value"))})


def valuation(rows: DataFrame) -> DataFrame:
    """Long form: price over value, growth, growth to the year after next and the price adjusted for it."""
    ahead = F.lead("value", 2).over(Window.partitionBy("entity").orderBy("slot"))
    out = growth_from_prior(rows).withColumn("pe", pe(F.col("price"), F.col("value"))).withColumn("cagr_2y", cagr(F.col("value"), ahead))
    return out.withColumn("growth_adjusted_pe", growth_adjusted_pe(F.col("pe"), F.col("cagr_2y")))


def valuation_wide(long: DataFrame, years: list[str], metrics: tuple[str, ...] = ("value", "pe", "growth_ratio", "growth_label")) -> DataFrame:
    """A row per entity, a column per metric and display year."""
    wide = long.groupBy("entity").pivot("slot", years).agg(*[F.first(m).alias(m) for m in metrics])
    return wide.select("entity", *[F.col(f"`{y}_{m}`").alias(f"{m}_{y}") for y in years for m in metrics])


def attach_windows(rows: DataFrame, momentum: DataFrame) -> DataFrame:
    """Window percentages by (entity, period); a coverage that is missing is filled from the windows' side, others stay."""
    extra = [c for c in momentum.columns if c not in ("entity", "period", "coverage")]
    side = momentum.select("entity", "period", *extra, *([F.col("coverage").alias("window_coverage")] if "coverage" in momentum.columns else []))
    out = rows.join(side, ["entity", "period"], "left")
    if "window_coverage" in out.columns:
        out = out.withColumn("coverage", F.coalesce("coverage", "window_coverage")).drop("window_coverage")
    return out


def comparison(long: DataFrame, year: str, momentum: DataFrame | None = None) -> DataFrame:
    """The rows of one display year with all metrics (and windows)."""
    rows = long.where(F.col("slot") == year)
    return rows if momentum is None else attach_windows(rows, momentum)


def comparison_order(column: str, descending: bool = False, label: str | None = None, text: bool = False) -> list[Column]:
    """Sort keys: numbers in the asked order, everything else after them in either order, ties by entity from A to Z. ``label`` names a
    column whose text stands in for a number and so sorts after them."""
    after, key = _after_and_key(column, label, text)
    return [after.asc(), key.desc() if descending else key.asc(), F.col("entity").asc()]


def _after_and_key(column: str, label: str | None, text: bool = False) -> tuple[Column, Column]:
    c = F.col(column)
    after = c.isNull() | (F.trim(c.cast("string")).isin(*AFTER_NUMBERS)) if text else c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if label is not None:
        after = after | F.col(label).isNotNull()
    return after, F.when(~after, c)


def ranked(rows: DataFrame, column: str, descending: bool = False, label: str | None = None) -> DataFrame:
    """``rows`` with ``place`` in :func:`comparison_order` of a numeric column. Rows are dealt to ranges whose bounds come from RANK_SAMPLE rows
    at most; places count within a range and go on from the rows of the ranges before, a number a range."""
    after, key = _after_and_key(column, label)
    rows = rows.withColumn("rank_key", F.struct(after.cast("int").alias("after"), (-key if descending else key).alias("key"), F.col("entity").alias("entity")))
    sample = [r[0] for r in rows.select("rank_key").orderBy(F.xxhash64("rank_key")).limit(RANK_SAMPLE).orderBy("rank_key").collect()]
    ranges = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(sample) // 16))
    bounds = [sample[k * len(sample) // ranges] for k in range(1, ranges)]
    kind = rows.schema["rank_key"].dataType
    below = F.filter(F.array(*[F.struct(*[F.lit(v) for v in x]).cast(kind) for x in bounds]), lambda x: x <= F.col("rank_key")) if bounds else F.array()
    rows = rows.withColumn("rank_range", F.size(below))
    counts = rows.groupBy("rank_range").agg(F.count("*").alias("n"))
    starts = counts.select("rank_range", (F.sum("n").over(Window.orderBy("rank_range")) - F.col("n")).alias("rank_start"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("rank_range").orderBy("rank_key")) + F.col("rank_start")
    return rows.join(starts, "rank_range").withColumn("place", place).drop("rank_key", "rank_range", "rank_start")


def leaders(rows: DataFrame) -> DataFrame:
    """One row per headline: who leads and with what; equal values go to the first entity from A to Z. Partial aggregates only."""

    def best(name: str, column: str, largest: bool, where: Column) -> tuple[str, Column]:
        v = F.when(where & F.col(column).isNotNull(), F.struct((-F.col(column) if largest else F.col(column)).alias("k"), F.col("entity").alias("entity"), F.col(column).alias("v")))
        return name, F.min(v)

    wanted = [
        best("largest_up", "near", True, F.col("near") > 0),
        best("largest_down", "near", False, F.col("near") < 0),
        best("largest_far_up", "far", True, F.col("far") > 0),
        best("lowest_pe", "pe", False, F.col("pe") > 0),
        best("fastest_cagr", "cagr_2y", True, F.lit(True)),
    ]
    one = rows.agg(F.array(*[F.struct(F.lit(n).alias("headline"), v.alias("best")) for n, v in wanted]).alias("all"))
    return one.select(F.explode("all").alias("x")).where("x.best is not null").select("x.headline", "x.best.entity", F.col("x.best.v").alias("metric"))


def index_series(rows: DataFrame, order: str = "obs_date") -> DataFrame:
    """Each series over its first usable value (not NULL, not zero), times 100; NULL before it."""
    w = Window.partitionBy("entity", "period").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.first(F.when(F.col("value") != 0, F.col("value")), ignorenulls=True).over(w)
    return rows.withColumn("base", base).withColumn("index_value", F.col("value") / F.col("base") * 100.0)


def aligned_series(rows: DataFrame, entity: str) -> DataFrame:
    """All dates of one entity by all its series, NULL where a series has none; series without any value are left out."""
    mine = rows.where(F.col("entity") == entity)
    series = mine.groupBy("period").agg(F.count("value").alias("n")).where("n > 0").select("period")
    dates = mine.select("obs_date").distinct()
    grid = dates.crossJoin(series)  # a handful of display years
    return grid.join(mine.select("obs_date", "period", "value"), ["obs_date", "period"], "left")


def period_index(slots: DataFrame, reported: DataFrame) -> DataFrame:
    """Display slots, then reported rows that map into a display year; the first row of each (entity, period) wins."""
    both = slots.withColumn("source_rank", F.lit(0)).unionByName(reported.withColumn("source_rank", F.lit(1)))
    first = Window.partitionBy("entity", "period").orderBy("source_rank", "seq")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "source_rank")
