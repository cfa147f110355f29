"""Point-in-time windows over a bitemporal history of observations.

An observation has ``entity, period, obs_date, value``, an optional ``update_ts`` (when it became known; else its day's midnight)
and ``seq``, the append order that settles ties. No row that became known after an as-of is ever visible to it.

The as-of joins are a union of probes and observations and one running ``last`` over the series: work and shuffle grow with
the rows, not with their product. The running ``last`` goes by slices (:mod:`tidemark.operators.slices`), so that a long series is many tasks. Histories
with restatements are first brought to at most one row for each day and as-of of a series (:func:`restated_panel`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import effective_time, weekday_gap
from tidemark.functions.fiscal import period_month, period_year
from tidemark.functions.numbers import revision_pct, to_num
from tidemark.operators.slices import running_last

SERIES = ("entity", "period")
#: As-ofs of a restated history that are looked up side by side.
BLOCK = 8


def _with_times(obs: DataFrame) -> DataFrame:
    update = F.col("update_ts").cast("timestamp") if "update_ts" in obs.columns else F.lit(None).cast("timestamp")
    return obs.where("value is not null").select(*SERIES, "obs_date", "seq", F.col("value").cast("double").alias("value"), update.alias("update_ts"), effective_time(update, F.col("obs_date")).alias("known_at"))


def same_day_collapse(obs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per series and day: the latest update visible at ``as_of``; a timed row beats an untimed one, later appends win
    ties."""
    rows = _with_times(obs)
    if as_of is not None:
        rows = rows.where(F.col("known_at") <= as_of)
    order = Window.partitionBy(*SERIES, "obs_date").orderBy(F.col("update_ts").desc_nulls_last(), F.col("seq").desc())
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def _last_before(rows: DataFrame, probes: DataFrame, at: str, carried: tuple[str, ...]) -> DataFrame:
    """For each probe (series, ``at``, further columns) the last of ``rows`` (series, ``at``, carried) at or before it. Of rows with equal ``at`` the
    last in the order of ``carried`` counts."""
    extra = [c for c in probes.columns if c not in (*SERIES, at)]
    empty = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    packed = rows.select(*SERIES, at, F.lit(0).alias("kind"), F.struct(*carried).alias("tie"), F.struct(*carried).alias("found"), *empty(probes, extra))
    asked = probes.select(*SERIES, at, F.lit(1).alias("kind"), *empty(packed, ("tie", "found")), *extra)
    both = running_last(packed.unionByName(asked), SERIES, (at, "kind", "tie"), {"last_found": "found"})
    return both.where("kind = 1").select(*SERIES, at, *extra, F.col("last_found").alias("found"))


def asof_baseline(obs: DataFrame, probes: DataFrame, tolerance: int = 1) -> DataFrame:
    """For each probe (``entity, period, target``) the last observation at or before ``target``; it counts as found only if at
    most ``tolerance`` weekdays lie between. An earlier one is never tried."""
    days = same_day_collapse(obs).withColumn("target", F.col("obs_date")).withColumn("base_date", F.col("obs_date")).withColumn("base_value", F.col("value"))
    found = _last_before(days, probes, "target", ("base_date", "base_value"))
    gap = weekday_gap(F.col("found.base_date"), F.col("target"))
    return found.withColumns({"base_date": F.col("found.base_date"), "gap": gap, "base_value": F.when(gap <= tolerance, F.col("found.base_value"))}).drop("found")


def anchors(obs: DataFrame, grid: DataFrame) -> DataFrame:
    """Every series and as-of of ``grid`` with the latest observation known by then (by effective time, then by append order)."""
    days = same_day_collapse(obs).withColumn("as_of", F.col("known_at"))
    series = days.select(*SERIES).distinct().crossJoin(grid.select(F.col("as_of").cast("timestamp").alias("as_of")))
    found = _last_before(days, series, "as_of", ("obs_date", "value"))
    return found.select(*SERIES, "as_of", F.col("found.obs_date").alias("anchor_date"), F.col("found.value").alias("anchor_value"))


def revision_panel(obs: DataFrame, grid: DataFrame, windows: tuple[int, ...] = (30, 60, 90), tolerance: int = 1) -> DataFrame:
    """The flagship: for every series, as-of of ``grid`` (a small table with ``as_of``) and length in days, the change from the
    baseline before the window to the anchor at its end, or why there is none.

    For histories without later restatements (each day's rows are known on that day). With restatements use
    :func:`restated_panel`. ``grid`` times ``windows`` is the query: its product with the series, not with their rows, is what is asked for.

    Days and probes are brought together by series once: the first running ``last`` over effective time finds the anchors, the second
    over dates finds the baselines, and only a sort lies between them."""
    days = same_day_collapse(obs)
    small = grid.select(F.col("as_of").cast("timestamp").alias("as_of"))
    probes = _with_times(obs).select(*SERIES).distinct().crossJoin(small)
    day = F.struct("obs_date", "value")
    rows = days.select(*SERIES, F.col("known_at").alias("at"), F.lit(0).alias("kind"), day.alias("day"), F.lit(None).cast("timestamp").alias("as_of"))
    asked = probes.select(*SERIES, F.col("as_of").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["day"].dataType).alias("day"), "as_of")
    both = running_last(rows.unionByName(asked), SERIES, ("at", "kind", "day.obs_date"), {"anchor": "day"})
    lengths = F.when(F.col("kind") == 1, F.array(*[F.lit(n) for n in windows])).otherwise(F.array(F.lit(None).cast("int")))
    both = both.select(*SERIES, "kind", "day", "as_of", "anchor", F.explode(lengths).alias("days"))
    target = F.when(F.col("kind") == 0, F.col("day.obs_date")).otherwise(F.date_sub(F.coalesce("anchor.obs_date", F.to_date("as_of")), F.col("days")))
    found = running_last(both.withColumn("target", target), SERIES, ("target", "kind"), {"base": "day"}).where("kind = 1")
    gap = weekday_gap(F.col("base.obs_date"), F.col("target"))
    base = F.when(gap <= tolerance, F.col("base.value"))
    return _judged(found.withColumns({"anchor_date": F.col("anchor.obs_date"), "anchor_value": F.col("anchor.value"), "base_date": F.col("base.obs_date"), "base_value": base}))


def _judged(found: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("anchor_date").isNull(), "no_anchor")
        .when(F.col("base_date").isNull(), "no_baseline")
        .when(F.col("base_value").isNull(), "baseline_gap")
        .when(F.col("base_date") == F.col("anchor_date"), "same_date")
        .when(F.col("base_value") == 0, "zero_baseline")
    )
    start = F.when(F.col("base_date") < F.col("anchor_date"), F.col("base_value"))
    out = found.withColumns({"reason": reason, "status": F.when(reason.isNull(), "ok").otherwise("unavailable"), "start_value": start, "end_value": F.col("anchor_value")})
    out = out.withColumn("pct", F.when(F.col("status") == "ok", revision_pct(F.col("start_value"), F.col("end_value"))))
    return out.select(*SERIES, "as_of", "days", "anchor_date", "target", "base_date", "status", "reason", "start_value", "end_value", "pct")


def restated_panel(obs: DataFrame, grid: DataFrame, windows: tuple[int, ...] = (30, 60, 90), tolerance: int = 1) -> DataFrame:
    """:func:`revision_panel` for any history. An as-of only sees the rows known by then, so a restatement never changes what an earlier
    as-of saw. Rows are dealt twice, and nothing is joined:

    * as-ofs are numbered by time, and an observation has the number of the first one that sees it. Of a day's observations with one number only the best
      counts (an aggregate, begun before rows are dealt), and only if it is better than the day's earlier ones. So however often a series is observed,
      what is dealt by series has at most one row for each of its days and as-ofs;
    * the first row of a series brings the as-ofs along. The anchor of one is the latest of the rows up to its number;
    * the baseline of one is the last day at or before its target among the rows up to its number, and the last such row of that day is what the day showed. A
      running ``last`` for each of ``BLOCK`` numbers finds both at once; a row goes into its own block of numbers and those after it."""
    one = F.struct(F.col("as_of").cast("timestamp").alias("as_of")).alias("one")
    as_ofs = grid.select(one).agg(F.sort_array(F.collect_set("one")).alias("as_ofs"))  # in structs, which keep an as-of of null: the first, which sees nothing
    earlier = F.size(F.filter("as_ofs", lambda g: F.coalesce(g["as_of"] < F.col("known_at"), F.lit(True))))
    rows = _with_times(obs).crossJoin(as_ofs).withColumn("level", earlier)
    rows = rows.withColumn("level", F.when(F.col("known_at").isNotNull() & (F.col("level") < F.size("as_ofs")), F.col("level")))
    seen = F.col("level").isNotNull()
    version = F.struct(F.col("update_ts").isNotNull().alias("timed"), "update_ts", "seq", "known_at", "value")
    days = rows.groupBy(*SERIES, F.when(seen, F.col("obs_date")).alias("obs_date"), "level").agg(F.max(F.when(seen, version)).alias("best"))
    by_level = Window.partitionBy(*SERIES, "obs_date").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("first", F.row_number().over(Window.partitionBy(*SERIES).orderBy("obs_date", "level")) == 1)
    days = days.withColumn("before", F.max("best").over(by_level)).where("first or before is null or best > before")

    itself = F.array(F.lit(None).cast("struct<as_of:timestamp,level:int>"))
    probes = F.transform("as_ofs", lambda g, k: F.struct(g["as_of"].alias("as_of"), k.alias("level")))
    both = days.crossJoin(as_ofs).withColumn("asked", F.explode(F.when(F.col("first"), F.concat(itself, probes)).otherwise(itself)))
    probe = F.col("asked").isNotNull()
    both = both.select(*SERIES, probe.alias("probe"), F.coalesce("asked.level", "level").alias("level"), F.size("as_ofs").alias("n"), "asked.as_of", "obs_date", F.when(~probe, F.col("best")).alias("best"))
    latest = F.when(F.col("best").isNotNull(), F.struct("best.known_at", "obs_date", "best.seq", "best.value"))
    up_to_here = Window.partitionBy(*SERIES).orderBy("level", "probe").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("anchor", F.max(latest).over(up_to_here))

    block = lambda level: F.floor(level / BLOCK).cast("int")
    lengths = F.array(*[F.struct(block(F.col("level")).alias("block"), F.lit(n).alias("days")) for n in windows])
    blocks = F.transform(F.sequence(block(F.col("level")), block(F.col("n") - 1)), lambda b: F.struct(b.alias("block"), F.lit(None).cast("int").alias("days")))
    both = both.withColumn("to", F.explode(F.when(F.col("probe"), lengths).when(F.col("best").isNotNull(), blocks)))
    target = F.date_sub(F.coalesce("anchor.obs_date", F.to_date("as_of")), F.col("to.days"))
    place = F.greatest(F.col("level") - F.col("to.block") * BLOCK, F.lit(0))
    state = F.when(~F.col("probe"), F.struct("obs_date", "best.value"))
    both = both.select(*SERIES, "to.block", "to.days", "as_of", "probe", "level", place.alias("place"), F.when(F.col("probe"), target).otherwise(F.col("obs_date")).alias("target"), "anchor", state.alias("state"))
    by_day = Window.partitionBy(*SERIES, "block").orderBy("target", "probe", "level").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({f"base_{k}": F.last(F.when(F.col("place") <= k, F.col("state")), ignorenulls=True).over(by_day) for k in range(BLOCK)}).where("probe")
    found = found.withColumn("base", F.coalesce(*[F.when(F.col("place") == k, F.col(f"base_{k}")) for k in range(BLOCK)]))
    gap = weekday_gap(F.col("base.obs_date"), F.col("target"))
    base = F.when(gap <= tolerance, F.col("base.value"))
    return _judged(found.withColumns({"anchor_date": F.col("anchor.obs_date"), "anchor_value": F.col("anchor.value"), "base_date": F.col("base.obs_date"), "base_value": base}))


def momentum_table(panel: DataFrame) -> DataFrame:
    """One row per series and as-of with the percentage of each length. :func:`momentum_order` sorts it for display."""
    wide = panel.groupBy(*SERIES, "as_of").pivot("days", [30, 60, 90]).agg(F.first("pct"))
    return wide.select(*SERIES, "as_of", *[F.col(f"`{n}`").alias(f"pct_{n}") for n in (30, 60, 90)])


def with_reported(table: DataFrame, reported: DataFrame) -> DataFrame:
    """``table`` with the source's own one, three and six month percentages (``rev_1m, rev_3m, rev_6m`` as raw texts by entity and period), beside the
    computed ones and never in their place."""
    typed = reported.select(*SERIES, *[to_num(F.col(c)).alias(f"reported_{c[4:]}") for c in ("rev_1m", "rev_3m", "rev_6m")])
    return table.join(typed, list(SERIES), "left")


def momentum_order() -> list[Column]:
    """Entity, then the period's month and year; labels that are no period come last."""
    period = F.col("period")
    return [F.col("entity").asc(), period_month(period).asc_nulls_last(), period_year(period).asc_nulls_last(), period.asc()]


def readiness(panel: DataFrame) -> DataFrame:
    """Per entity and as-of: is there a period with a valid window of each length?"""
    ok = lambda n: F.bool_or((F.col("status") == "ok") & (F.col("days") == n)).alias(f"ready_{n}")
    return panel.groupBy("entity", "as_of").agg(ok(30), ok(60), ok(90))


def default_as_of(obs: DataFrame) -> DataFrame:
    return _with_times(obs).agg(F.max("known_at").alias("as_of"))
