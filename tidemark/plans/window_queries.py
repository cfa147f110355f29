"""Queries over the window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.plans.views import Views, dated, with_views

WEEKDAYS = "(5 * floor(datediff('day', DATE '1969-12-29', {d}) / 7.0) + least(datediff('day', DATE '1969-12-29', {d}) % 7 + 1, 5))"
GAP = f"(greatest(0, {WEEKDAYS.format(d='target')} - {WEEKDAYS.format(d='base_date')}))"

PANEL = f"""
WITH days AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, period, obs_date ORDER BY seq DESC) AS n FROM v_obs) WHERE n = 1),
series AS (SELECT DISTINCT entity, period FROM days),
anchor AS (SELECT s.entity, s.period, g.as_of, max(d.obs_date) AS anchor_date FROM series s CROSS JOIN v_grid g
  LEFT JOIN days d ON d.entity = s.entity AND d.period = s.period AND d.obs_date <= g.as_of GROUP BY ALL),
probe AS (SELECT *, coalesce(anchor_date, as_of) - days AS target FROM anchor CROSS JOIN (SELECT unnest([30, 60, 90]) AS days) w),
base AS (SELECT p.entity, p.period, p.as_of, p.days, p.anchor_date, p.target, max(d.obs_date) AS base_date FROM probe p
  LEFT JOIN days d ON d.entity = p.entity AND d.period = p.period AND d.obs_date <= p.target GROUP BY ALL),
full_ AS (SELECT b.*, a.value AS end_value, s.value AS base_value, {GAP} AS gap FROM base b
  LEFT JOIN days a ON a.entity = b.entity AND a.period = b.period AND a.obs_date = b.anchor_date
  LEFT JOIN days s ON s.entity = b.entity AND s.period = b.period AND s.obs_date = b.base_date),
judged AS (SELECT *, CASE WHEN anchor_date IS NULL THEN 'no_anchor' WHEN base_date IS NULL THEN 'no_baseline' WHEN gap > 1 THEN 'baseline_gap'
  WHEN base_value = 0 THEN 'zero_baseline' END AS reason FROM full_)
"""
PANEL_OUT = """SELECT entity, period, as_of, days, anchor_date, target, base_date, CASE WHEN reason IS NULL THEN 'ok' ELSE 'unavailable' END AS status,
  reason, CASE WHEN gap <= 1 AND anchor_date IS NOT NULL THEN base_value END AS start_value, end_value,
  round(CASE WHEN reason IS NULL THEN (end_value - base_value) / abs(base_value) * 100.0 END, 6) AS pct FROM judged"""


def _panel(v: Views) -> DataFrame:
    return windows.revision_panel(v.obs(), v.grid()).withColumn("as_of", F.to_date("as_of"))


def revision_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(Views(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


def momentum_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = windows.momentum_table(_panel(Views(spark, sf_dir)))
    return wide.select("entity", "period", "as_of", *[F.round(f"pct_{n}", 6).alias(f"pct_{n}") for n in (30, 60, 90)])


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.readiness(_panel(Views(spark, sf_dir)))


CUTOFF = "2024-01-20T12:00:00"


def same_day_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = windows.same_day_collapse(Views(spark, sf_dir).obs_ev(), F.lit(CUTOFF).cast("timestamp"))
    return kept.select("entity", "period", "obs_date", "seq", "value")


def restated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose update time is one to four days after their date, as restatements."""
    obs = Views(spark, sf_dir).obs_ev().withColumn("obs_date", F.date_sub("obs_date", F.pmod("seq", F.lit(4)).cast("int")))
    grid = spark.sql("SELECT explode(sequence(DATE'2024-01-10', DATE'2024-01-30', INTERVAL 4 DAY)) AS as_of")
    out = windows.restated_panel(obs, grid, (7, 14, 21)).withColumn("as_of", F.to_date("as_of"))
    return out.select("entity", "period", "as_of", "days", "anchor_date", "base_date", "status", "reason", F.round("pct", 6).alias("pct"))


RESTATED = f"""
WITH o AS (SELECT entity, period, obs_date - CAST(seq % 4 AS int) AS obs_date, update_ts, seq, value FROM v_obs_ev WHERE value IS NOT NULL),
g AS (SELECT CAST(unnest(generate_series(DATE '2024-01-10', DATE '2024-01-30', INTERVAL 4 DAY)) AS date) AS as_of),
seen AS (SELECT * FROM (SELECT o.*, as_of, row_number() OVER (PARTITION BY entity, period, as_of, obs_date ORDER BY update_ts DESC, seq DESC) AS n
  FROM o JOIN g ON update_ts <= as_of) WHERE n = 1),
anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, period, as_of ORDER BY update_ts DESC, obs_date DESC, seq DESC) AS k FROM seen) WHERE k = 1),
probe AS (SELECT s.entity, s.period, g.as_of, a.obs_date AS anchor_date, a.value AS end_value, w.days, coalesce(a.obs_date, g.as_of) - w.days AS target
  FROM (SELECT DISTINCT entity, period FROM o) s CROSS JOIN g LEFT JOIN anchor a USING (entity, period, as_of) CROSS JOIN (SELECT unnest([7, 14, 21]) AS days) w),
base AS (SELECT p.*, (SELECT max(obs_date) FROM seen s WHERE s.entity = p.entity AND s.period = p.period AND s.as_of = p.as_of AND s.obs_date <= p.target) AS base_date FROM probe p),
f AS (SELECT b.*, s.value AS base_value, {GAP} AS gap FROM base b LEFT JOIN seen s ON s.entity = b.entity AND s.period = b.period AND s.as_of = b.as_of AND s.obs_date = b.base_date),
j AS (SELECT *, CASE WHEN anchor_date IS NULL THEN 'no_anchor' WHEN base_date IS NULL THEN 'no_baseline' WHEN gap > 1 THEN 'baseline_gap' WHEN base_value = 0 THEN 'zero_baseline' END AS reason FROM f)
SELECT entity, period, as_of, days, anchor_date, base_date, CASE WHEN reason IS NULL THEN 'ok' ELSE 'unavailable' END AS status, reason,
  round(CASE WHEN reason IS NULL THEN (end_value - base_value) / abs(base_value) * 100.0 END, 6) AS pct FROM j
"""


def queries() -> dict:
    return {"revision_panel": revision_panel, "momentum_pivot": momentum_pivot, "readiness": readiness, "same_day_collapse": same_day_collapse, "restated_panel": restated_panel}


def oracle_sql() -> dict:
    sql = {
        "revision_panel": PANEL + PANEL_OUT,
        "momentum_pivot": PANEL
        + ", p AS ("
        + PANEL_OUT
        + ") SELECT entity, period, as_of, max(pct) FILTER (days = 30) AS pct_30, max(pct) FILTER (days = 60) AS pct_60, max(pct) FILTER (days = 90) AS pct_90 FROM p GROUP BY ALL",
        "readiness": PANEL
        + "SELECT entity, as_of, bool_or(reason IS NULL AND days = 30) AS ready_30, bool_or(reason IS NULL AND days = 60) AS ready_60, bool_or(reason IS NULL AND days = 90) AS ready_90 FROM judged GROUP BY ALL",
        "same_day_collapse": f"""SELECT entity, period, obs_date, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, period, obs_date
          ORDER BY update_ts DESC, seq DESC) AS n FROM v_obs_ev WHERE update_ts <= TIMESTAMP '{CUTOFF.replace("T", " ")}' AND value IS NOT NULL) WHERE n = 1""",
        "restated_panel": RESTATED,
    }
    dates = {
        "revision_panel": ("as_of", "anchor_date", "target", "base_date"),
        "momentum_pivot": ("as_of",),
        "readiness": ("as_of",),
        "same_day_collapse": ("obs_date",),
        "restated_panel": ("as_of", "anchor_date", "base_date"),
    }
    return {k: dated(with_views(x), *dates[k]) for k, x in sql.items()}
