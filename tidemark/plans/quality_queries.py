"""Queries over valuation, comparison and the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import quality, valuation
from tidemark.plans.views import Views, dated, with_views

VAL = """
SELECT concat(entity, ' ', period) AS entity, concat(CAST(year(obs_date) AS string), 'E') AS slot, avg(value) - 150000 AS value, max(value) AS price, count(*) AS coverage
FROM v_obs GROUP BY entity, period, year(obs_date)
"""
YEARS = ["1995E", "1996E", "1997E", "1998E", "1999E", "2000E", "2001E"]
# Snapshots as text: months as snapshots; some counts are zero, some highs too low, some labels empty or years, some values not numbers.
GATE_ROWS = """
SELECT CAST(snap_date AS string) AS snapshot_id, entity, concat(CAST(CAST(coverage AS int) AS string), 'E') AS slot, period AS period_name,
  CASE WHEN coverage % 17 = 0 THEN '' WHEN coverage % 19 = 0 THEN 'FY1997' ELSE period END AS label,
  CASE WHEN coverage % 13 = 0 THEN 'later' ELSE CAST(CAST(round(value) AS bigint) AS string) END AS value,
  CAST(CAST(round(CASE WHEN coverage % 11 = 0 THEN value * 0.5 ELSE high END) AS bigint) AS string) AS high, CAST(CAST(floor(low) AS bigint) AS string) AS low,
  CAST(CAST(CASE WHEN coverage % 23 = 0 THEN 0 ELSE coverage END AS int) AS string) AS coverage, CAST(NULL AS string) AS rev_1m
FROM v_snap
"""


def _val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VAL.replace("v_obs", "{v}"), v=Views(spark, sf_dir).obs())


def growth_labels(spark, sf_dir):
    out = valuation.growth_from_prior(_val(spark, sf_dir))
    return out.select("entity", "slot", F.round("value", 6).alias("value"), F.round("growth_ratio", 6).alias("growth_ratio"), "growth_label")


def _valuation(spark, sf_dir):
    return valuation.valuation(_val(spark, sf_dir))


def valuation_long(spark, sf_dir):
    return _valuation(spark, sf_dir).select("entity", "slot", *[F.round(c, 6).alias(c) for c in ("pe", "cagr_2y", "growth_adjusted_pe")])


def valuation_wide(spark, sf_dir):
    wide = valuation.valuation_wide(_valuation(spark, sf_dir), YEARS, ("pe", "growth_label"))
    return wide.select("entity", *[F.round(c, 6).alias(c) if c.startswith("pe_") else F.col(c) for c in wide.columns[1:]])


def comparison_sorted(spark, sf_dir):
    rows = valuation.comparison(_valuation(spark, sf_dir), "1998E")
    return valuation.ranked(rows, "growth_ratio", descending=True, label="growth_label").select("place", "entity", F.round("growth_ratio", 6).alias("growth_ratio"), "growth_label")


def valuation_sorted(spark, sf_dir):
    rows = valuation.comparison(_valuation(spark, sf_dir), "1999E")
    return valuation.ranked(rows, "pe").select("place", "entity", F.round("pe", 6).alias("pe"))


def _moves(spark, sf_dir):
    """Month-over-month percentages of a series: near is the last one, far the one before."""
    snap = quality.against_previous(Views(spark, sf_dir).snap())
    pct = (F.col("value") - F.col("previous_value")) / F.abs("previous_value") * 100.0 / 10.0
    from pyspark.sql import Window

    w = Window.partitionBy("entity", "period").orderBy("snap_date")
    return snap.withColumn("near", pct).withColumn("far", F.lag("near").over(w))


def momentum_regime(spark, sf_dir):
    rows = _moves(spark, sf_dir)
    return rows.select("entity", "period", "snap_date", labels.momentum(F.col("near"), F.col("far")).alias("momentum"), labels.revision_regime(F.col("near"), F.col("far")).alias("regime"), labels.coverage_confidence(F.col("coverage")).alias("confidence"))


def leaders(spark, sf_dir):
    """Over all months of all series."""
    rows = _moves(spark, sf_dir).select(F.concat_ws(" ", "entity", "period").alias("series"), F.concat_ws(" ", "entity", "period", F.date_format("snap_date", "yyyy-MM")).alias("entity"), "near", "far")
    val = valuation.comparison(_valuation(spark, sf_dir), "1998E").select(F.col("entity").alias("series"), "pe", "cagr_2y")
    out = valuation.leaders(rows.join(val, "series", "left"))
    return out.select("headline", "entity", F.round("metric", 6).alias("metric"))


def index_series(spark, sf_dir):
    snap = Views(spark, sf_dir).snap().withColumn("value", F.when(F.col("coverage") % 5 != 0, F.col("value")))
    out = valuation.index_series(snap, "snap_date")
    return out.select("entity", "period", "snap_date", F.round("index_value", 6).alias("index_value"))


def aligned_series(spark, sf_dir):
    snap = Views(spark, sf_dir).snap().select("entity", "period", F.col("snap_date").alias("obs_date"), "value")
    return valuation.aligned_series(snap, "ASIA").withColumn("value", F.round("value", 6))


def _rows(spark, sf_dir, more: str = ""):
    views = Views(spark, sf_dir)
    rows = spark.sql(GATE_ROWS.replace("SELECT ", f"SELECT {more}", 1).replace("v_snap", "{v}"), v=views.snap())
    ends = views.table("region").select(F.col("r_name").alias("entity"), F.when(F.col("r_name").startswith("A"), 6).alias("fiscal_end_month"))
    return quality.normalized_snapshot(rows, ends)


def _prices(spark, sf_dir):
    return Views(spark, sf_dir).snap().groupBy(F.col("snap_date").cast("string").alias("snapshot_id"), "entity").agg((F.sum("price") - 500000).cast("string").alias("price"))


def row_errors(spark, sf_dir):
    rows = quality.row_errors(_rows(spark, sf_dir))
    return rows.select("snapshot_id", "entity", "period_name", F.array_join("errors", ";").alias("errors"))


def entity_gate(spark, sf_dir):
    out = quality.entity_gate(_rows(spark, sf_dir), _prices(spark, sf_dir))
    return out.select("snapshot_id", "entity", "n_usable", "zero_coverage", "rejected", F.array_join("errors", ";").alias("errors"))


def watchlist_diff(spark, sf_dir):
    rows = Views(spark, sf_dir).snap()
    received = rows.where("entity <> 'ASIA'").select("entity")
    expected = rows.where("entity <> 'EUROPE'").select("entity").unionByName(spark.createDataFrame([("ARCTIC",)], "entity string"))
    return quality.watchlist_diff(received, expected)


def last_known_good(spark, sf_dir):
    rows = Views(spark, sf_dir).snap().select(F.col("snap_date").cast("string").alias("snapshot_id"), "entity", "period", F.round("value", 4).cast("string").alias("value"), (F.month("snap_date") % 3 == 0).alias("failed"))
    return quality.last_known_good(rows, F.lit("2000-07-01"))


def extreme_changes(spark, sf_dir):
    out = quality.extreme_changes(quality.against_previous(Views(spark, sf_dir).snap()))
    return out.select("entity", "period", "snap_date", F.round("change_pct", 6).alias("change_pct"))


def price_outliers(spark, sf_dir):
    out = quality.price_outliers(quality.against_previous(Views(spark, sf_dir).snap()))
    return out.select("entity", "period", "snap_date", F.round("price", 2).alias("price"), F.round("previous_price", 2).alias("previous_price"))


def _counts(spark, sf_dir):
    from pyspark.sql import Window

    rows = Views(spark, sf_dir).snap().where("coverage % 4 <> 0")
    n = rows.groupBy("entity", "snap_date").agg(F.count("*").alias("n_new"))
    return n.withColumn("n_old", F.lag("n_new").over(Window.partitionBy("entity").orderBy("snap_date")))


def coverage_regression(spark, sf_dir):
    return quality.coverage_regression(_counts(spark, sf_dir))


def gate_report(spark, sf_dir):
    """One decision for each month, from all checks."""
    more = "value AS number, price AS paid, coverage < 4 AS paid_checked, coverage % 4 <> 0 AS counted, "
    flags = quality.snapshot_flags(_rows(spark, sf_dir, more), 400.0, 900.0, entity_price=(F.sum("paid") - 500000).cast("string"))
    ts = F.concat("snapshot_id", F.when(F.month(F.to_date("snapshot_id")) == 2, "T08:00:00").otherwise("T08:00:00Z"))
    flags = flags.withColumns({"collected_at": ts, "source_as_of": F.lit(None).cast("string"), "snapshot_utc": F.lit(None).cast("string"), "n_missing": F.when(F.month(F.to_date("snapshot_id")) == 5, 1).otherwise(0)})
    out = quality.gate_decision(quality.timestamp_gate(flags, F.lit("2001-05-05T00:00:00Z").cast("timestamp"), backfill=True))
    return out.select("snapshot_id", "status", "reason", "publishable")


def completeness(spark, sf_dir):
    gate = quality.entity_gate(_rows(spark, sf_dir), _prices(spark, sf_dir))
    return quality.completeness(gate.withColumn("collected", ~F.col("rejected")))


def known_good_fill(spark, sf_dir):
    """Current values of the entities before C; the newest month of each is the last known good."""
    snap = Views(spark, sf_dir).snap().groupBy("entity", "snap_date").agg(F.round(F.avg("value"), 4).alias("value"))
    newest = snap.groupBy("entity").agg(F.max_by("value", "snap_date").alias("value"))
    watch = snap.select("entity").distinct().unionByName(spark.createDataFrame([("ARCTIC",)], "entity string"))
    return quality.filled_from_known_good(watch, newest.where("entity < 'C'"), newest.where("entity <> 'ASIA'"), ("value",))


def queries() -> dict:
    names = (growth_labels, valuation_long, valuation_wide, comparison_sorted, valuation_sorted, momentum_regime, leaders, index_series, aligned_series, row_errors, entity_gate, watchlist_diff)
    names += (last_known_good, extreme_changes, price_outliers, coverage_regression, gate_report, completeness, known_good_fill)
    return {f.__name__: f for f in names}


D = "va AS (" + VAL + ")"
GROWTH = (
    D
    + """, g AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY slot) AS prior, lead(value, 2) OVER (PARTITION BY entity ORDER BY slot) AS ahead FROM va),
v AS (SELECT *, CASE WHEN prior > 0 AND value >= 0 THEN (value - prior) / prior END AS growth_ratio,
  CASE WHEN prior < 0 AND value > 0 THEN 'Turn profitable' WHEN prior > 0 AND value < 0 THEN 'Turn loss' WHEN prior < 0 AND value = 0 THEN 'Break-even'
    WHEN prior < 0 AND value > prior THEN 'Loss narrowing' WHEN prior < 0 AND value < prior THEN 'Loss widening' WHEN prior < 0 THEN 'Loss unchanged' END AS growth_label,
  CASE WHEN value > 0 THEN price / value END AS pe, CASE WHEN value > 0 AND ahead > 0 THEN pow(ahead / value, 0.5) - 1 END AS cagr_2y FROM g)
"""
)
PREV = "pv AS (SELECT *, lag(value) OVER w AS previous_value, lag(price) OVER w AS previous_price FROM v_snap WINDOW w AS (PARTITION BY entity, period ORDER BY snap_date))"
MOVES = PREV + ", mv AS (SELECT *, (value - previous_value) / abs(previous_value) * 10.0 AS near FROM pv), m2 AS (SELECT *, lag(near) OVER (PARTITION BY entity, period ORDER BY snap_date) AS far FROM mv)"
ERRORS = (
    "rw AS ("
    + GATE_ROWS
    + """), nm AS (SELECT *, CASE WHEN label = '' THEN NULL WHEN label = 'FY1997' THEN CASE WHEN entity LIKE 'A%' THEN 'Jun 1997' END ELSE label END AS period,
  TRY_CAST(value AS double) AS v, TRY_CAST(high AS double) AS h, TRY_CAST(low AS double) AS l FROM rw),
er AS (SELECT *, [x FOR x IN [CASE WHEN v IS NOT NULL AND period IS NULL THEN CASE WHEN label = '' THEN 'missing_fiscal_identity' ELSE 'fiscal_identity_unnormalizable:' || label END END,
  CASE WHEN v IS NULL THEN 'consensus_not_numeric' END, CASE WHEN NOT (l <= v AND v <= h) THEN 'dispersion_order' END] IF x IS NOT NULL] AS errors FROM nm),
pr AS (SELECT CAST(snap_date AS VARCHAR) AS snapshot_id, entity, sum(price) - 500000 AS price FROM v_snap GROUP BY 1, 2),
eg AS (SELECT snapshot_id, entity, count(*) FILTER (v IS NOT NULL) AS n_usable, flatten(list(errors)) AS es, count(nullif(label, '')) AS nl, count(DISTINCT nullif(label, '')) AS nd,
  bool_or(v IS NOT NULL AND coverage = '0') AS zero_coverage FROM er GROUP BY 1, 2),
gt AS (SELECT snapshot_id, entity, n_usable, zero_coverage, list_sort(list_concat(es, [x FOR x IN [CASE WHEN price <= 0 THEN 'price_invalid' END,
  CASE WHEN n_usable < 2 THEN 'min_fiscal_rows:' || n_usable || '<2' END, CASE WHEN nl > nd THEN 'duplicate_reported_fiscal' END] IF x IS NOT NULL])) AS errors FROM eg JOIN pr USING (snapshot_id, entity))
"""
)
COUNTS = "ct AS (SELECT entity, snap_date, count(*) AS n_new FROM v_snap WHERE coverage % 4 <> 0 GROUP BY 1, 2), cn AS (SELECT *, lag(n_new) OVER (PARTITION BY entity ORDER BY snap_date) AS n_old FROM ct)"
REGRESSED = "n_old >= 2 AND n_new < n_old AND (n_new <= n_old - 2 OR (n_old >= 4 AND n_new <= n_old // 2))"


def _outlier(pct: float) -> str:
    r = "(price / previous_price)"
    scale = " OR ".join(f"abs({r} - {f}) < 0.05 * {f} OR abs({r} - 1.0 / {f}) < 0.05 / {f} OR abs({r} - {f}) / {f} < 0.02 OR abs({r} * {f} - 1.0) < 0.02" for f in ("10.0", "100.0"))
    return f"price > 0 AND previous_price <> 0 AND (abs(price - previous_price) / abs(previous_price) * 100.0 > {pct} OR {scale})"


def oracle_sql() -> dict:
    wide = ", ".join(f"max(round(pe, 6)) FILTER (slot = '{y}') AS \"pe_{y}\", max(growth_label) FILTER (slot = '{y}') AS \"growth_label_{y}\"" for y in YEARS)
    lead = "SELECT '{0}' AS headline, arg_min(entity, entity) AS entity, round(max({1}), 6) AS metric FROM jn WHERE {1} = (SELECT {2}({1}) FROM jn WHERE {3}) AND {3}"
    sql = {
        "growth_labels": f"WITH {GROWTH} SELECT entity, slot, round(value, 6) AS value, round(growth_ratio, 6) AS growth_ratio, growth_label FROM v",
        "valuation_long": f"WITH {GROWTH} SELECT entity, slot, round(pe, 6) AS pe, round(cagr_2y, 6) AS cagr_2y, round(CASE WHEN cagr_2y > 0 THEN pe / (cagr_2y * 100.0) END, 6) AS growth_adjusted_pe FROM v",
        "valuation_wide": f"WITH {GROWTH} SELECT entity, {wide} FROM v GROUP BY entity",
        "comparison_sorted": f"WITH {GROWTH} SELECT row_number() OVER (ORDER BY growth_ratio IS NULL OR growth_label IS NOT NULL, growth_ratio DESC, entity) AS place, entity, round(growth_ratio, 6) AS growth_ratio, growth_label FROM v WHERE slot = '1998E'",
        "valuation_sorted": f"WITH {GROWTH} SELECT row_number() OVER (ORDER BY pe IS NULL, pe, entity) AS place, entity, round(pe, 6) AS pe FROM v WHERE slot = '1999E'",
        "momentum_regime": f"""WITH {MOVES} SELECT entity, period, snap_date,
          CASE WHEN near >= 3 AND far >= 3 THEN 'Strong Positive' WHEN near >= 1 AND far >= 1 THEN 'Positive' WHEN near <= -3 AND far <= -3 THEN 'Strong Negative'
            WHEN near <= -1 AND far <= -1 THEN 'Negative' ELSE 'Neutral' END AS momentum,
          CASE WHEN near IS NULL OR far IS NULL THEN 'Insufficient Data' WHEN near < 0 AND far >= 5 THEN 'Back-end Loaded / Divergent' WHEN near >= 5 AND far < 0 THEN 'Front-loaded / Divergent'
            WHEN near >= 3 AND far >= 3 THEN 'Broad Upward Revision' WHEN near <= -3 AND far <= -3 THEN 'Broad Downward Revision' WHEN abs(near) < 1 AND abs(far) < 1 THEN 'Stable'
            WHEN near > 0 AND far > 0 THEN 'Mild Upward' WHEN near < 0 AND far < 0 THEN 'Mild Downward' ELSE 'Divergent / Mixed' END AS regime,
          CASE WHEN coverage >= 10 THEN 'High' WHEN coverage >= 5 THEN 'Medium' WHEN coverage >= 2 THEN 'Low' WHEN coverage = 1 THEN 'Single estimate' ELSE 'Unknown' END AS confidence FROM m2""",
        "leaders": f"WITH {MOVES}, {GROWTH}, jn AS (SELECT concat_ws(' ', m2.entity, period, strftime(snap_date, '%Y-%m')) AS entity, near, far, v.pe, v.cagr_2y FROM m2 LEFT JOIN v ON v.entity = concat_ws(' ', m2.entity, period) AND slot = '1998E') "
        + " UNION ALL ".join(
            f"SELECT * FROM ({lead.format(n, c, f, w)}) WHERE entity IS NOT NULL"
            for n, c, f, w in (("largest_up", "near", "max", "near > 0"), ("largest_down", "near", "min", "near < 0"), ("largest_far_up", "far", "max", "far > 0"), ("lowest_pe", "pe", "min", "pe > 0"), ("fastest_cagr", "cagr_2y", "max", "true"))
        ),
        "index_series": """WITH s AS (SELECT entity, period, snap_date, CASE WHEN coverage % 5 <> 0 THEN value END AS value FROM v_snap)
          SELECT entity, period, snap_date, round(value / first_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY entity, period ORDER BY snap_date ROWS UNBOUNDED PRECEDING) * 100.0, 6) AS index_value FROM s""",
        "aligned_series": """WITH a AS (SELECT * FROM v_snap WHERE entity = 'ASIA'), d AS (SELECT DISTINCT snap_date FROM a), p AS (SELECT DISTINCT period FROM a)
          SELECT d.snap_date AS obs_date, p.period, round(a.value, 6) AS value FROM d CROSS JOIN p LEFT JOIN a ON a.snap_date = d.snap_date AND a.period = p.period""",
        "row_errors": f"WITH {ERRORS} SELECT snapshot_id, entity, period_name, array_to_string(errors, ';') AS errors FROM er",
        "entity_gate": f"WITH {ERRORS} SELECT snapshot_id, entity, n_usable, zero_coverage, len(errors) > 0 AS rejected, array_to_string(errors, ';') AS errors FROM gt",
        "watchlist_diff": """WITH s AS (SELECT DISTINCT entity FROM v_snap), r AS (SELECT entity FROM s WHERE entity <> 'ASIA'),
          e AS (SELECT entity FROM s WHERE entity <> 'EUROPE' UNION ALL SELECT 'ARCTIC') SELECT coalesce(e.entity, r.entity) AS entity,
          CASE WHEN r.entity IS NULL THEN 'missing' WHEN e.entity IS NULL THEN 'unexpected' ELSE 'received' END AS status FROM e FULL OUTER JOIN r ON e.entity = r.entity""",
        "last_known_good": """WITH r AS (SELECT CAST(snap_date AS VARCHAR) AS snapshot_id, entity, period, CAST(round(value, 4) AS VARCHAR) AS value, month(snap_date) % 3 = 0 AS failed FROM v_snap),
          n AS (SELECT entity, max(snapshot_id) AS snapshot_id FROM r WHERE NOT failed AND snapshot_id < '2000-07-01' GROUP BY 1) SELECT r.* FROM r JOIN n USING (entity, snapshot_id)""",
        "extreme_changes": f"WITH {PREV} SELECT entity, period, snap_date, round(abs(value - previous_value) / abs(previous_value) * 100.0, 6) AS change_pct FROM pv WHERE previous_value <> 0 AND abs(value - previous_value) / abs(previous_value) * 100.0 > 30",
        "price_outliers": f"WITH {PREV} SELECT entity, period, snap_date, round(price, 2) AS price, round(previous_price, 2) AS previous_price FROM pv WHERE {_outlier(30)}",
        "coverage_regression": f"WITH {COUNTS} SELECT * FROM cn WHERE {REGRESSED}",
        "gate_report": f"""WITH {PREV}, {ERRORS}, {COUNTS},
          fl AS (SELECT snapshot_id, count(*) AS n, bool_or(zero_coverage) AS z, bool_or(len(errors) > 0) AS rj FROM gt GROUP BY 1),
          f AS (SELECT *, snapshot_id IN (SELECT CAST(snap_date AS VARCHAR) FROM pv WHERE previous_value <> 0 AND abs(value - previous_value) / abs(previous_value) * 100.0 > 400) AS ex,
            snapshot_id IN (SELECT CAST(snap_date AS VARCHAR) FROM cn WHERE {REGRESSED}) AS cv, snapshot_id IN (SELECT CAST(snap_date AS VARCHAR) FROM pv WHERE coverage < 4 AND {_outlier(900)}) AS px,
            month(CAST(snapshot_id AS date)) AS m FROM fl),
          d AS (SELECT snapshot_id, CASE WHEN m = 2 THEN 'invalid_snapshot_timestamp' WHEN snapshot_id > '2001-05-05' THEN 'future_snapshot_timestamp' WHEN ex THEN 'extreme_eps_change'
            WHEN cv THEN 'fiscal_coverage_regression' WHEN px THEN 'price_outlier' WHEN z THEN 'consensus_with_zero_analysts' WHEN rj THEN 'validation_failed' WHEN m = 5 THEN 'missing_watchlist_tickers' END AS reason FROM f),
          s AS (SELECT *, CASE WHEN reason IS NULL THEN 'ok' WHEN reason = 'missing_watchlist_tickers' THEN 'partial'
            WHEN reason IN ('validation_failed', 'invalid_snapshot_timestamp', 'future_snapshot_timestamp') THEN 'reject' ELSE 'needs_verification' END AS status FROM d)
          SELECT snapshot_id, status, reason, status IN ('ok', 'partial') AS publishable FROM s""",
        "completeness": f"""WITH {ERRORS}, o AS (SELECT count(*) FILTER (len(errors) = 0) AS n_ok, count(*) AS n_expected FROM gt),
          s AS (SELECT *, CASE WHEN n_ok = 0 THEN 'failed' WHEN n_ok < n_expected THEN 'partial' ELSE 'complete' END AS status FROM o)
          SELECT *, CASE WHEN status = 'partial' THEN 'PARTIAL · ' || n_ok || '/' || n_expected ELSE upper(status) END AS label FROM s""",
        "known_good_fill": """WITH s AS (SELECT entity, snap_date, round(avg(value), 4) AS value FROM v_snap GROUP BY 1, 2), w AS (SELECT DISTINCT entity FROM s UNION ALL SELECT 'ARCTIC'),
          nw AS (SELECT entity, arg_max(value, snap_date) AS value FROM s GROUP BY 1), c AS (SELECT * FROM nw WHERE entity < 'C'), p AS (SELECT * FROM nw WHERE entity <> 'ASIA'),
          j AS (SELECT w.entity, coalesce(c.value, p.value) AS value, CASE WHEN c.entity IS NOT NULL THEN NULL WHEN p.entity IS NOT NULL THEN 'STALE' ELSE 'FAILED' END AS badge
            FROM w LEFT JOIN c ON c.entity = w.entity LEFT JOIN p ON p.entity = w.entity)
          SELECT entity, value, badge, CASE badge WHEN 'STALE' THEN 'last known good shown' WHEN 'FAILED' THEN 'no data' END AS gap_note, badge IS NOT NULL AS is_filled FROM j""",
    }
    dates = {"momentum_regime": ("snap_date",), "index_series": ("snap_date",), "aligned_series": ("obs_date",), "extreme_changes": ("snap_date",), "price_outliers": ("snap_date",), "coverage_regression": ("snap_date",)}
    made = {k: with_views(x) for k, x in sql.items()}
    return {k: dated(x, *dates[k]) if k in dates else x for k, x in made.items()}
