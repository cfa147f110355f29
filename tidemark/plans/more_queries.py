"""Queries over the smaller operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, fiscal, numbers, text
from tidemark.operators import alerts, datasets, history, valuation, windows
from tidemark.plans.alert_queries import ALERTS, _alert_rows
from tidemark.plans.views import Views, with_views
from tidemark.plans.window_queries import PANEL, _panel


def diagnostics(spark, sf_dir):
    found = alerts.insufficient_history(_panel(Views(spark, sf_dir)).where("days = 30"))
    rows = found.select("rule", "entity", "period", F.col("reason").alias("status"), F.datediff("as_of", F.lit("1995-01-01").cast("date")).alias("seq"))
    return alerts.upsert_diagnostics(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))


def period_index(spark, sf_dir):
    rows = Views(spark, sf_dir).obs_ev().select("entity", "period", fiscal.mapped_slot(F.col("period")).alias("slot"), "seq", F.round("value", 4).alias("value"))
    return valuation.period_index(rows.where("seq % 5 = 0"), rows.where("seq % 5 <> 0 or seq % 2 = 0"))


def attached_windows(spark, sf_dir):
    panel = _panel(Views(spark, sf_dir)).where("as_of = DATE'1999-06-30'")
    momentum = windows.momentum_table(panel).drop("as_of").withColumn("coverage", F.lit(99).cast("long"))
    rows = Views(spark, sf_dir).snap().select("entity", "period", "snap_date", F.when(F.col("coverage") % 2 == 0, F.col("coverage")).alias("coverage"))
    out = valuation.attach_windows(rows, momentum)
    return out.select("entity", "period", F.date_format("snap_date", "yyyy-MM").alias("month"), "coverage", *[F.round(f"pct_{n}", 6).alias(f"pct_{n}") for n in (30, 60, 90)])


def previous_values(spark, sf_dir):
    """The newest month of each series against the last good month before it, else against the events of the other months."""
    snap = Views(spark, sf_dir).snap().withColumns({"value": F.col("high"), "seq": F.datediff("snap_date", F.lit("1990-01-01").cast("date"))})
    newest = F.max("snap_date").over(Window.partitionBy("entity", "period"))
    snap = snap.withColumn("is_newest", F.col("snap_date") == newest)
    current = snap.where("is_newest").select("entity", "period", "value")
    good = history.last_write(snap.where("not is_newest and coverage % 8 = 0").select("entity", "period", "value", "seq"), ("entity", "period")).select("entity", "period", "value")
    events = snap.where("not is_newest and coverage % 8 <> 0").select("entity", "period", F.when(F.col("coverage") % 5 != 0, F.col("value")).alias("current_value"), "seq")
    return history.with_previous(current, good, events)


def default_as_of(spark, sf_dir):
    return windows.default_as_of(Views(spark, sf_dir).obs_ev()).select(F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"))


def alert_run(spark, sf_dir):
    """Two rules and one that fails, merged into a history."""
    rows = _alert_rows(spark, sf_dir).withColumns({"created_at": F.col("event_at"), "opened_at": F.lit(None).cast("timestamp")})
    rule = lambda name: lambda: rows.where((F.col("rule") == name) & (F.col("seq") % 2 == 0))
    rules = {alerts.SINGLE: rule(alerts.SINGLE), alerts.GUIDANCE: rule(alerts.GUIDANCE), alerts.PRESSURE: lambda: rows.select("no_such_column")}
    merged, _, report = datasets.evaluate(rules, rows.where(f"rule not in ('{alerts.SINGLE}', '{alerts.GUIDANCE}') or seq % 2 = 1 or seq % 3 = 0"), rows.where("seq % 5 = 0"), F.lit("1998-06-15T00:00:00Z").cast("timestamp"))
    status = spark.createDataFrame([r[:2] for r in report], "rule string, rule_status string")
    return merged.join(F.broadcast(status), "rule", "left").groupBy("rule", "rule_status").agg(F.count("*").alias("n"))  # a row per rule


def shown_texts(spark, sf_dir):
    rows = Views(spark, sf_dir).table("orders")
    ts = F.col("o_orderdate").cast("timestamp")
    raw = F.concat(F.month("o_orderdate"), F.lit("/"), F.dayofmonth("o_orderdate"), F.lit("/"), F.year("o_orderdate"), F.when(F.col("o_orderkey") % 2 == 0, " (Post-Market)").otherwise(""))
    note = F.concat(F.lit("after-hours $"), (F.col("o_custkey") % 90 + 10).cast("string"), F.lit(".25 late"))
    pos = numbers.range_position(F.col("o_totalprice"), F.lit(100000.0), F.lit(300000.0))
    return rows.select(
        "o_orderkey", dates.display_time(ts).alias("shown"), text.event_display(raw, F.lit("confirmed")).alias("event"), text.after_hours_price(note).alias("after_hours"), F.round(pos, 6).alias("position"), dates.month_key(F.to_date(ts)).alias("month"),
        F.array_join(fiscal.chart_years(fiscal.display_years(F.year("o_orderdate"))), ",").alias("years"), fiscal.default_year(fiscal.display_years(F.year("o_orderdate"))).alias("chosen"), numbers.percent_text(F.floor(F.col("o_totalprice") / 1000) - 150, 1).alias("pct"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (diagnostics, period_index, attached_windows, previous_values, default_as_of, alert_run, shown_texts)}


def oracle_sql() -> dict:
    sql = {
        "diagnostics": PANEL
        + """, d AS (SELECT entity, period, reason AS status, datediff('day', DATE '1995-01-01', as_of) AS seq FROM judged WHERE days = 30 AND reason IS NOT NULL)
          SELECT 'cumulative_revision_insufficient_history' AS rule, entity, period, status, max(seq)::int AS seq FROM d GROUP BY 2, 3, 4""",
        "period_index": """WITH r AS (SELECT entity, period, CASE WHEN period IN ('Mar 2028', 'Jan 2027') THEN CAST(right(period, 4) AS int) - 1 ELSE CAST(right(period, 4) AS int) END || 'E' AS slot, seq, round(value, 4) AS value FROM v_obs_ev),
          b AS (SELECT *, 0 AS k FROM r WHERE seq % 5 = 0 UNION ALL SELECT *, 1 FROM r WHERE seq % 5 <> 0 OR seq % 2 = 0)
          SELECT entity, period, slot, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY k, seq) AS n FROM b) WHERE n = 1""",
        "attached_windows": PANEL
        + """, m AS (SELECT entity, period, max(round((end_value - base_value) / abs(base_value) * 100.0, 6)) FILTER (days = 30 AND reason IS NULL) AS pct_30, max(round((end_value - base_value) / abs(base_value) * 100.0, 6)) FILTER (days = 60 AND reason IS NULL) AS pct_60,
            max(round((end_value - base_value) / abs(base_value) * 100.0, 6)) FILTER (days = 90 AND reason IS NULL) AS pct_90 FROM judged WHERE as_of = DATE '1999-06-30' GROUP BY 1, 2),
          s AS (SELECT entity, period, strftime(snap_date, '%Y-%m') AS month, CASE WHEN coverage % 2 = 0 THEN coverage END AS coverage FROM v_snap)
          SELECT entity, period, month, coalesce(coverage, CASE WHEN m.entity IS NOT NULL THEN 99 END) AS coverage, pct_30, pct_60, pct_90 FROM s LEFT JOIN m USING (entity, period)""",
        "previous_values": """WITH s AS (SELECT entity, period, snap_date, high AS value, coverage, snap_date = max(snap_date) OVER (PARTITION BY entity, period) AS newest FROM v_snap),
          c AS (SELECT * FROM s WHERE newest), g AS (SELECT entity, period, arg_max(value, snap_date) AS value FROM s WHERE NOT newest AND coverage % 8 = 0 GROUP BY 1, 2),
          e AS (SELECT entity, period, arg_max({'v': CASE WHEN coverage % 5 <> 0 THEN value END}, snap_date).v AS value FROM s WHERE NOT newest AND coverage % 8 <> 0 GROUP BY 1, 2),
          j AS (SELECT c.entity, c.period, c.value, coalesce(g.value, e.value) AS previous, g.entity IS NOT NULL OR e.entity IS NOT NULL AS known FROM c LEFT JOIN g ON g.entity = c.entity AND g.period = c.period LEFT JOIN e ON e.entity = c.entity AND e.period = c.period)
          SELECT entity, period, value, previous, CASE WHEN NOT known THEN 'baseline' WHEN previous IS NULL OR abs(value - previous) < 1e-9 THEN 'none' WHEN value > previous THEN 'upgrade' ELSE 'downgrade' END AS kind FROM j""",
        "default_as_of": "SELECT strftime(max(update_ts), '%Y-%m-%d %H:%M:%S') AS as_of FROM v_obs_ev WHERE value IS NOT NULL",
        "alert_run": f"""WITH {ALERTS} SELECT rule, CASE rule WHEN '{alerts.SINGLE}' THEN 'ok' WHEN '{alerts.GUIDANCE}' THEN 'ok' WHEN '{alerts.PRESSURE}' THEN 'error' END AS rule_status, count(*) AS n FROM al
          WHERE rule <> '{alerts.HISTORY}' GROUP BY 1, 2""",
        "shown_texts": """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown, strftime(o_orderdate, '%b ') || day(o_orderdate) || ', ' || year(o_orderdate) || CASE WHEN o_orderkey % 2 = 0 THEN ' · Post-Market' ELSE '' END || ' · Confirmed' AS event,
          (o_custkey % 90 + 10 + 0.25)::double AS after_hours, round(least(100.0, greatest(0.0, (o_totalprice - 100000.0) / 200000.0 * 100.0)), 6) AS position, strftime(o_orderdate, '%Y-%m') AS month,
          year(o_orderdate) || 'E,' || (year(o_orderdate) + 1) || 'E,' || (year(o_orderdate) + 2) || 'E' AS years, (year(o_orderdate) + 1) || 'E' AS chosen,
          CASE WHEN floor(o_totalprice / 1000) - 150 > 0 THEN '+' ELSE '' END || printf('%d', (floor(o_totalprice / 1000) - 150)::bigint) || '.0%' AS pct FROM orders""",
    }
    return {k: with_views(x) for k, x in sql.items()}
