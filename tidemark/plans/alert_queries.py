"""Queries over alerts, texts, hosts, digests and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, fiscal, ids, numbers, text, urls
from tidemark.operators import alerts, digests
from tidemark.plans.quality_queries import MOVES, PREV, _moves
from tidemark.plans.views import Views, dated, with_views


def _series(spark, sf_dir) -> DataFrame:
    """Monthly moves cut to a tenth, so that every branch of the hysteresis occurs; every 13th is unavailable."""
    rows = _moves(spark, sf_dir)
    return rows.select("entity", "period", F.col("snap_date").alias("as_of"), F.when(F.col("coverage") % 13 != 0, F.col("near")).alias("pct"))


def hysteresis_alerts(spark, sf_dir):
    return alerts.hysteresis(_series(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


def source_alerts(spark, sf_dir):
    return alerts.hysteresis(_series(spark, sf_dir), refresh_in_band=False).withColumn("pct", F.round("pct", 6))


def source_severity(spark, sf_dir):
    rows = _moves(spark, sf_dir).where("near is not null").select("entity", "period", "snap_date", F.col("near").alias("pct"), F.when(F.col("coverage") % 6 != 0, F.col("coverage")).alias("coverage"), F.col("period").alias("slot"))
    out = alerts.source_alert_rows(rows, F.lit("Mar 1998"))
    return out.select("entity", "period", "snap_date", "severity")


def _events(spark, sf_dir) -> DataFrame:
    """Order pairs as raw revision events; some are baselines, some lack a previous number, some have no percentage."""
    rows = Views(spark, sf_dir).table("lineitem")
    return rows.select(
        F.concat(F.lit("E"), F.col("l_suppkey")).alias("entity"),
        F.concat(F.year("l_shipdate"), F.lit("E")).alias("period"),
        F.when(F.col("l_partkey") % 7 == 0, "n/a (baseline)").otherwise((F.col("l_quantity") * 2).cast("int").cast("string")).alias("previous"),
        (F.col("l_quantity") + F.col("l_orderkey") % 40).cast("int").cast("string").alias("current"),
        F.when(F.col("l_partkey") % 5 == 0, "n/a").alias("revision"),
        F.when(F.col("l_partkey") % 11 == 0, "First baseline").otherwise("update").alias("reason"),
        F.to_date("l_shipdate").cast("string").alias("date"),
        F.lit(None).cast("string").alias("update_time"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def single_revisions(spark, sf_dir):
    out = alerts.single_revisions(_events(spark, sf_dir))
    return out.select("entity", "period", "event_date", "direction", F.round("pct", 6).alias("pct"))


def event_ids(spark, sf_dir):
    rows = _events(spark, sf_dir)
    e = ids.event_id(F.col("entity"), F.col("period"), F.col("previous"), F.col("current"), F.col("date"))
    a = ids.alert_id(F.lit("rule one"), F.col("entity"), F.concat(F.col("period"), F.lit(":a/b")), F.col("date"), F.col("update_time"))
    return rows.select("seq", e.alias("event_id"), a.alias("alert_id"))


def _alert_rows(spark, sf_dir) -> DataFrame:
    rows = Views(spark, sf_dir).table("lineitem")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("l_partkey") % len(v) + 1).cast("int"))
    return rows.select(
        F.concat_ws(":", F.lit("a"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        pick(alerts.SINGLE, alerts.CUMULATIVE, alerts.GUIDANCE, alerts.RESULTS, alerts.PRESSURE, alerts.DRIVER, alerts.HISTORY).alias("rule"),
        F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "odd")]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("E"), (F.col("l_suppkey") % 9).cast("string")).alias("entity"),
        F.when(F.col("l_orderkey") % 4 == 0, "marked below").when(F.col("l_orderkey") % 4 == 1, "marked above").otherwise("x").alias("message"),
        F.lit(None).cast("string").alias("comparison"),
        F.when(F.col("l_orderkey") % 2 == 0, "deteriorating").otherwise("improving").alias("current_status"),
        F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity") - 25).alias("pct"),
        F.col("l_shipdate").cast("timestamp").alias("event_at"),
        F.when(F.col("l_orderkey") % 5 == 0, "resolved").otherwise("open").alias("status"),
        F.when(F.col("l_orderkey") % 7 == 0, "Hold").otherwise("Open").alias("lifecycle"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("expires_at"),
        (F.col("l_linenumber") == 1).alias("one_shot"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


NOW = "1998-06-15T00:00:00Z"


def active_alerts(spark, sf_dir):
    out = alerts.active(_alert_rows(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return out.select("id", "rule", "age_days", alerts.severity_rank().cast("long").alias("severity_rank"))


def attention_queue(spark, sf_dir):
    out = alerts.attention_queue(alerts.active(_alert_rows(spark, sf_dir), F.lit(NOW).cast("timestamp")))
    return out.select("id", "entity", "bucket", "severity")


def changed_since(spark, sf_dir):
    return alerts.changed_since(_alert_rows(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("id", "rule", "entity")


def newest_open(spark, sf_dir):
    return alerts.newest_open(_alert_rows(spark, sf_dir), ("rule", "entity")).select("id", "rule", "entity")


def first_by_id(spark, sf_dir):
    rows = _alert_rows(spark, sf_dir).withColumn("id", F.concat_ws(":", "rule", "entity", "severity"))
    return alerts.first_by_id(rows).select("id", "seq", "status")


def alert_upsert(spark, sf_dir):
    rows = _alert_rows(spark, sf_dir)
    again = F.row_number().over(Window.partitionBy("id").orderBy("event_at", "pct"))  # ids of a history are unique
    rows = rows.withColumn("id", F.concat_ws("#", "id", again)).withColumns({"created_at": F.col("event_at"), "opened_at": F.when(F.col("one_shot"), F.col("event_at"))})
    old, new = rows.where("seq % 3 <> 0"), rows.where("seq % 2 = 0 or seq % 3 = 0").withColumns({"created_at": F.col("event_at") + F.expr("INTERVAL 1 DAY"), "event_at": F.col("event_at") + F.expr("INTERVAL 2 DAYS"), "pct": F.lit(9.0)})
    out = alerts.upsert(old, new)
    return out.select("id", "status", "lifecycle", "pct", *[F.to_date(c).alias(c) for c in ("created_at", "opened_at", "event_at")])


def gm_bps_text(spark, sf_dir):
    """Margin texts made from line items."""
    rows = Views(spark, sf_dir).table("lineitem")
    q = (F.col("l_quantity").cast("int") * 10).cast("string")
    words = F.element_at(F.array(*[F.lit(x) for x in ("gross margin down ", "margin rose by ", "guided -", "lowered by ", "about ")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    told = F.concat(words, q, F.lit(" bps to "), (F.col("l_quantity") + 20).cast("int").cast("string"), F.lit(".5% from 12%"))
    return rows.select("l_orderkey", "l_linenumber", text.bps_change(told).alias("bps"), F.array_join(F.transform(text.margin_numbers(told), lambda x: x.cast("string")), ",").alias("margins"))


def _digests(spark, sf_dir) -> DataFrame:
    rows = Views(spark, sf_dir).table("lineitem")
    q = F.col("l_quantity").cast("int")
    pct = lambda c: F.concat(c.cast("string"), F.lit("%"))
    vs = lambda k: F.when(F.col("l_orderkey") % k == 0, "Above").when(F.col("l_orderkey") % k == 1, " below ").when(F.col("l_orderkey") % k == 2, "in line")
    none = F.lit(None).cast("string")
    return rows.select(
        F.concat(F.lit("D"), F.col("l_orderkey")).alias("entity"), F.when(F.col("l_partkey") % 9 != 0, F.concat(F.lit("Q"), F.quarter("l_shipdate"))).alias("period"), F.to_date("l_shipdate").cast("string").alias("report_date"),
        vs(5).alias("results_vs"), none.alias("results_vs_alt"), none.alias("comparison_vs"), vs(7).alias("legacy_vs"), vs(6).alias("guidance_vs"), none.alias("guidance_vs_alt"), F.lit("https://x.example/c").alias("comparison_url"),
        pct(q + 30).alias("previous_guidance"), F.when(F.col("l_partkey") % 2 == 0, pct(q + 30)).otherwise(pct(F.lit(60))).alias("current_guidance"), pct(q + 25).alias("guided"),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("margin fell "), (q * 10).cast("string"), F.lit(" bps"))).alias("free_text"), pct(F.lit(50)).alias("reported"),
    )


def digest_alerts(spark, sf_dir):
    rows = _digests(spark, sf_dir)
    a = alerts.results_and_guidance(rows).select("id", "rule", "severity", "entity", F.col("comparison").alias("detail"))
    b = alerts.margin_alerts(rows).select("id", "rule", "severity", "entity", F.round("bps").cast("long").cast("string").alias("detail"))
    return a.unionByName(b)


def driver_alerts(spark, sf_dir):
    rows = Views(spark, sf_dir).table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_shipdate"))).alias("ls"))
    state = lambda q: F.when(q % 3 == 0, "Improving").when(q % 3 == 1, "deteriorating").otherwise("stable")
    step = lambda x: F.struct(state(x["l_quantity"] + 1).alias("previous_status"), state(x["l_quantity"]).alias("current_status"), F.when(x["l_linenumber"] % 4 != 0, F.to_date(x["l_shipdate"]).cast("string")).alias("changed_at"), F.lit(None).cast("string").alias("event_date"), F.lit("null").alias("as_of"), F.when(x["l_linenumber"] % 2 == 0, "why").alias("reason"), F.lit(None).cast("string").alias("note"))
    first = F.col("ls")[0]
    drivers = rows.select(
        F.concat(F.lit("T"), "l_orderkey").alias("entity"), F.when(F.col("l_orderkey") % 5 != 0, "1999-01-31").alias("updated"), F.lit("demand").alias("name"), state(first["l_quantity"] + F.col("l_orderkey") % 2).alias("previous_status"), state(first["l_quantity"]).alias("current_status"),
        F.lit(None).cast("string").alias("changed_at"), F.lit(None).cast("string").alias("event_date"), F.lit(None).cast("string").alias("as_of"), F.when(F.col("l_orderkey") % 2 == 0, "because").alias("reason"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("fiscal_period"), F.lit(None).cast("string").alias("source_url"),
        F.when(F.col("l_orderkey") % 3 != 0, F.transform("ls", step)).alias("history"),
    )
    return alerts.driver_transitions(drivers).select("id", "entity", "severity", "previous_status", "current_status", "event_date", "missing_event_date")


def host_tier(spark, sf_dir):
    """Pages' own URLs and spoofed ones."""
    pages = Views(spark, sf_dir).table("pages").select("page_id", "url")
    host = urls.hostname(F.col("url"))
    made = F.element_at(F.array(F.col("url"), F.concat(F.lit("https://www.sec.gov/"), "page_id"), F.lit("http://sec.gov.evil.example/x"), F.lit("https://Investor.acme.example./ir"), F.concat(F.lit("https://ir.known.example/"), "page_id"), F.lit("https://evilreuters.com/a"), F.lit("https://uk.reuters.com/a"), F.lit("https://seekingalpha.com/b"), F.lit("not a url")), (F.col("page_id") % 9 + 1).cast("int"))
    declared = F.element_at(F.array(F.lit(None).cast("string"), F.lit("sec"), F.lit("company_ir"), F.lit("reuters")), (F.col("page_id") % 4 + 1).cast("int"))
    rows = pages.select("page_id", F.lit("ACME").alias("entity"), made.alias("url"), declared.alias("declared"), host.alias("own_host"))
    out = digests.tiered(rows, spark.createDataFrame([("acme", "known.example"), ("other", "acme.example")], "entity string, domain string"))
    return out.select("page_id", "own_host", "host", "official", "tier")


def fiscal_labels(spark, sf_dir):
    rows = Views(spark, sf_dir).table("orders")
    month = F.element_at(F.array(*[F.lit(m) for m in fiscal.MONTHS]), F.month("o_orderdate"))
    year = F.year("o_orderdate").cast("string")
    label = F.element_at(F.array(F.concat_ws(" ", month, year), F.concat_ws(" ", F.date_format("o_orderdate", "MMMM"), year), F.date_format("o_orderdate", "yyyy-MM"), F.concat(F.lit("FY"), year), F.concat(year, F.lit("E")), F.lit("n/a"), F.concat(F.lit(" other "), year)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    end = F.when(F.col("o_custkey") % 2 == 0, 6)
    rows = rows.withColumns({"label": label, "end": end})
    c = F.col("label")
    period = fiscal.reported_period(c, F.col("end"))
    return rows.select("o_orderkey", period.alias("period"), fiscal.normalized_period(c).alias("normalized"), fiscal.mapped_slot(period).alias("slot"), fiscal.label_parsable(c).alias("parsable"), fiscal.looks_like_slot(c).alias("is_slot"), fiscal.fiscal_equals_calendar(period).alias("is_calendar"))


def to_num_cases(spark, sf_dir):
    rows = Views(spark, sf_dir).table("lineitem")
    price = F.format_number("l_extendedprice", 2)
    raw = F.element_at(F.array(price, F.concat(F.lit(" $"), price), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%")), F.lit("n/a"), F.lit("NaN"), F.lit("12d"), F.lit("true"), F.lit("-1.5e2")), (F.col("l_partkey") % 8 + 1).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", numbers.to_num(raw).alias("n"), numbers.is_unavailable(raw).alias("unavailable"))


def freshness(spark, sf_dir):
    rows = Views(spark, sf_dir).table("orders")
    now = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    last = F.when(F.col("o_orderkey") % 10 != 0, now - F.make_dt_interval((F.col("o_custkey") % 4).cast("int"), (F.col("o_custkey") % 20).cast("int")))
    out = rows.select("o_orderkey", dates.is_stale(last, now).alias("stale"), dates.next_due(now).alias("next_due"), dates.weekday_gap(F.to_date("o_orderdate"), F.date_add("o_orderdate", (F.col("o_custkey") % 12).cast("int"))).alias("gap"))
    return out.withColumn("next_due", F.date_format("next_due", "yyyy-MM-dd HH:mm"))


def extracted_estimates(spark, sf_dir):
    """Pages with an estimates table put before their own HTML."""
    pages = Views(spark, sf_dir).table("pages")
    row = lambda p, v: F.concat(F.lit(f'<tr data-period="{p}"><td class="fiscal-period-ending">{p}</td><td class="consensus">'), v, F.lit('</td> <td class="high"> 9.5 </td></tr>'))
    block = F.concat(F.lit('<script id="sa-estimates-json">{"rows":[{"fiscalPeriodEnding":"Jan 2028","consensus":"'), F.col("page_id").cast("string"), F.lit('"}]}</script>'))
    html = F.concat(F.lit("<table>"), row("Jan 2027", F.col("page_id").cast("string")), row("Jun 2027", (F.col("page_id") + 1).cast("string")), F.lit("</table>"), F.when(F.col("page_id") % 3 == 0, block).otherwise(""), F.coalesce("html", F.lit("")))
    out = digests.extracted_estimates(pages.select("page_id", html.alias("html")))
    return out.select("page_id", F.col("place").cast("long").alias("place"), "fiscal_period", "consensus", "high")


def repeated_rows(spark, sf_dir):
    rows = Views(spark, sf_dir).obs_ev()
    rows = rows.select("entity", F.when(F.col("seq") % 9 == 0, F.lit("Feb 2028")).otherwise(F.col("period")).alias("fiscal_period"), F.floor(F.col("value") / 400).cast("string").alias("consensus"), "seq")
    return digests.repeated_row_policy(rows)


def queries() -> dict:
    names = (hysteresis_alerts, source_alerts, source_severity, single_revisions, event_ids, active_alerts, attention_queue, changed_since, newest_open, first_by_id, alert_upsert, gm_bps_text)
    names += (digest_alerts, driver_alerts, host_tier, fiscal_labels, to_num_cases, freshness, extracted_estimates, repeated_rows)
    return {f.__name__: f for f in names}


SER = MOVES + ", ser AS (SELECT entity, period, snap_date AS as_of, CASE WHEN coverage % 13 <> 0 THEN near END AS pct FROM m2), sg AS (SELECT *, CASE WHEN abs(pct) >= 5 THEN 1 WHEN abs(pct) < 4 THEN 0 END AS signal FROM ser WHERE pct IS NOT NULL), st AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY entity, period ORDER BY as_of ROWS UNBOUNDED PRECEDING), 0) AS state FROM sg), bf AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY entity, period ORDER BY as_of), 0) AS before FROM st), ep AS (SELECT *, sum(CASE WHEN state = 1 AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity, period ORDER BY as_of ROWS UNBOUNDED PRECEDING)::bigint AS episode FROM bf)"
EVENTS = """ev AS (SELECT 'E' || l_suppkey AS entity, year(l_shipdate) || 'E' AS period, CASE WHEN l_partkey % 7 = 0 THEN 'n/a (baseline)' ELSE CAST(CAST(l_quantity * 2 AS int) AS VARCHAR) END AS previous,
  CAST(CAST(l_quantity + l_orderkey % 40 AS int) AS VARCHAR) AS current, CASE WHEN l_partkey % 5 = 0 THEN 'n/a' END AS revision, CASE WHEN l_partkey % 11 = 0 THEN 'First baseline' ELSE 'update' END AS reason,
  CAST(CAST(l_shipdate AS date) AS VARCHAR) AS "date", l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""
ALERTS = f"""al AS (SELECT 'a:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id,
  ['{alerts.SINGLE}', '{alerts.CUMULATIVE}', '{alerts.GUIDANCE}', '{alerts.RESULTS}', '{alerts.PRESSURE}', '{alerts.DRIVER}', '{alerts.HISTORY}'][CAST(l_partkey % 7 + 1 AS int)] AS rule,
  ['high', 'medium', 'low', 'odd'][CAST(l_suppkey % 4 + 1 AS int)] AS severity, 'E' || (l_suppkey % 9) AS entity, CASE l_orderkey % 4 WHEN 0 THEN 'marked below' WHEN 1 THEN 'marked above' ELSE 'x' END AS message,
  CASE WHEN l_orderkey % 2 = 0 THEN 'deteriorating' ELSE 'improving' END AS current_status, CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity - 25 END AS pct, l_shipdate AS event_at,
  CASE WHEN l_orderkey % 5 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN l_orderkey % 7 = 0 THEN 'Hold' ELSE 'Open' END AS lifecycle, l_linenumber = 1 AS one_shot, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem),
ac AS (SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END AS severity_rank FROM al WHERE rule <> '{alerts.HISTORY}' AND status <> 'resolved'
  AND (NOT one_shot OR TIMESTAMP '1998-06-15' <= event_at + INTERVAL 21 DAY))"""


def oracle_sql() -> dict:
    event = "CASE WHEN state = 1 AND before = 0 THEN 'Open' WHEN state = 0 AND before = 1 THEN 'Resolved' WHEN state = 1 AND abs(pct) < 5 THEN {band} WHEN state = 1 THEN CASE WHEN {moved} THEN 'Updated' ELSE 'Hold' END END"
    out = "SELECT * FROM (SELECT entity, period, as_of, round(pct, 6) AS pct, {e} AS event, episode FROM so) WHERE event IS NOT NULL"
    bucket = f"""CASE WHEN rule = '{alerts.DRIVER}' AND current_status = 'deteriorating' THEN 'driver_deteriorating' WHEN rule IN ('{alerts.SINGLE}', '{alerts.CUMULATIVE}') THEN CASE WHEN pct < 0 THEN 'revision_downside' ELSE 'other' END
      WHEN rule = '{alerts.GUIDANCE}' AND message = 'marked below' THEN 'guidance_downside' WHEN rule = '{alerts.PRESSURE}' THEN 'margin_pressure' WHEN rule = '{alerts.DRIVER}' THEN 'driver_improving'
      WHEN rule = '{alerts.RESULTS}' AND message = 'marked above' THEN 'results_beat' ELSE 'other' END"""
    rank = "CASE bucket WHEN 'driver_deteriorating' THEN 0 WHEN 'revision_downside' THEN 1 WHEN 'guidance_downside' THEN 2 WHEN 'margin_pressure' THEN 3 WHEN 'driver_improving' THEN 4 WHEN 'results_beat' THEN 5 ELSE 9 END"
    vs = lambda k: f"CASE l_orderkey % {k} WHEN 0 THEN 'Above' WHEN 1 THEN 'Below' END"
    digest = f"""dg AS (SELECT 'D' || l_orderkey AS entity, CASE WHEN l_partkey % 9 <> 0 THEN 'Q' || quarter(l_shipdate) ELSE 'na' END AS period, CAST(CAST(l_shipdate AS date) AS VARCHAR) AS d, CAST(l_quantity AS int) AS q, l_partkey,
      coalesce({vs(5)}, CASE WHEN l_orderkey % 5 <> 0 AND l_orderkey % 5 <> 1 THEN {vs(7)} END) AS rv, {vs(6)} AS gv FROM lineitem),
      mg AS (SELECT *, CASE WHEN l_partkey % 3 = 0 AND q * 10 >= 10 THEN -q * 10.0 END AS tb, CASE WHEN l_partkey % 2 <> 0 AND 60 <> q + 30 THEN (60 - (q + 30)) * 100.0 END AS gb, (q + 25 - 50) * 100.0 AS db FROM dg),
      pm AS (SELECT *, CASE WHEN abs(tb) > 200 THEN tb WHEN abs(db) > 200 THEN db END AS pb FROM mg)"""
    state = lambda q: f"CASE WHEN ({q}) % 3 = 0 THEN 'improving' WHEN ({q}) % 3 = 1 THEN 'deteriorating' ELSE 'stable' END"
    w = "(5 * floor(datediff('day', DATE '1969-12-29', {d}) / 7.0) + least(datediff('day', DATE '1969-12-29', {d}) % 7 + 1, 5))"
    a, b = "CAST(o_orderdate AS date)", "(CAST(o_orderdate AS date) + CAST(o_custkey % 12 AS int))"
    due = "(CASE dayofweek(CAST({n} AS date)) WHEN 6 THEN CAST({n} AS date) - 1 WHEN 0 THEN CAST({n} AS date) - 2 ELSE CAST({n} AS date) END)"
    sql = {
        "hysteresis_alerts": f"WITH {SER}, so AS (SELECT *, lag(pct) OVER (PARTITION BY entity, period ORDER BY as_of) AS stored FROM ep) " + out.format(e=event.format(band="'Hold'", moved="sign(pct) <> sign(stored) OR abs(pct - stored) >= 1")),
        "source_alerts": f"WITH {SER}, so AS (SELECT *, last_value(CASE WHEN abs(pct) >= 5 THEN pct END IGNORE NULLS) OVER (PARTITION BY entity, period, episode ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM ep) "
        + out.format(e=event.format(band="NULL", moved="abs(pct - stored) >= 1")),
        "source_severity": f"""WITH {MOVES}, s AS (SELECT entity, period, snap_date, near AS pct, CASE WHEN coverage % 6 <> 0 THEN coverage END AS c FROM m2 WHERE near IS NOT NULL)
          SELECT entity, period, snap_date, CASE WHEN c < 5 AND period = 'Mar 1998' THEN CASE WHEN abs(pct) >= 10 THEN 'medium' ELSE 'low' END WHEN c IS NULL OR c < 5 THEN CASE WHEN abs(pct) >= 5 THEN 'medium' ELSE 'low' END ELSE 'high' END AS severity FROM s""",
        "single_revisions": f"""WITH {EVENTS}, p AS (SELECT *, (CAST(current AS double) - TRY_CAST(previous AS double)) / abs(TRY_CAST(previous AS double)) * 100.0 AS pct FROM ev WHERE reason = 'update' AND previous <> 'n/a (baseline)')
          SELECT entity, period, "date" AS event_date, CASE WHEN pct > 0 THEN 'upgrade' ELSE 'downgrade' END AS direction, round(pct, 6) AS pct FROM p WHERE abs(pct) > 2""",
        "event_ids": f"""WITH {EVENTS} SELECT seq, sha256(entity || '|' || period || '|' || coalesce(printf('%.6f', TRY_CAST(previous AS double)), previous) || '|' || printf('%.6f', CAST(current AS double)) || '|' || "date") AS event_id,
          'rule_one:' || entity || ':' || period || '_a-b:' || "date" || ':na' AS alert_id FROM ev""",
        "active_alerts": f"WITH {ALERTS} SELECT id, rule, greatest(0, floor(epoch(TIMESTAMP '1998-06-15' - event_at) / 86400))::bigint AS age_days, severity_rank::bigint AS severity_rank FROM ac",
        "attention_queue": f"""WITH {ALERTS}, bk AS (SELECT *, {bucket} AS bucket FROM ac), rk AS (SELECT *, {rank} AS bucket_rank FROM bk),
          n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY bucket_rank, severity_rank, event_at DESC, id) AS n FROM rk)
          SELECT id, entity, bucket, severity FROM n WHERE n <= 2 ORDER BY bucket_rank, severity_rank, event_at DESC, id LIMIT 5""",
        "changed_since": f"WITH {ALERTS} SELECT id, rule, entity FROM al WHERE rule <> '{alerts.HISTORY}' AND lifecycle <> 'Hold' AND event_at > TIMESTAMP '1998-06-15'",
        "newest_open": f"WITH {ALERTS} SELECT id, rule, entity FROM (SELECT *, row_number() OVER (PARTITION BY rule, entity ORDER BY event_at DESC, id DESC) AS n FROM al WHERE status <> 'resolved') WHERE n = 1",
        "first_by_id": f"WITH {ALERTS}, k AS (SELECT rule || ':' || entity || ':' || severity AS id, seq, status FROM al) SELECT id, min(seq) AS seq, arg_min(status, seq) AS status FROM k GROUP BY id",
        "alert_upsert": f"""WITH {ALERTS}, r AS (SELECT * REPLACE (id || '#' || row_number() OVER (PARTITION BY id ORDER BY event_at, pct NULLS FIRST) AS id), CASE WHEN one_shot THEN event_at END AS opened_at FROM al WHERE rule <> '{alerts.HISTORY}')
          SELECT id, status, lifecycle, CASE WHEN seq % 2 = 0 OR seq % 3 = 0 THEN 9.0::double ELSE pct END AS pct, CAST(CASE WHEN seq % 3 <> 0 THEN event_at ELSE event_at + INTERVAL 1 DAY END AS date) AS created_at, CAST(opened_at AS date) AS opened_at,
          CAST(CASE WHEN (seq % 2 = 0 OR seq % 3 = 0) AND NOT (seq % 3 <> 0 AND lifecycle = 'Hold') THEN event_at + INTERVAL 2 DAY ELSE event_at END AS date) AS event_at FROM r""",
        "gm_bps_text": """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS int) * 10 AS q, l_partkey % 5 AS k, CAST(l_quantity + 20 AS int) + 0.5 AS m FROM lineitem)
          SELECT l_orderkey, l_linenumber, CASE WHEN q BETWEEN 10 AND 9999 THEN CASE WHEN k IN (0, 3) THEN -q WHEN k = 2 THEN -q ELSE q END END::double AS bps, CASE WHEN m BETWEEN 20 AND 95 THEN CAST(m::double AS VARCHAR) ELSE '' END AS margins FROM t""",
        "digest_alerts": f"""WITH {digest}
          SELECT 'results_vs_consensus:' || entity || ':' || period || ':' || d || ':results_' || lower(rv) AS id, 'results_vs_consensus' AS rule, 'medium' AS severity, entity, rv AS detail FROM dg WHERE rv IS NOT NULL
          UNION ALL SELECT 'guidance_vs_consensus:' || entity || ':' || period || ':' || d || ':guidance_' || lower(gv), 'guidance_vs_consensus', 'medium', entity, gv FROM dg WHERE gv IS NOT NULL
          UNION ALL SELECT 'gross_margin_guidance_revision:' || entity || ':' || CASE WHEN period = 'na' THEN 'na' ELSE period END || ':' || d || ':gm_guidance_rev', 'gross_margin_guidance_revision', CASE WHEN abs(gb) > 200 THEN 'high' ELSE 'medium' END, entity, CAST(gb::bigint AS VARCHAR) FROM mg WHERE gb IS NOT NULL
          UNION ALL SELECT 'gross_margin_pressure:' || entity || ':' || period || ':' || d || ':gm_pressure_' || printf('%+d', pb::bigint), 'gross_margin_pressure', 'high', entity, CAST(pb::bigint AS VARCHAR) FROM pm WHERE pb IS NOT NULL""",
        "driver_alerts": f"""WITH o AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 5 <> 0 THEN '1999-01-31' END AS updated, CASE WHEN l_orderkey % 2 = 0 THEN 'because' END AS why, arg_min(l_quantity, l_linenumber) AS q FROM lineitem GROUP BY 1, 2, 3),
          h AS (SELECT k, {state("l_quantity + 1")} AS prev, {state("l_quantity")} AS cur, coalesce(CASE WHEN l_linenumber % 4 <> 0 THEN CAST(CAST(l_shipdate AS date) AS VARCHAR) END, updated) AS d, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 'why' END, why) AS reason FROM lineitem JOIN o ON l_orderkey = k WHERE k % 3 <> 0
            UNION ALL SELECT k, {state("q + k % 2")}, {state("q")}, updated, why FROM o WHERE k % 3 = 0 AND {state("q + k % 2")} <> {state("q")})
          SELECT 'driver_status_change:T' || k || ':na:' || coalesce(d, 'na') || ':demand' AS id, 'T' || k AS entity, CASE WHEN cur = 'improving' THEN 'medium' ELSE 'high' END AS severity, prev AS previous_status, cur AS current_status, d AS event_date, d IS NULL AS missing_event_date
          FROM h WHERE cur <> 'stable' AND reason IS NOT NULL""",
        "host_tier": r"""WITH p AS (SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '.'), '') AS own_host, page_id % 9 AS k, page_id % 4 AS m FROM pages),
          h AS (SELECT *, CASE k WHEN 0 THEN own_host WHEN 1 THEN 'www.sec.gov' WHEN 2 THEN 'sec.gov.evil.example' WHEN 3 THEN 'investor.acme.example' WHEN 4 THEN 'ir.known.example' WHEN 5 THEN 'evilreuters.com' WHEN 6 THEN 'uk.reuters.com' WHEN 7 THEN 'seekingalpha.com' END AS host FROM p)
          SELECT page_id, own_host, host, k = 4 AS official, CASE WHEN m = 1 THEN CASE WHEN k = 1 THEN '1' ELSE 'source_mismatch' END WHEN m = 2 THEN CASE WHEN k = 4 THEN '1' ELSE 'source_mismatch' END WHEN m = 3 THEN CASE WHEN k = 6 THEN '3' ELSE 'source_mismatch' END
            WHEN k IN (1, 4) THEN '1' WHEN k = 3 THEN 'unverified_ir_candidate' WHEN k = 6 THEN '3' WHEN k = 7 THEN '4' ELSE 'Unknown' END AS tier FROM h""",
        "fiscal_labels": """WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_custkey % 2 = 0 AS has_end, strftime(o_orderdate, '%b %Y') AS my, strftime(o_orderdate, '%Y') AS y, month(o_orderdate) AS m, year(o_orderdate) AS yr FROM orders),
          p AS (SELECT *, CASE WHEN k <= 2 THEN my WHEN k IN (3, 4) AND has_end THEN 'Jun ' || y END AS period FROM o)
          SELECT o_orderkey, period, CASE WHEN k <= 1 THEN my WHEN k = 2 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') WHEN k = 3 THEN 'FY' || y WHEN k = 4 THEN y || 'E' WHEN k = 5 THEN 'n/a' ELSE 'other ' || y END AS normalized,
          CASE WHEN period IS NOT NULL THEN CASE WHEN k <= 2 AND m <= 3 THEN yr - 1 ELSE yr END || 'E' END AS slot, k <> 6 AS parsable, k = 4 AS is_slot, coalesce(period LIKE 'Dec %', false) AS is_calendar FROM p""",
        "to_num_cases": """SELECT l_orderkey, l_linenumber, CASE l_partkey % 8 WHEN 0 THEN round(l_extendedprice, 2) WHEN 1 THEN round(l_extendedprice, 2) WHEN 2 THEN CAST(l_quantity AS int) WHEN 7 THEN -150.0 END::double AS n, l_partkey % 8 = 3 AS unavailable FROM lineitem""",
        "freshness": f"""WITH t AS (SELECT *, o_orderdate + to_hours(CAST(o_orderkey % 24 AS int)) AS now FROM orders),
          l AS (SELECT *, CASE WHEN o_orderkey % 10 <> 0 THEN now - to_days(CAST(o_custkey % 4 AS int)) - to_hours(CAST(o_custkey % 20 AS int)) END AS last, now - INTERVAL 6 HOUR AS n6 FROM t)
          SELECT o_orderkey, last IS NULL OR last < {due.format(n="n6")} AS stale, strftime({due.format(n="now")} + CASE dayofweek({due.format(n="now")}) WHEN 5 THEN INTERVAL 3 DAY ELSE INTERVAL 1 DAY END, '%Y-%m-%d %H:%M') AS next_due,
          greatest(0, {w.format(d=b)} - {w.format(d=a)})::bigint AS gap FROM l""",
        "extracted_estimates": """SELECT page_id, 0::bigint AS place, 'Jan 2028' AS fiscal_period, CAST(page_id AS VARCHAR) AS consensus, NULL AS high FROM pages WHERE page_id % 3 = 0
          UNION ALL SELECT page_id, i, ['Jan 2027', 'Jun 2027'][i + 1], CAST(page_id + i AS VARCHAR), '9.5' FROM pages, (SELECT unnest([0, 1])::bigint AS i) WHERE page_id % 3 <> 0""",
        "repeated_rows": """WITH r AS (SELECT entity, CASE WHEN seq % 9 = 0 THEN 'Feb 2028' ELSE period END AS period, floor(value / 400)::bigint AS v, seq FROM v_obs_ev),
          p AS (SELECT entity, period, CASE WHEN period IN ('Mar 2028', 'Feb 2028') OR period = 'Jan 2027' THEN CAST(right(period, 4) AS int) - 1 ELSE CAST(right(period, 4) AS int) END AS slot, count(DISTINCT coalesce(CAST(v AS VARCHAR), '')) AS k, min(seq) AS f, count(*) AS n FROM r GROUP BY 1, 2, 3),
          b AS (SELECT entity, f AS pos, 'duplicate_conflicting_fiscal_row' AS violation FROM p WHERE k > 1 UNION ALL SELECT entity, max(f), 'mapped_slot_collision' FROM p GROUP BY entity, slot HAVING count(*) > 1),
          v AS (SELECT entity, arg_min(violation, {'a': pos, 'v': violation}) AS violation FROM b GROUP BY entity)
          SELECT entity, sum(n)::bigint AS n_rows, count(*) AS n_kept, any_value(violation) AS violation FROM p LEFT JOIN v USING (entity) GROUP BY entity""",
    }
    dates_ = {"hysteresis_alerts": ("as_of",), "source_alerts": ("as_of",), "source_severity": ("snap_date",), "alert_upsert": ("created_at", "opened_at", "event_at")}
    made = {k: with_views(x) for k, x in sql.items()}
    return {k: dated(x, *dates_[k]) if k in dates_ else x for k, x in made.items()}
