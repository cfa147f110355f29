"""Queries over the composite datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import datasets, digests, history
from tidemark.plans.alert_queries import EVENTS, _events
from tidemark.plans.views import Views, dated, with_views

YEARS = ["1995E", "1996E", "1997E", "1998E", "1999E", "2000E", "2001E"]
# Yearly rows as snapshots: a display year per order year, some revisions unavailable.
ROWS = """
SELECT CAST(month(obs_date) AS string) AS snapshot_id, entity, concat(CAST(year(obs_date) AS string), 'E') AS slot, period AS label, CAST(CAST(round(avg(value)) AS bigint) AS string) AS value,
  CAST(CAST(ceil(max(value)) AS bigint) AS string) AS high, CAST(CAST(floor(min(value)) AS bigint) AS string) AS low, CAST(count(*) AS string) AS coverage,
  CASE WHEN count(*) % 5 = 0 THEN 'n/a' ELSE concat(CAST(CAST(round(avg(value) / 10000) AS int) - 15 AS string), '%') END AS rev_1m, CAST(NULL AS string) AS rev_3m, CAST(NULL AS string) AS rev_6m
FROM v_obs GROUP BY entity, period, month(obs_date), year(obs_date)
"""


def _rows(spark, sf_dir):
    return spark.sql(ROWS.replace("v_obs", "{v}"), v=Views(spark, sf_dir).obs())


def companies(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    month = F.col("snapshot_id").cast("int")
    entities = rows.select("snapshot_id", "entity").distinct().select(
        "snapshot_id", "entity", F.concat(F.lit("$1,"), F.lpad("snapshot_id", 3, "0")).alias("price"), F.when(month % 2 == 0, F.concat(F.lit("Post-market $1"), "snapshot_id", F.lit(".5"))).alias("price_as_of"),
        F.when(month % 3 != 0, F.concat("snapshot_id", F.lit("/5/1999 (Pre-Market)"))).alias("next_earnings"), F.array(F.when(month % 4 == 0, "Pull failed").otherwise("none")).alias("data_gaps"),
    )
    return datasets.companies(rows, entities, YEARS)


def period_table(spark, sf_dir):
    out = datasets.periods(_rows(spark, sf_dir))
    return out.select("snapshot_id", "entity", "slot", "period", "value", F.round("dispersion", 6).alias("dispersion"), "rev_1m", "fiscal_equals_calendar")


def mapping_audit(spark, sf_dir):
    snap = Views(spark, sf_dir).snap()
    return datasets.mapping_audit(snap.withColumn("value", F.round("value", 4))).groupBy("period", "slot", "rule").agg(F.count("*").alias("n"))


def revision_browser(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("slot", F.col("period"))
    return datasets.revision_browser(rows, slot="1997E").select("entity", "slot", "date", "seq")


def event_dates(spark, sf_dir):
    return datasets.event_dates(_events(spark, sf_dir))


def summary_values(spark, sf_dir):
    return datasets.summary_values(Views(spark, sf_dir).obs(), F.lit("2001-09-01").cast("date"))


def digest_provenance(spark, sf_dir):
    pages = Views(spark, sf_dir).table("pages")
    k = F.col("page_id") % 3
    source = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("url"))
    rows = pages.select(
        F.when(k == 0, "ACME").otherwise("OTHER").alias("entity"), "page_id", F.array(source("seeking_alpha", F.concat(F.lit("https://seekingalpha.com/"), "page_id")), source("company_ir", F.concat(F.lit("https://ir.known.example/"), "page_id"))).alias("sources"),
        F.when(k == 1, F.concat(F.lit("https://www.sec.gov/"), "page_id")).alias("actuals_url"), F.when(k == 2, F.concat(F.lit("https://www.cnbc.com/"), "page_id")).alias("comparison_url"),
    )
    return digests.provenance(rows, spark.createDataFrame([("ACME", "known.example")], "entity string, domain string"))


def wrong_rows(spark, sf_dir):
    """Observation rows per entity that an export lacks, by payload."""
    rows = history.classified(Views(spark, sf_dir).obs_ev().select(F.col("entity").alias("ticker"), F.col("period").alias("reportedFiscalPeriodEnding"), F.col("value").cast("string").alias("consensus"), F.col("obs_date").cast("string").alias("date"), F.col("seq").cast("string").alias("updateTime"), "seq"))
    remote = rows.where("seq % 7 <> 0")
    return history.missing_at_remote(rows, remote).groupBy("entity").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {f.__name__: f for f in (companies, period_table, mapping_audit, revision_browser, event_dates, summary_values, digest_provenance, wrong_rows)}


def oracle_sql() -> dict:
    by_year = ", ".join(f"max(v) FILTER (slot = '{y}') AS \"value_{y}\"" for y in YEARS)
    shown = ", ".join(f'"value_{y}"' for y in YEARS)
    typed = "rw AS (" + ROWS + "), ty AS (SELECT *, CAST(value AS double) AS v, CAST(high AS double) AS h, CAST(low AS double) AS l, TRY_CAST(replace(rev_1m, '%', '') AS double) AS r FROM rw)"
    sql = {
        "companies": f"""WITH {typed}, w AS (SELECT snapshot_id, entity, {by_year},
            max(r) FILTER (slot = '{YEARS[1]}') AS near, max(r) FILTER (slot = '{YEARS[2]}') AS far, CAST(snapshot_id AS int) AS m FROM ty GROUP BY 1, 2)
          SELECT snapshot_id, entity, 1000.0::double + m AS last_close, CASE WHEN m % 2 = 0 THEN CAST('1' || snapshot_id || '.5' AS double) END AS after_hours,
          CASE WHEN m % 3 <> 0 THEN strftime(make_date(1999, m, 5), '%b ') || '5, 1999 · Pre-Market · Estimated' END AS next_event, CASE WHEN m % 3 <> 0 THEN 'Pre-Market' END AS session,
          CASE WHEN near >= 3 AND far >= 3 THEN 'Strong Positive' WHEN near >= 1 AND far >= 1 THEN 'Positive' WHEN near <= -3 AND far <= -3 THEN 'Strong Negative' WHEN near <= -1 AND far <= -1 THEN 'Negative' ELSE 'Neutral' END AS momentum,
          CASE WHEN near IS NULL OR far IS NULL THEN 'Insufficient Data' WHEN near < 0 AND far >= 5 THEN 'Back-end Loaded / Divergent' WHEN near >= 5 AND far < 0 THEN 'Front-loaded / Divergent' WHEN near >= 3 AND far >= 3 THEN 'Broad Upward Revision'
            WHEN near <= -3 AND far <= -3 THEN 'Broad Downward Revision' WHEN abs(near) < 1 AND abs(far) < 1 THEN 'Stable' WHEN near > 0 AND far > 0 THEN 'Mild Upward' WHEN near < 0 AND far < 0 THEN 'Mild Downward' ELSE 'Divergent / Mixed' END AS regime,
          m % 4 = 0 AS collection_failed, {shown} FROM w""",
        "period_table": f"WITH {typed} SELECT snapshot_id, entity, slot, label AS period, v AS value, round(CASE WHEN v > 0 THEN (h - l) / v END, 6) AS dispersion, r AS rev_1m, label LIKE 'Dec %' AS fiscal_equals_calendar FROM ty",
        "mapping_audit": """SELECT period, CASE WHEN left(period, 3) IN ('Jan', 'Feb', 'Mar') THEN CAST(right(period, 4) AS int) - 1 ELSE CAST(right(period, 4) AS int) END || 'E' AS slot,
          CASE WHEN left(period, 3) IN ('Jan', 'Feb', 'Mar') THEN 'January to March: prior year' WHEN period LIKE 'Dec%' THEN 'calendar year' ELSE 'ending year' END AS rule, count(*) AS n FROM v_snap GROUP BY 1, 2, 3""",
        "revision_browser": f"WITH {EVENTS} SELECT entity, period AS slot, \"date\", seq FROM ev WHERE period = '1997E'",
        "event_dates": f'WITH {EVENTS} SELECT DISTINCT "date" FROM ev',
        "summary_values": "SELECT entity, period, obs_date, value, datediff('day', obs_date, DATE '2001-09-01') AS age_days FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY obs_date DESC, seq DESC) AS n FROM v_obs) WHERE n = 1",
        "digest_provenance": """WITH p AS (SELECT page_id, page_id % 3 AS k, CASE WHEN page_id % 3 = 0 THEN 'ACME' ELSE 'OTHER' END AS entity FROM pages)
          SELECT entity, 'actuals' AS part, CASE WHEN k = 1 THEN 'https://www.sec.gov/' ELSE 'https://ir.known.example/' END || page_id AS url, CASE WHEN k = 2 THEN 'unverified_ir_candidate' ELSE '1' END AS tier FROM p
          UNION ALL SELECT entity, 'comparison', CASE WHEN k = 2 THEN 'https://www.cnbc.com/' ELSE 'https://seekingalpha.com/' END || page_id, CASE WHEN k = 2 THEN '3' ELSE '4' END FROM p""",
        "wrong_rows": "SELECT entity, count(*) AS n FROM v_obs_ev WHERE seq % 7 = 0 GROUP BY entity",
    }
    made = {k: with_views(x) for k, x in sql.items()}
    made["summary_values"] = dated(made["summary_values"], "obs_date")
    return made
