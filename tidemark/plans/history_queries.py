"""Queries over the history operators: three overlapping sources cut from the event view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.plans.views import Views, dated, with_views

# The same raw text columns in both engines. Every kind of reject occurs, and values differ between sources on purpose.
RAW = """
SELECT entity AS ticker,
  CASE WHEN seq % 97 = 0 THEN '2027E' WHEN seq % 101 = 0 THEN '' WHEN seq % 103 = 0 THEN 'Fiscal' ELSE period END AS "reportedFiscalPeriodEnding",
  CASE WHEN seq % 89 = 0 THEN 'n/a' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS {text}) END AS consensus,
  CAST(seq % 7 AS {text}) AS analysts,
  CASE WHEN seq % 83 = 0 THEN 'soon' ELSE CAST(obs_date AS {text}) END AS "date",
  CASE WHEN seq % 79 = 0 THEN NULL ELSE CAST(seq % 40 AS {text}) END AS "updateTime",
  CASE WHEN seq % 73 = 0 THEN 'revision_history_seed' ELSE 'daily' END AS "source",
  CASE WHEN seq % 71 = 0 THEN 'true' END AS "collectionFailed", seq
FROM v_obs_ev
"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = Views(spark, sf_dir).obs_ev()
    return spark.sql(RAW.format(text="STRING").replace('"', "`").replace("FROM v_obs_ev", "FROM {v}"), v=view)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical, archive and export: overlapping thirds and halves; the export's every 50th value is off by one. Each row is classified
    once, then given to its sources."""
    rows = history.classified(raw_rows(spark, sf_dir))
    source = lambda name, priority, where, off: F.when(F.expr(where), F.struct(F.lit(name).alias("source_name"), F.lit(priority).alias("priority"), F.lit(off).alias("off")))
    sources = F.array_compact(F.array(source("canonical", 0, "seq % 3 <> 0", 0.0), source("archive", 1, "seq % 2 = 0", 0.0), source("export", 2, "seq % 5 = 0", 1.0)))
    value = F.col("value") + F.when(F.col("seq") % 50 == 0, F.col("s.off")).otherwise(0.0)
    return rows.withColumn("s", F.explode(sources)).select(*[value.alias(c) if c == "value" else c for c in rows.columns], "s.source_name", "s.priority")


CLASSIFIED = (
    "raw AS ("
    + RAW.format(text="VARCHAR")
    + """),
cl AS (SELECT seq, upper(trim(ticker)) AS entity, "reportedFiscalPeriodEnding" AS period, TRY_CAST("date" AS date) AS obs_date,
  coalesce("updateTime", "date" || 'T00:00:00Z') AS update_time, TRY_CAST(consensus AS double) AS value, CAST(analysts AS double) AS coverage,
  "updateTime" IS NOT NULL AS had_update_time,
  CASE WHEN "source" = 'revision_history_seed' THEN 'seed_from_revision_history' WHEN "collectionFailed" = 'true' THEN 'collection_failed_or_lkg'
    WHEN "reportedFiscalPeriodEnding" = '2027E' THEN 'mapped_year_not_identity' WHEN "reportedFiscalPeriodEnding" = '' THEN 'invalid_fiscal_identity'
    WHEN TRY_CAST(consensus AS double) IS NULL THEN 'invalid_consensus' WHEN TRY_CAST("date" AS date) IS NULL THEN 'invalid_date'
    WHEN "reportedFiscalPeriodEnding" = 'Fiscal' THEN 'rejected_by_canonical_admission' END AS reject_reason FROM raw),
tagged AS (SELECT *, 'canonical' AS source_name, 0 AS priority FROM cl WHERE seq % 3 <> 0
  UNION ALL SELECT *, 'archive', 1 FROM cl WHERE seq % 2 = 0
  UNION ALL SELECT * REPLACE (value + CASE WHEN seq % 50 = 0 THEN 1.0 ELSE 0.0 END AS value), 'export', 2 FROM cl WHERE seq % 5 = 0),
ok AS (SELECT * FROM tagged WHERE reject_reason IS NULL)
"""
)
ID = "entity, period, obs_date, update_time"


def admission(spark, sf_dir):
    return history.classified(raw_rows(spark, sf_dir)).select("seq", "entity", "obs_date", "value", "coverage", "reject_reason")


def dup_conflicts(spark, sf_dir):
    return history.identity_groups(tagged(spark, sf_dir).where("reject_reason is null"))


def source_stats(spark, sf_dir):
    return history.source_stats(tagged(spark, sf_dir))


def reject_histogram(spark, sf_dir):
    return history.reject_histogram(tagged(spark, sf_dir))


def reconcile_plan(spark, sf_dir):
    return history.reconcile(tagged(spark, sf_dir))


def reconcile_report(spark, sf_dir):
    return history.reconcile_report(history.reconcile(tagged(spark, sf_dir)))


def _halves(spark, sf_dir):
    rows = history.classified(raw_rows(spark, sf_dir)).where("reject_reason is null")
    one = rows.groupBy(*history.IDENTITY).agg(F.min_by(F.struct("value", "coverage"), "seq").alias("p"), F.min("seq").alias("seq")).select(*history.IDENTITY, "p.*", "seq")
    return one.where("seq % 3 <> 0"), one.where("seq % 2 = 0")


HALVES = CLASSIFIED + f", one AS (SELECT {ID}, arg_min(value, seq) AS value, arg_min(coverage, seq) AS coverage, min(seq) AS seq FROM cl WHERE reject_reason IS NULL GROUP BY {ID})"


def idempotent_merge(spark, sf_dir):
    return history.idempotent_merge(*_halves(spark, sf_dir))


def touched_months(spark, sf_dir):
    """Days as months: the events span one month only."""
    old, new = _halves(spark, sf_dir)
    spread = lambda df: df.withColumn("obs_date", F.add_months("obs_date", F.dayofmonth("obs_date")))
    old, new = spread(old), spread(new.where("day(obs_date) % 3 = 0"))
    return history.touched_months(old, history.idempotent_merge(old, new))


def missing_at_remote(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return history.missing_at_remote(new, old)


def table_differences(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return history.table_differences(old.select("entity", "period", "value"), new.select("entity", "period", "value")).groupBy("side", "entity").agg(F.count("*").alias("n"))


def entity_ranges(spark, sf_dir):
    return history.entity_ranges(Views(spark, sf_dir).obs())


def change_events(spark, sf_dir):
    out = history.change_events(Views(spark, sf_dir).obs())
    return out.withColumns({"change": F.round("change", 6), "pct": F.round("pct", 6)})


def _coarse(spark, sf_dir):
    """Values in steps of 50, so that a day repeats and returns to values."""
    return Views(spark, sf_dir).obs_ev().withColumn("value", F.floor(F.col("value") / 50).cast("double"))


def change_only_append(spark, sf_dir):
    return history.change_only(_coarse(spark, sf_dir)).select("entity", "period", "obs_date", "seq", "value")


def last_write(spark, sf_dir):
    return history.last_write(Views(spark, sf_dir).obs().select("entity", "period", "obs_date", "seq", "value"))


def dataset_fingerprint(spark, sf_dir):
    """The fingerprint does not depend on the order of the rows, and tells one changed value."""
    rows = Views(spark, sf_dir).obs()
    mark = lambda df, name: history.dataset_fingerprint(df).select("n_rows", F.col("fingerprint").alias(name))
    moved = rows.repartition(7, "period").sortWithinPartitions(F.desc("seq"))
    changed = rows.withColumn("value", F.col("value") + F.when(F.col("seq") == 1, 0.01).otherwise(0.0))
    all_ = mark(rows, "one").join(mark(moved, "two"), "n_rows").join(mark(changed, "three"), "n_rows")  # a row each
    return all_.select("n_rows", (F.col("one") == F.col("two")).alias("same_in_any_order"), (F.col("one") != F.col("three")).alias("tells_a_change"))


def queries() -> dict:
    return {
        "admission": admission,
        "dup_conflicts": dup_conflicts,
        "source_stats": source_stats,
        "reject_histogram": reject_histogram,
        "reconcile_plan": reconcile_plan,
        "reconcile_report": reconcile_report,
        "idempotent_merge": idempotent_merge,
        "touched_months": touched_months,
        "missing_at_remote": missing_at_remote,
        "table_differences": table_differences,
        "entity_ranges": entity_ranges,
        "change_events": change_events,
        "change_only_append": change_only_append,
        "last_write": last_write,
        "dataset_fingerprint": dataset_fingerprint,
    }


def oracle_sql() -> dict:
    groups = f"g AS (SELECT {ID}, count(*) AS n_rows, count(DISTINCT value || '/' || coverage) AS n_payloads FROM ok GROUP BY {ID})"
    plan = f"""p AS (SELECT {ID}, count(*) AS n_rows, CASE WHEN count(DISTINCT value || '/' || coverage) > 1 THEN 'conflict'
      WHEN bool_or(source_name = 'canonical') THEN 'existing' ELSE 'add' END AS action, arg_min(value, priority) AS value, arg_min(coverage, priority) AS coverage,
      arg_min(source_name, priority) AS source_name FROM ok GROUP BY {ID})"""
    spread = "obs_date + to_months(CAST(day(obs_date) AS int))"
    sql = {
        "admission": "WITH " + CLASSIFIED + "SELECT seq, entity, obs_date, value, coverage, reject_reason FROM cl",
        "dup_conflicts": "WITH " + CLASSIFIED + "," + groups + f"SELECT {ID}, n_rows, n_payloads, CASE WHEN n_payloads > 1 THEN 'conflict' ELSE 'exact_duplicate' END AS kind FROM g WHERE n_rows > 1",
        "source_stats": "WITH "
        + CLASSIFIED
        + f""", i AS (SELECT source_name, count(*) AS n, count(DISTINCT value || '/' || coverage) AS k FROM ok GROUP BY source_name, {ID}),
          j AS (SELECT source_name, count(*) AS n_identities, count(*) FILTER (n > 1 AND k = 1) AS n_duplicate_ids, count(*) FILTER (k > 1) AS n_conflict_ids FROM i GROUP BY 1),
          c AS (SELECT source_name, count(*) AS n_raw, count(*) FILTER (reject_reason IS NULL) AS n_valid, count(*) FILTER (reject_reason IS NOT NULL) AS n_rejected,
            count(*) FILTER (reject_reason IS NULL AND NOT had_update_time) AS n_missing_update_time, min(obs_date) FILTER (reject_reason IS NULL) AS earliest,
            max(obs_date) FILTER (reject_reason IS NULL) AS latest FROM tagged GROUP BY 1) SELECT * FROM c JOIN j USING (source_name)""",
        "reject_histogram": "WITH " + CLASSIFIED + "SELECT source_name, reject_reason, count(*) AS n FROM tagged WHERE reject_reason IS NOT NULL GROUP BY 1, 2",
        "reconcile_plan": "WITH " + CLASSIFIED + "," + plan + f"SELECT {ID}, n_rows, action, CASE WHEN action <> 'conflict' THEN value END AS value, CASE WHEN action <> 'conflict' THEN coverage END AS coverage, CASE WHEN action <> 'conflict' THEN source_name END AS source_name FROM p",
        "reconcile_report": "WITH "
        + CLASSIFIED
        + ","
        + plan
        + """SELECT count(*) FILTER (action = 'add') AS n_new, count(*) FILTER (action = 'existing') AS n_existing, count(*) FILTER (action = 'conflict') AS n_conflicts,
          coalesce(sum(n_rows - 1) FILTER (action <> 'conflict'), 0)::bigint AS n_duplicates, count(*) FILTER (action = 'conflict') = 0 AS applicable FROM p""",
        "idempotent_merge": "WITH " + HALVES + f" SELECT {ID}, value, coverage FROM one WHERE seq % 3 <> 0 OR seq % 2 = 0",
        "touched_months": "WITH "
        + HALVES
        + f""", s AS (SELECT strftime({spread}, '%Y-%m') AS month, seq % 3 <> 0 AS old, seq % 2 = 0 AND day(obs_date) % 3 = 0 AS new FROM one)
          SELECT month, count(*) FILTER (old) AS n_before, count(*) FILTER (old OR new) AS n_after FROM s GROUP BY month HAVING count(*) FILTER (old) <> count(*) FILTER (old OR new)""",
        "missing_at_remote": "WITH " + HALVES + f" SELECT {ID}, value, coverage FROM one WHERE seq % 2 = 0 AND NOT seq % 3 <> 0",
        "table_differences": "WITH "
        + HALVES
        + """, a AS (SELECT entity, period, value FROM one WHERE seq % 3 <> 0), b AS (SELECT entity, period, value FROM one WHERE seq % 2 = 0)
          SELECT side, entity, count(*) AS n FROM (SELECT 'left' AS side, entity FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', entity FROM (FROM b EXCEPT ALL FROM a)) GROUP BY 1, 2""",
        "entity_ranges": "SELECT entity, count(*) AS n, min(obs_date) AS earliest, max(obs_date) AS latest FROM v_obs GROUP BY entity",
        "change_events": """WITH w AS (SELECT *, lag(value) OVER s AS previous, row_number() OVER s AS n FROM v_obs WINDOW s AS (PARTITION BY entity, period ORDER BY obs_date, seq))
          SELECT entity, period, obs_date, seq, previous, value, round(value - previous, 6) AS change, round(CASE WHEN previous <> 0 THEN (value - previous) / abs(previous) * 100.0 END, 6) AS pct,
          CASE WHEN n = 1 THEN 'baseline' WHEN value > previous THEN 'upgrade' ELSE 'downgrade' END AS kind FROM w WHERE n = 1 OR abs(value - previous) >= 1e-9""",
        "change_only_append": """WITH c AS (SELECT entity, period, obs_date, seq, floor(value / 50) AS value FROM v_obs_ev),
          w AS (SELECT *, lag(value) OVER s AS p, row_number() OVER s AS n FROM c WINDOW s AS (PARTITION BY entity, period, obs_date ORDER BY seq))
          SELECT entity, period, obs_date, seq, value FROM w WHERE n = 1 OR abs(value - p) >= 1e-9""",
        "dataset_fingerprint": "SELECT count(*) AS n_rows, true AS same_in_any_order, bool_or(seq = 1) AS tells_a_change FROM v_obs",
        "last_write": "SELECT entity, period, obs_date, max(seq) AS seq, arg_max(value, seq) AS value FROM v_obs GROUP BY 1, 2, 3",
    }
    dates = {
        "admission": ("obs_date",),
        "dup_conflicts": ("obs_date",),
        "source_stats": ("earliest", "latest"),
        "reconcile_plan": ("obs_date",),
        "idempotent_merge": ("obs_date",),
        "missing_at_remote": ("obs_date",),
        "entity_ranges": ("earliest", "latest"),
        "change_events": ("obs_date",),
        "change_only_append": ("obs_date",),
        "last_write": ("obs_date",),
    }
    made = {k: with_views(x) for k, x in sql.items()}
    return {k: dated(x, *dates[k]) if k in dates else x for k, x in made.items()}
