"""Snapshots made of the months of the history, ingested in one batch into a new store, and what the store has of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.plans.quality_queries import REGRESSED, _outlier
from tidemark.plans.stream_queries import _folder
from tidemark.plans.views import Views, dated, with_views
from tidemark.sources import readers, schemas
from tidemark.streaming import ingest

# Months as snapshots, numbered. A series jumps and stays there for four months, and again later; an entity loses its periods in some months, or its price
# is ten times too high; some counts are zero.
ROWS = """
SELECT snap_date, year(snap_date) * 12 + month(snap_date) AS i, entity, period, CAST(floor((value - 150000) / 20000) AS bigint) + 100
    + CASE WHEN period = 'Jan 1997' AND (year(snap_date) * 12 + month(snap_date)) % 20 < 4 THEN 70 ELSE 0 END AS value,
  CASE WHEN entity = 'EUROPE' AND (year(snap_date) * 12 + month(snap_date)) % 13 = 7 THEN 500 ELSE 50 END AS price,
  CASE WHEN entity = 'ASIA' AND (year(snap_date) * 12 + month(snap_date)) % 17 = 3 THEN 0 ELSE coverage END AS coverage
FROM v_snap WHERE NOT (entity = 'AFRICA' AND period < 'Mar' AND (year(snap_date) * 12 + month(snap_date)) % 11 = 5)
"""
NOW = "2001-05-05T00:00:00Z"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(ROWS.replace("v_snap", "{v}"), v=Views(spark, sf_dir).snap())
    text = lambda c: F.col(c).cast("string")
    leaf = F.struct(text("value").alias("consensus"), (F.col("value") + 5).cast("string").alias("high"), (F.col("value") - 5).cast("string").alias("low"), text("coverage").alias("analysts"), F.col("period").alias("reported_fiscal_label"))
    made = rows.groupBy("snap_date", "entity").agg(F.map_from_entries(F.collect_list(F.struct("period", leaf))).alias("eps"), F.max("price").cast("string").alias("price"))
    made = made.groupBy("snap_date").agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("price", "eps")))).alias("tickers"))
    stamp = F.concat(text("snap_date"), F.when(F.month("snap_date") == 2, "T08:00:00").otherwise("T08:00:00Z"))
    whole = F.from_json(F.to_json(F.struct(stamp.alias("collectedAt"), "tickers")), schemas.SNAPSHOT)
    return made.select(F.concat(text("snap_date"), F.lit(".json")).alias("snapshot_id"), whole.alias("s")).select("snapshot_id", "s.*")


def snapshots_ingested(spark, sf_dir):
    """For each snapshot why it is in quarantine, or the events and observations that it gave."""
    snaps, store = _snapshots(spark, sf_dir), ingest.Store(_folder(spark, "ingest"))
    watch = Views(spark, sf_dir).table("region").select(F.col("r_name").alias("entity"))
    ends = watch.withColumn("fiscal_end_month", F.lit(None).cast("int"))
    ingest.ingest_batch(snaps, store, watch, ends, F.lit(NOW).cast("timestamp"), backfill=True)
    read = lambda name: spark.read.parquet(store.path(name))
    day = F.to_date(F.substring("update_time", 1, 10)).alias("snap_date")
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("baseline", "upgrade", "downgrade")]
    events = read("events").groupBy(day).agg(*kinds)
    taken = read("history").groupBy(day).agg(F.count("*").alias("n_observations"))
    refused = read("quarantine").select(F.to_date(F.substring("snapshot_id", 1, 10)).alias("snap_date"), F.col("gate_status").alias("status"), F.col("gate_reason").alias("reason"))
    return refused.join(taken, "snap_date", "full_outer").join(events, "snap_date", "full_outer").fillna(0)


def differing_leaves(spark, sf_dir):
    """Two histories that share most rows: the leaves of their hash trees that differ, and how many rows of them are on one side only."""
    rows = Views(spark, sf_dir).obs().select("entity", "period", "obs_date", "seq", F.round("value", 2).alias("value"))
    old = rows.where("seq % 97 <> 0")
    new = rows.where("seq % 89 <> 0").withColumn("value", F.when(F.col("seq") % 101 == 0, F.col("value") + 1).otherwise(F.col("value")))
    leaves = history.differing_leaves(history.hash_tree(old), history.hash_tree(new))
    found = history.differences_in(old, new, leaves).groupBy("month", "bucket").agg(*[F.count_if(F.col("side") == x).alias(f"n_{x}") for x in ("left", "right")])
    return leaves.join(found, ["month", "bucket"], "left")


# The texts of events in many shapes: cut off, no object, empty, with nulls, texts, keys of their own and nothing.
PROPS = """CASE event_id % 9 WHEN 0 THEN replace(props, '}', '') WHEN 1 THEN concat('[', props, ']') WHEN 2 THEN '{"k": null, "tag": "x"}' WHEN 3 THEN '{}' WHEN 4 THEN replace(props, '"k"', '"other"')
  WHEN 5 THEN '{"k": "later", "tag": null}' WHEN 6 THEN CASE WHEN event_id % 2 = 0 THEN '' END ELSE props END"""


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("events").select("event_type", F.expr(PROPS).alias("props"))


def variant_fields(spark, sf_dir):
    """By kind of event: texts that can't be taken, by reason, and for each field how often it is there, null, absent or of another type."""
    rows = readers.variant_fields(_props(spark, sf_dir), "props", {"k": "double", "tag": "string"})
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(c).alias("state")) for n, c in (("reject", "reject_reason"), ("k", "k_state"), ("tag", "tag_state"))])).alias("x")
    counted = rows.select("event_type", items, "k").select("event_type", "x.*", "k").where("state IS NOT NULL")
    return counted.groupBy("event_type", "item", "state").agg(F.count("*").alias("n"), F.sum(F.when(F.col("item") == "k", F.col("k"))).alias("total"))


def variant_keys(spark, sf_dir):
    return readers.variant_keys(_props(spark, sf_dir), "props")


def queries() -> dict:
    return {f.__name__: f for f in (snapshots_ingested, differing_leaves, variant_fields, variant_keys)}


def oracle_sql() -> dict:
    # one snapshot after the other: the working table is the state, a row for each series
    sql = f"""WITH RECURSIVE rw AS ({ROWS}), ids AS (SELECT DISTINCT entity, period FROM rw), sn AS (SELECT snap_date, row_number() OVER (ORDER BY snap_date) AS k FROM (SELECT DISTINCT snap_date FROM rw)),
      pe AS (SELECT snap_date, entity, max(price) AS price, count(*) AS n, bool_or(coverage = 0) AS zero FROM rw GROUP BY 1, 2),
      ps AS (SELECT snap_date, bool_or(zero) AS zero, bool_or(n < 2) AS failed, (SELECT count(*) FROM region) - count(*) AS n_missing FROM pe GROUP BY 1),
      grid AS (SELECT k, sn.snap_date, ids.entity, ids.period, rw.value, pe.price, pe.n, ps.zero, failed, n_missing FROM sn CROSS JOIN ids JOIN ps ON ps.snap_date = sn.snap_date
        LEFT JOIN pe ON pe.snap_date = sn.snap_date AND pe.entity = ids.entity LEFT JOIN rw ON rw.snap_date = sn.snap_date AND rw.entity = ids.entity AND rw.period = ids.period),
      st AS (SELECT 0::BIGINT AS k, NULL::DATE AS snap_date, entity, period, NULL::DOUBLE AS good, NULL::DOUBLE AS good_price, NULL::BIGINT AS good_n, NULL::DOUBLE AS old, NULL::DOUBLE AS value, NULL::VARCHAR AS reason FROM ids
        UNION ALL SELECT k, snap_date, entity, period, CASE WHEN taken AND value IS NOT NULL THEN value ELSE good END, CASE WHEN taken AND n > 0 THEN price ELSE previous_price END,
          CASE WHEN taken AND n > 0 THEN n ELSE n_old END, good, value, reason
        FROM (SELECT *, reason IS NULL OR reason = 'missing_watchlist_tickers' AS taken
          FROM (SELECT *, CASE WHEN month(snap_date) = 2 THEN 'invalid_snapshot_timestamp' WHEN snap_date > DATE '2001-05-05' THEN 'future_snapshot_timestamp'
            WHEN extreme THEN 'extreme_eps_change' WHEN lost THEN 'fiscal_coverage_regression' WHEN outlier THEN 'price_outlier' WHEN zero THEN 'consensus_with_zero_analysts'
            WHEN failed THEN 'validation_failed' WHEN n_missing > 0 THEN 'missing_watchlist_tickers' END AS reason
            FROM (SELECT *, bool_or(good <> 0 AND abs(value - good) / abs(good) * 100.0 > 30) OVER () AS extreme, bool_or({REGRESSED.replace("n_new", "n")}) OVER () AS lost, bool_or({_outlier(30)}) OVER () AS outlier
              FROM (SELECT g.*, s.good, s.good_price AS previous_price, s.good_n AS n_old FROM st s JOIN grid g ON g.k = s.k + 1 AND g.entity = s.entity AND g.period = s.period))))),
      ev AS (SELECT *, reason IS NULL OR reason = 'missing_watchlist_tickers' AS taken FROM st WHERE k > 0)
      SELECT snap_date, CASE WHEN taken THEN NULL WHEN reason IN ('invalid_snapshot_timestamp', 'future_snapshot_timestamp', 'validation_failed') THEN 'reject' ELSE 'needs_verification' END AS status,
        CASE WHEN NOT taken THEN reason END AS reason, count(*) FILTER (taken AND value IS NOT NULL) AS n_observations, count(*) FILTER (taken AND value IS NOT NULL AND old IS NULL) AS n_baseline,
        count(*) FILTER (taken AND value > old) AS n_upgrade, count(*) FILTER (taken AND value < old) AS n_downgrade FROM ev GROUP BY 1, 2, 3"""
    leaves = """WITH r AS (SELECT entity, period, obs_date, seq, round(value, 2) AS value FROM v_obs), o AS (SELECT * FROM r WHERE seq % 97 <> 0),
      n AS (SELECT * REPLACE (CASE WHEN seq % 101 = 0 THEN value + 1 ELSE value END AS value) FROM r WHERE seq % 89 <> 0),
      d AS (SELECT *, 1 AS l, 0 AS r FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, 0, 1 FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)),
      dl AS (SELECT strftime(obs_date, '%Y-%m') AS month, substr(md5(entity), 1, 2) AS bucket, sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right FROM d GROUP BY 1, 2),
      ol AS (SELECT strftime(obs_date, '%Y-%m') AS month, substr(md5(entity), 1, 2) AS bucket, count(*) AS n FROM o GROUP BY 1, 2), nl AS (SELECT strftime(obs_date, '%Y-%m') AS month, substr(md5(entity), 1, 2) AS bucket, count(*) AS n FROM n GROUP BY 1, 2)
      SELECT month, bucket, coalesce(ol.n, 0) AS n_before, coalesce(nl.n, 0) AS n_after, n_left, n_right FROM dl LEFT JOIN ol USING (month, bucket) LEFT JOIN nl USING (month, bucket)"""
    props = f"""WITH p AS (SELECT event_type, {PROPS} AS props FROM events), j AS (SELECT *, CASE WHEN coalesce(trim(props), '') = '' THEN 'empty' WHEN NOT json_valid(props) THEN 'malformed' WHEN json_type(props) <> 'OBJECT' THEN 'not_an_object' END AS reject FROM p),
      ok AS (SELECT event_type, CAST(props AS JSON) AS o FROM j WHERE reject IS NULL)"""
    state = "CASE coalesce(json_type(o, '$.{0}'), 'ABSENT') WHEN 'ABSENT' THEN 'absent' WHEN 'NULL' THEN 'null' {1} END"
    k = state.format("k", "WHEN 'VARCHAR' THEN 'wrong_type' ELSE 'ok'")
    made = {
        "differing_leaves": with_views(leaves),
        "variant_fields": f"""{props} SELECT event_type, 'reject' AS item, reject AS state, count(*) AS n, NULL::DOUBLE AS total FROM j WHERE reject IS NOT NULL GROUP BY 1, 3
          UNION ALL SELECT event_type, 'k', {k}, count(*), sum(TRY_CAST(o ->> 'k' AS DOUBLE)) FROM ok GROUP BY 1, 3 UNION ALL SELECT event_type, 'tag', {state.format("tag", "ELSE 'ok'")}, count(*), NULL FROM ok GROUP BY 1, 3""",
        "variant_keys": f"""{props}, ks AS (SELECT o, unnest(json_keys(o)) AS key FROM ok) SELECT key, count(*) AS n, count(*) FILTER (json_type(o, '$.' || key) = 'NULL') AS n_null FROM ks GROUP BY 1""",
    }
    return made | {"snapshots_ingested": dated(with_views(sql).replace("WITH v_", "WITH RECURSIVE v_", 1).replace(", RECURSIVE rw", ", rw", 1), "snap_date")}
