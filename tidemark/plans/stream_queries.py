"""Queries that run a stream to its end, and health reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import alerts as batch
from tidemark.operators import health, history, windows
from tidemark.plans.history_queries import CLASSIFIED, ID, tagged
from tidemark.plans.views import OBS_EV, Views, with_views
from tidemark.plans.window_queries import _panel
from tidemark.streaming import alerts, ingest


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """Run ``stream`` over all that is there into files, and read them."""
    spark, path = stream.sparkSession, _folder(stream.sparkSession, name)
    with alerts.rocksdb(spark):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, since a stream's plain path must be a folder and the table may be one file
    schema = Views(spark, sf_dir).table("events").schema
    return spark.sql(OBS_EV.replace("FROM events", "FROM {e}"), e=spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet"))


def stream_alerts(spark, sf_dir):
    """The hysteresis over every user's events as a stream; the oracle is the batch form."""
    series = _event_stream(spark, sf_dir).select("entity", "period", F.col("update_ts").alias("as_of"), ((F.col("value") - 60) / 10).alias("pct"))
    path = _folder(spark, "stream-alerts")
    alerts.alert_log(series, path).awaitTermination()
    out = alerts.logged(spark, path, alerts.EVENTS)
    return out.select("entity", "period", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"), F.round("pct", 6).alias("pct"), "event", "episode")


def sliced_alerts(spark, sf_dir):
    """The batch form over the same events, each series cut into days, the state machine composed over them."""
    series = Views(spark, sf_dir).obs_ev().select("entity", "period", F.col("update_ts").alias("as_of"), ((F.col("value") - 60) / 10).alias("pct"))
    out = batch.hysteresis(series, cut=F.datediff("as_of", F.lit("1970-01-01")).cast("long"))
    return out.withColumns({"as_of": F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"), "pct": F.round("pct", 6)})


RESUMED = "2024-01-16"


def resumed_alerts(spark, sf_dir):
    """The first half of the events in batch, the second as a new stream that begins with the alerts that are open by then. The oracle is one run over all."""
    series = lambda rows: rows.select("entity", "period", F.col("update_ts").alias("as_of"), ((F.col("value") - 60) / 10).alias("pct"))
    path = _folder(spark, "resumed-alerts")
    batch.hysteresis(series(Views(spark, sf_dir).obs_ev()).where(F.col("as_of") < F.lit(RESUMED))).write.parquet(f"{path}-first")
    first = spark.read.parquet(f"{path}-first")
    alerts.alert_log(series(_event_stream(spark, sf_dir)).where(F.col("as_of") >= F.lit(RESUMED)), path, open_alerts=alerts.newest_open(first)).awaitTermination()
    out = first.unionByName(alerts.logged(spark, path, alerts.EVENTS))
    return out.select("entity", "period", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"), F.round("pct", 6).alias("pct"), "event")


def one_shot_states(spark, sf_dir):
    """Every event is a one-shot alert of its user and kind: when each became active and when it had expired by the end of the stream."""
    rows = _event_stream(spark, sf_dir).select(F.concat_ws(":", "entity", "period").alias("id"), F.col("update_ts").alias("event_at"))
    path = _folder(spark, "one-shots")
    alerts.one_shot_log(rows, path).awaitTermination()
    out = alerts.logged(spark, path, alerts.STATES)
    return out.select("id", "state", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


CUTOFF_NOW, CUTOFF_AS_OF = "2024-01-25 12:00:00", "2024-01-25 06:00:00"


def late_rows(spark, sf_dir):
    """The events as a stream with their verdicts: what may be seen goes to one table, what may not to another, with the reason."""
    rows = _event_stream(spark, sf_dir).select("seq", "entity", F.col("update_ts").alias("known_at"))
    path = _folder(spark, "late-rows")
    ingest.route(rows, F.lit(CUTOFF_NOW).cast("timestamp"), path, as_of=F.lit(CUTOFF_AS_OF).cast("timestamp")).awaitTermination()
    seen, late = ingest.routed(spark, path, rows.schema)
    both = seen.withColumn("verdict", F.lit("seen")).unionByName(late)
    return both.groupBy("entity", "verdict").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def stream_dedup(spark, sf_dir):
    """Every event twice, with the repeats taken out."""
    events = _event_stream(spark, sf_dir).select(F.col("seq").alias("event_id"), F.col("update_ts").alias("event_at"), "entity", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return _drained(ingest.deduplicated(events, "60 days"), "stream-dedup").groupBy("entity").agg(F.count("*").alias("n"))


def freshness_monitor(spark, sf_dir):
    obs = Views(spark, sf_dir).obs_ev()
    watch = obs.select("entity").distinct()
    successes = obs.where("seq % 4 = 0").select("entity", F.col("update_ts").alias("at"))
    return ingest.freshness(watch, successes, F.lit("2024-01-29T20:00:00Z").cast("timestamp")).select("entity", "stale")


def history_health(spark, sf_dir):
    rows = tagged(spark, sf_dir).where("reject_reason is null and source_name = 'canonical'").select(*history.OBSERVATION)
    runtime = rows.where("coverage <> 3")
    ready = windows.readiness(_panel(Views(spark, sf_dir))).where("as_of = DATE'1999-06-30'")
    rejected = tagged(spark, sf_dir).where("reject_reason is not null and source_name = 'canonical'")
    return health.history_health(rows, runtime, ready, rejected, freshness_monitor(spark, sf_dir))


def overall_health(spark, sf_dir):
    return health.overall(history_health(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (stream_alerts, sliced_alerts, resumed_alerts, one_shot_states, late_rows, stream_dedup, freshness_monitor, history_health, overall_health)}


def oracle_sql() -> dict:
    from tidemark.plans.window_queries import PANEL

    fresh = """last AS (SELECT entity, max(update_ts) FILTER (seq % 4 = 0) AS seen FROM v_obs_ev GROUP BY entity),
      fr AS (SELECT entity, seen IS NULL OR seen < TIMESTAMP '2024-01-29 00:00:00' AS stale FROM last)"""
    lifecycle = """WITH ser AS (SELECT entity, period, update_ts AS as_of, (value - 60) / 10 AS pct, seq FROM v_obs_ev),
          sg AS (SELECT *, CASE WHEN abs(pct) >= 5 THEN 1 WHEN abs(pct) < 4 THEN 0 END AS signal FROM ser WHERE pct IS NOT NULL),
          st AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY entity, period ORDER BY as_of, pct ROWS UNBOUNDED PRECEDING), 0) AS state FROM sg),
          bf AS (SELECT *, coalesce(lag(state) OVER w, 0) AS before, lag(pct) OVER w AS stored FROM st WINDOW w AS (PARTITION BY entity, period ORDER BY as_of, pct)),
          ep AS (SELECT *, sum(CASE WHEN state = 1 AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity, period ORDER BY as_of, pct ROWS UNBOUNDED PRECEDING)::bigint AS episode FROM bf),
          e AS (SELECT *, CASE WHEN state = 1 AND before = 0 THEN 'Open' WHEN state = 0 AND before = 1 THEN 'Resolved' WHEN state = 1 AND abs(pct) < 5 THEN 'Hold'
            WHEN state = 1 THEN CASE WHEN sign(pct) <> sign(stored) OR abs(pct - stored) >= 1 THEN 'Updated' ELSE 'Hold' END END AS event FROM ep)"""
    shown = "entity, period, strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of, round(pct, 6) AS pct, event"
    whole_run = f"{lifecycle} SELECT {shown}, episode FROM e WHERE event IS NOT NULL"
    groups = f"g AS (SELECT {ID}, count(*) AS n, count(DISTINCT value || '/' || coverage) AS k FROM ok WHERE source_name = 'canonical' GROUP BY {ID})"
    checks = f"""hc AS (SELECT 'conflicting_identities' AS "check", (SELECT count(*) FROM g WHERE k > 1) AS n, 2 AS lvl UNION ALL SELECT 'exact_duplicates', (SELECT count(*) FROM g WHERE n > 1 AND k = 1), 1
      UNION ALL SELECT 'history_rows', (SELECT count(*) FROM ok WHERE source_name = 'canonical'), 2 UNION ALL SELECT 'wrong_month', 0, 2
      UNION ALL SELECT 'runtime_differences', (SELECT count(*) FROM ok WHERE source_name = 'canonical' AND coverage = 3), 2
      UNION ALL SELECT 'not_ready', (SELECT count(*) FROM (SELECT entity FROM judged WHERE as_of = DATE '1999-06-30' GROUP BY entity HAVING NOT bool_or(reason IS NULL))), 1
      UNION ALL SELECT 'quarantined', (SELECT count(*) FROM tagged WHERE source_name = 'canonical' AND reject_reason IS NOT NULL), 1 UNION ALL SELECT 'stale_entities', (SELECT count(*) FROM fr WHERE stale), 1),
      hr AS (SELECT "check", n, CASE WHEN ("check" = 'history_rows') = (n > 0) THEN 0 ELSE lvl END AS rank FROM hc)"""
    whole = PANEL.strip() + ", " + CLASSIFIED + ", " + groups + ", " + fresh + ", " + checks
    sql = {
        "stream_alerts": whole_run,
        "sliced_alerts": whole_run,
        "resumed_alerts": f"{lifecycle} SELECT {shown} FROM e WHERE event IS NOT NULL",
        "one_shot_states": f"""WITH t AS (SELECT concat_ws(':', entity, period) AS id, update_ts AS x FROM v_obs_ev), mark AS (SELECT max(x) - INTERVAL 1 DAY AS mark FROM t),
          one AS (SELECT id, min(x) AS x FROM t GROUP BY id), two AS (SELECT t.id, min(t.x) AS x FROM t JOIN one USING (id) WHERE t.x >= one.x + INTERVAL {dates.ONE_SHOT_DAYS} DAY GROUP BY t.id),
          s AS (SELECT id, 'active' AS state, x FROM one UNION ALL SELECT id, 'active', x FROM two UNION ALL
            SELECT one.id, 'expired', one.x + INTERVAL {dates.ONE_SHOT_DAYS} DAY FROM one CROSS JOIN mark LEFT JOIN two USING (id) WHERE two.id IS NOT NULL OR one.x + INTERVAL {dates.ONE_SHOT_DAYS} DAY <= mark)
          SELECT id, state, strftime(x, '%Y-%m-%d %H:%M:%S') AS "at" FROM s""",
        "late_rows": f"""WITH v AS (SELECT entity, seq, CASE WHEN update_ts > TIMESTAMP '{CUTOFF_NOW}' + INTERVAL 10 MINUTE THEN 'future' WHEN update_ts > TIMESTAMP '{CUTOFF_AS_OF}' THEN 'after_as_of'
          WHEN update_ts < TIMESTAMP '{CUTOFF_NOW}' - INTERVAL 14 DAY THEN 'too_old' ELSE 'seen' END AS verdict FROM v_obs_ev)
          SELECT entity, verdict, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM v GROUP BY ALL""",
        "stream_dedup": "SELECT entity, count(*) AS n FROM v_obs_ev GROUP BY entity",
        "freshness_monitor": f"WITH {fresh} SELECT * FROM fr",
        "history_health": f'{whole} SELECT "check", n::bigint AS n, rank FROM hr',
        "overall_health": f"{whole} SELECT CASE max(rank) WHEN 2 THEN 'FAILED' WHEN 1 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status, count(*) FILTER (rank > 0) AS n_findings FROM hr",
    }
    return {k: with_views(x) for k, x in sql.items()}
