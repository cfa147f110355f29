"""Queries that write to a new folder, repeat themselves, and read back what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.plans.history_queries import HALVES, ID, _halves
from tidemark.plans.stream_queries import _folder
from tidemark.plans.views import Views, dated, with_views
from tidemark.sources import writers


def months_written(spark, sf_dir):
    """Two overlapping halves of a history, spread over months, and the second once more: every identity once, and the replay touches no month."""
    path, halves = _folder(spark, "months"), []
    for k, half in enumerate(_halves(spark, sf_dir)):
        half.withColumn("obs_date", F.add_months("obs_date", F.dayofmonth("obs_date"))).write.parquet(f"{path}-half{k}")
        halves.append(spark.read.parquet(f"{path}-half{k}"))
    old, new = halves
    writers.write_months(old, path)
    writers.write_months(new, path)
    if again := writers.write_months(new, path):
        raise AssertionError(f"a replay rewrote {again}")
    return spark.read.parquet(path).select(*ID.split(", "), "value", "coverage")


def events_appended(spark, sf_dir):
    """Two overlapping batches of events and the first once more, into a log by day."""
    rows = Views(spark, sf_dir).obs_ev().select(F.col("seq").cast("string").alias("event_id"), "entity", "period", "value", F.date_format("update_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("update_time"), "seq")
    path, first = _folder(spark, "event-log"), rows.where("seq % 3 <> 0")
    for batch in (first, rows.where("seq % 2 = 0"), first):
        writers.append_events(batch, path)
    return spark.read.parquet(path).select("event_id", "entity", F.col("day").cast("string").alias("day"))


def runtime_table(spark, sf_dir):
    """A runtime table that is swapped for another: its rows without repeats, and their order by day."""
    old, new = _halves(spark, sf_dir)
    path = _folder(spark, "runtime")
    writers.materialize(old, path)
    writers.materialize(history.new_observations(old, new), path)
    return spark.read.parquet(path).select(*ID.split(", "), "value")


def queries() -> dict:
    return {f.__name__: f for f in (months_written, events_appended, runtime_table)}


def oracle_sql() -> dict:
    spread = ID.replace("obs_date", "CAST(obs_date + to_months(CAST(day(obs_date) AS INT)) AS DATE) AS obs_date")
    sql = {
        "months_written": "WITH " + HALVES + f" SELECT {spread}, value, coverage FROM one WHERE seq % 3 <> 0 OR seq % 2 = 0",
        "events_appended": "SELECT CAST(seq AS VARCHAR) AS event_id, entity, strftime(update_ts, '%Y-%m-%d') AS day FROM v_obs_ev WHERE seq % 3 <> 0 OR seq % 2 = 0",
        "runtime_table": "WITH " + HALVES + f" SELECT {ID}, value FROM one WHERE seq % 2 = 0 AND NOT seq % 3 <> 0",
    }
    made = {k: with_views(x) for k, x in sql.items()}
    return {k: dated(x, "obs_date") if k != "events_appended" else x for k, x in made.items()}
