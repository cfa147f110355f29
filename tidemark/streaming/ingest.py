"""Ingest of snapshots as a stream: gate, quarantine, events, observations. Batches can be replayed without effect."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.dates import is_stale
from tidemark.functions.numbers import to_num
from tidemark.operators import gate_chain, quality
from tidemark.sources import readers, schemas, writers


@dataclass
class Store:
    """Folders of one deployment, below ``root``."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def measured(snaps: DataFrame, watch: DataFrame, fiscal_end: DataFrame, now: Column, backfill: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``snaps`` say by themselves: a row for each snapshot with its flags and time check, the typed rows, and the entities."""
    raw = quality.normalized_snapshot(readers.flat_snapshot(snaps), fiscal_end)
    prices = readers.snapshot_entities(snaps)
    gate = quality.entity_gate(raw, prices)
    known = watch.select("entity").distinct().withColumn("known", F.lit(True))
    per = gate.join(known, "entity", "left").groupBy("snapshot_id").agg(
        F.count("*").alias("n_received"), F.bool_or("zero_coverage").alias("zero_coverage"), F.bool_or("rejected").alias("rejected"), F.count("known").alias("n_known")
    )
    flags = snaps.select("snapshot_id", F.col("collectedAt").alias("collected_at"), F.col("sourceDataAsOf").alias("source_as_of"), "snapshot_utc").join(per, "snapshot_id", "left")
    flags = flags.withColumn("n_expected", known.agg(F.count("*")).scalar()).fillna(0, ["n_received", "n_known"]).fillna(False, ["zero_coverage", "rejected"])
    flags = quality.timestamp_gate(flags.withColumn("n_missing", F.col("n_expected") - F.col("n_known")), now, backfill)
    priced = prices.groupBy("snapshot_id", "entity").agg(F.max(to_num(F.col("price"))).alias("price"))
    value = to_num(F.col("value"))
    rows = raw.join(priced, ["snapshot_id", "entity"], "left").select("snapshot_id", "entity", "period", value.alias("value"), to_num(F.col("coverage")).alias("coverage"), "price", (~F.col("failed")).alias("valid"))
    return flags, rows, gate


def known_good(spark: SparkSession, store: Store, before: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """The current value and price of every (entity, period), as the last publishable snapshot (named before ``before``, if given) left them, with the
    ``snapshot_id`` that they are from, and the names of the states that are kept."""
    path = store.path("known_good")
    if not writers.exists(spark, path):
        return None, []
    states = spark.read.parquet(path)
    names = sorted(str(r["state"]) for r in states.select("state").distinct().collect())  # the partitions that are kept: two or three
    usable = [n for n in names if before is None or n < before]
    if not usable:
        return None, names
    return states.where(F.col("state") == usable[-1]).select("entity", "period", "value", "price", "snapshot_id"), names


def ingest_batch(snaps: DataFrame, store: Store, watch: DataFrame, fiscal_end: DataFrame, now: Column, backfill: bool = False) -> None:
    """One batch of snapshots, as if taken in the order of their names. Rejected ones go to quarantine; publishable ones give revision events against the last
    known good value and observations. A failure raises, so the stream's checkpoint does not advance. All snapshots are decided and written together
    (:mod:`tidemark.operators.gate_chain`); only snapshots that are older than a state that is kept are a part of their own."""
    snaps = snaps.cache()
    try:
        names = sorted(r["snapshot_id"] for r in snaps.select("snapshot_id").distinct().collect())  # files of one batch
        _, states = known_good(snaps.sparkSession, store)
        for _, part in groupby(names, key=lambda n: max((s for s in states if s < n), default="")):
            part = list(part)
            _ingest(snaps.where(F.col("snapshot_id").between(part[0], part[-1])), part[0], store, watch, fiscal_end, now, backfill)
    finally:
        snaps.unpersist()


def _ingest(snaps: DataFrame, first: str, store: Store, watch: DataFrame, fiscal_end: DataFrame, now: Column, backfill: bool) -> None:
    spark = snaps.sparkSession
    work = store.path(f"_work/{first}")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    good, states = known_good(spark, store, before=first)
    flags, rows, entities = measured(snaps, watch, fiscal_end, now, backfill)
    series = kept(gate_chain.by_identity(rows, good), "series")
    decisions = gate_chain.decided(kept(flags, "flags"), series, kept(gate_chain.by_entity(entities, series), "entities"), work)
    rejected = decisions.where("not publishable").select("snapshot_id", F.col("status").alias("gate_status"), F.col("reason").alias("gate_reason"))
    writers.quarantine(snaps.drop(readers.CORRUPT).join(rejected, "snapshot_id"), store.path("quarantine"))
    left = kept(gate_chain.left_behind(series, decisions), "left")
    fresh = left.where(F.col("snapshot_id") != gate_chain.BEFORE)
    newest = fresh.agg(F.max("snapshot_id")).first()[0]
    if newest is not None:
        writers.append_events(gate_chain.revisions(left), store.path("events"))
        day = F.to_date(F.substring("stamp", 1, 10))
        writers.write_months(fresh.select("entity", "period", day.alias("obs_date"), F.col("stamp").alias("update_time"), "value", "coverage"), store.path("history"))
        # the known good comes last: a batch that failed before it is done again from the same state. One row for each identity is
        # written beside the state before, which stays for a replay; older states go
        path = store.path("known_good")
        writers.assert_finite(gate_chain.state(left)).write.mode("overwrite").parquet(f"{path}/state={newest}")
        for old in [n for n in states if n < first][:-1]:
            writers.remove(spark, f"{path}/state={old}")
    writers.remove(spark, work)


def start(spark: SparkSession, incoming: str, store: Store, watch: DataFrame, fiscal_end: DataFrame, now: Column, backfill: bool = False) -> StreamingQuery:
    """Take the snapshot files of ``incoming`` as they come, until all that are there are done."""
    stream = spark.readStream.option("multiLine", True).schema(schemas.SNAPSHOT).json(incoming)
    named = stream.select(F.col("_metadata.file_name").alias("snapshot_id"), "*")
    writer = named.writeStream.foreachBatch(lambda df, _: ingest_batch(df, store, watch, fiscal_end, now, backfill))
    return writer.option("checkpointLocation", store.path("_checkpoint")).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, delay: str = "14 days") -> DataFrame:
    """A stream without repeated ``event_id``; the watermark on ``event_at`` bounds the state."""
    return events.withWatermark("event_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def cutoff_verdict(now: Column, as_of: Column | None = None, backfill: bool = False) -> Column:
    """Why a row with ``known_at`` may not be seen: more than ten minutes ahead of ``now``, later than ``as_of``, more than fourteen days old and not
    backfilled, or without a time. Null for a row that may be seen."""
    known = F.col("known_at")
    verdict = F.when(known.isNull(), "no_time").when(known > now + F.expr("INTERVAL 10 MINUTES"), "future")
    if as_of is not None:
        verdict = verdict.when(known > as_of, "after_as_of")
    return verdict if backfill else verdict.when(known < now - F.expr("INTERVAL 14 DAYS"), "too_old")


def within_cutoff(rows: DataFrame, now: Column, as_of: Column | None = None, backfill: bool = False) -> DataFrame:
    """Rows that may be seen. :func:`route` keeps the others too."""
    return rows.where(cutoff_verdict(now, as_of, backfill).isNull())


def route(rows: DataFrame, now: Column, path: str, as_of: Column | None = None, backfill: bool = False) -> StreamingQuery:
    """Start a stream that writes the rows that may be seen below ``path/seen`` and the others, with their ``verdict``, below ``path/late``. Each batch has its own folder in
    both, so that a batch that is done again replaces what it wrote."""
    verdict = cutoff_verdict(now, as_of, backfill)

    def split(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("verdict", verdict)
        judged.where("verdict IS NULL").drop("verdict").write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        judged.where("verdict IS NOT NULL").write.mode("overwrite").parquet(f"{path}/late/batch={number}")

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()


def routed(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The two tables of :func:`route`: rows of ``schema``, and late ones with their ``verdict``."""
    late = StructType([*schema.fields, StructField("verdict", StringType())])
    tables = []
    for name, kind in (("seen", schema), ("late", late)):
        there = writers.exists(spark, f"{path}/{name}")
        tables.append(spark.read.schema(kind).parquet(f"{path}/{name}").select(*kind.names) if there else spark.createDataFrame([], kind))
    return tables[0], tables[1]


def read_checkpoint(spark: SparkSession, path: str) -> Column:
    """The last collection that succeeded, NULL before the first."""
    if not writers.exists(spark, path):
        return F.lit(None).cast("timestamp")
    return F.lit(spark.read.parquet(path).agg(F.max("at")).first()[0]).cast("timestamp")


def advance_checkpoint(spark: SparkSession, path: str, at: str) -> None:
    """To be called after everything else of a run succeeded."""
    spark.createDataFrame([(at,)], "at string").select(F.col("at").cast("timestamp").alias("at")).write.mode("append").parquet(path)


def freshness(watch: DataFrame, successes: DataFrame, now: Column) -> DataFrame:
    """Per watched entity its last success and whether it is stale."""
    last = successes.groupBy("entity").agg(F.max("at").alias("last_success"))
    return watch.select("entity").join(last, "entity", "left").withColumn("stale", is_stale(F.col("last_success"), now))
