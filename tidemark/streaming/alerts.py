"""Threshold alerts as a stream, with the same lifecycle as the batch operator.

:func:`alert_stream` and :func:`one_shot_lifecycle` are streaming tables with keyed state, for any sink; they call Python once a key and batch, which takes
milliseconds. :func:`alert_log` and :func:`one_shot_log` are sinks for many keys: the state is a table, and each batch is worked on as a whole by windows and
aggregates. Both give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.dates import ONE_SHOT_DAYS
from tidemark.operators.alerts import MATERIAL, OPEN_AT, RESOLVE_BELOW, hysteresis
from tidemark.sources.writers import exists, remove

EVENTS = "entity string, period string, as_of timestamp, pct double, event string, episode long"
STATES = "id string, state string, at timestamp"
STATE = "is_open boolean, has_stored boolean, stored double, episode long, seen timestamp"
LIFE = pd.Timedelta(days=ONE_SHOT_DAYS)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, off the heap, which the processors here need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def step(state: tuple, pct: float, refresh_in_band: bool) -> tuple[tuple, str | None]:
    """State (open, stored percentage or None, episode) and event after one valid window."""
    is_open, stored, episode = state
    size, event = abs(pct), None
    if not is_open:
        if size >= OPEN_AT:
            is_open, event, episode = True, "Open", episode + 1
    elif size < RESOLVE_BELOW:
        is_open, event = False, "Resolved"
    elif size < OPEN_AT:
        event = "Hold" if refresh_in_band else None
    else:
        moved = stored is not None and abs(pct - stored) >= MATERIAL
        if refresh_in_band:
            moved = moved or (stored is not None and (pct > 0) - (pct < 0) != (stored > 0) - (stored < 0))
        event = "Updated" if moved else "Hold"
    if refresh_in_band or size >= OPEN_AT:
        stored = pct
    return (is_open, stored, episode), event


class Lifecycle(StatefulProcessor):
    """The state machine of a series: five values in a value state."""

    def __init__(self, refresh_in_band: bool):
        self.refresh_in_band = refresh_in_band

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lifecycle", STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        self.state.update((True, True, float(initialState["pct"].iloc[0]), 1, None))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        is_open, has, stored, episode, seen = self.state.get() if self.state.exists() else (False, False, 0.0, 0, None)
        pieces = [(f["as_of"].to_numpy("datetime64[us]"), f["pct"].to_numpy("float64")) for f in rows]
        times, values = (np.concatenate(x) for x in zip(*pieces, strict=True))
        late = None if seen is None else pd.Timestamp(seen)
        now, out = (is_open, stored if has else None, episode), []
        for k in np.lexsort((values, times)).tolist():
            as_of, pct = pd.Timestamp(times[k]), float(values[k])
            if np.isnan(pct) or pd.isna(as_of) or (late is not None and as_of <= late):
                continue
            now, event = step(now, pct, self.refresh_in_band)
            seen = as_of
            if event:
                out.append((*key, as_of, pct, event, now[2]))
        self.state.update((now[0], now[1] is not None, now[1] if now[1] is not None else 0.0, now[2], seen.to_pydatetime() if isinstance(seen, pd.Timestamp) else seen))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])


def alert_stream(series: DataFrame, refresh_in_band: bool = True, open_alerts: DataFrame | None = None) -> DataFrame:
    """Lifecycle events of ``series`` (``entity, period, as_of, pct``), keyed by series. Rows of a batch are taken in the order of ``as_of``, equal times
    in that of their percentages as in batch; one at or before the last that its series had seen before the batch is late and is
    ignored. Unavailable windows (NULL) change nothing. The keyed state is five values a series; of a batch's rows of a series two numbers
    each are held. ``open_alerts`` (``entity, period, pct``, one row a series, not a stream) is what a new stream begins with, as in batch. To be started
    under :func:`rocksdb`."""
    initial = None
    if open_alerts is not None:
        initial = open_alerts.select("entity", "period", F.col("pct").cast("double").alias("pct")).groupBy("entity", "period")
    rows = series.select("entity", "period", F.col("as_of").cast("timestamp").alias("as_of"), F.col("pct").cast("double").alias("pct"))
    return rows.groupBy("entity", "period").transformWithStateInPandas(Lifecycle(refresh_in_band), EVENTS, "append", "none", initial)


def _logged(stream: DataFrame, path: str, step: Callable[[DataFrame, str | None, str, str], None]) -> StreamingQuery:
    """Run ``step(batch, state before it or None, where its rows go, where the state after it goes)`` for every batch that is there. A batch that is repeated after
    a failure finds the same state and replaces what it wrote; the states of the last two batches are kept."""

    def each(batch: DataFrame, number: int) -> None:
        state = lambda n: f"{path}/state/{n}"
        step(batch, state(number - 1) if number else None, f"{path}/rows/batch={number}", state(number))
        remove(batch.sparkSession, state(number - 2))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def logged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log at ``path``: ``schema`` is :data:`EVENTS` or :data:`STATES`."""
    there = exists(spark, f"{path}/rows")  # a stream without any rows has no batch
    return spark.read.schema(schema).parquet(f"{path}/rows/batch=*") if there else spark.createDataFrame([], schema)


def alert_log(series: DataFrame, path: str, refresh_in_band: bool = True, open_alerts: DataFrame | None = None) -> StreamingQuery:
    """:func:`alert_stream` into files at ``path``, to be read by :func:`logged`: the batch operator goes over every batch from the state of the series before it. That
    state is a table of one row a series (open or not, stored percentage, episodes, last time seen), written anew after each batch."""
    keys = ("entity", "period")

    def step(batch: DataFrame, before: str | None, to: str, after: str) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, F.col("as_of").cast("timestamp").alias("as_of"), F.col("pct").cast("double").alias("pct"))
        rows = rows.where("pct is not null and not isnan(pct) and as_of is not null")
        known = None
        if before:
            known = spark.read.parquet(before)
            seen = known.where("seen is not null").select(*[F.col(k).alias(f"known_{k}") for k in keys], "seen")
            same = [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys]
            rows = rows.join(seen, [*same, F.col("as_of") <= F.col("seen")], "left_anti")
        elif open_alerts is not None:
            known = open_alerts.select(*keys, F.lit(True).alias("is_open"), F.col("pct").cast("double").alias("pct"), F.lit(1).cast("long").alias("episode"), F.lit(None).cast("timestamp").alias("seen"))
        hysteresis(rows, keys, refresh_in_band=refresh_in_band, open_alerts=known).write.mode("overwrite").parquet(to)
        # an alert that is open stores the percentage of its last event, and what a closed one stores is never asked for
        last = F.struct((F.col("event") != "Resolved").alias("is_open"), "pct", "episode")
        told = spark.read.schema(EVENTS).parquet(to).select(*keys, last.alias("last"), F.struct("as_of", "pct").alias("at"), "as_of")
        empty = lambda c: F.lit(None).cast(told.schema[c].dataType).alias(c)
        now = told.unionByName(rows.select(*keys, empty("last"), empty("at"), "as_of"))
        if known is not None:
            first = F.struct(F.lit(None).cast("timestamp").alias("as_of"), F.lit(None).cast("double").alias("pct"))
            now = now.unionByName(known.select(*keys, F.struct("is_open", "pct", "episode").alias("last"), first.alias("at"), F.col("seen").alias("as_of")))
        now = now.groupBy(*keys).agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("at"))).alias("last"), F.max("as_of").alias("seen"))
        none = {"is_open": F.lit(False), "pct": F.lit(None).cast("double"), "episode": F.lit(0).cast("long")}
        now.select(*keys, *[F.coalesce(f"last.{c}", x).alias(c) for c, x in none.items()], "seen").write.mode("overwrite").parquet(after)

    return _logged(series, path, step)


def newest_open(events: DataFrame) -> DataFrame:
    """``entity, period, pct`` of the series that the lifecycle ``events`` leave open: what :func:`alert_stream` and the batch operator go on from. Where
    holds in the band give no row they store nothing either, so that the last event has the stored percentage in both cases."""
    last = events.groupBy("entity", "period").agg(F.max_by(F.struct("event", "pct"), F.struct("as_of", "pct")).alias("last"))
    return last.where("last.event <> 'Resolved'").select("entity", "period", "last.pct")


class OneShot(StatefulProcessor):
    """An alert that lives for a fixed time: its end is a value state and an event-time timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until timestamp")

    def _ends(self) -> pd.Timestamp | None:
        return pd.Timestamp(self.until.get()[0]) if self.until.exists() else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        times = np.sort(np.concatenate([f["event_at"].to_numpy("datetime64[us]") for f in rows]))
        before = ends = self._ends()
        out = []
        for t in times[~np.isnat(times)]:
            if ends is not None and pd.Timestamp(t) < ends:
                continue  # told again while alive: its end stays
            if ends is not None:
                out.append((key[0], "expired", ends))
            ends = pd.Timestamp(t) + LIFE
            out.append((key[0], "active", pd.Timestamp(t)))
        if ends is not None and ends != before:
            if before is not None:
                self.handle.deleteTimer(_millis(before))
            self.until.update((ends.to_pydatetime(),))
            self.handle.registerTimer(max(_millis(ends), timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["id", "state", "at"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        ends = self._ends()
        self.until.clear()
        if ends is not None:
            yield pd.DataFrame({"id": [key[0]], "state": ["expired"], "at": [ends]})


def _millis(t: pd.Timestamp) -> int:
    return -(-int(t.value) // 1_000_000)


def one_shot_lifecycle(alerts: DataFrame, delay: str = "1 day") -> DataFrame:
    """``id, event_at`` alerts that live for 21 days of event time: ``id, state, at`` when one becomes active and when it has expired. An alert that is told
    again while it lives is not prolonged; after its end it begins anew. The state of an alert goes with its expiry. To be started under
    :func:`rocksdb`."""
    rows = alerts.select("id", "event_at").withWatermark("event_at", delay)
    return rows.groupBy("id").transformWithStateInPandas(OneShot(), STATES, "append", "eventtime")


def one_shot_log(alerts: DataFrame, path: str, delay: str = "1 day") -> StreamingQuery:
    """:func:`one_shot_lifecycle` into files at ``path``, to be read by :func:`logged`. The state is a table of the alerts that are alive with their ends, beside it the newest
    time of the stream; an alert has expired once that time less ``delay`` reaches its end, and rows at or before it are late. A batch's times of
    an alert are one array."""
    life, late = F.expr(f"INTERVAL {ONE_SHOT_DAYS} DAYS"), F.expr(f"INTERVAL {delay}")

    def step(batch: DataFrame, before: str | None, to: str, after: str) -> None:
        spark = batch.sparkSession
        rows = batch.select("id", F.col("event_at").cast("timestamp").alias("event_at")).where("event_at is not null")
        told = rows.select(F.col("event_at").alias("newest"))
        alive = None
        if before:
            alive, told = spark.read.parquet(f"{before}/alive"), told.unionByName(spark.read.parquet(f"{before}/newest"))
        told.agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{after}/newest")
        mark = lambda folder: F.broadcast(spark.read.parquet(f"{folder}/newest").select((F.col("newest") - late).alias("mark")))
        rows = rows.select("id", "event_at", F.lit(None).cast("timestamp").alias("ends"))
        if before:
            rows = rows.crossJoin(mark(before)).where("mark is null or event_at > mark").drop("mark")
            rows = rows.unionByName(alive.select("id", F.lit(None).cast("timestamp").alias("event_at"), "ends"))
        # told again while alive changes nothing; at or after its end it begins anew
        times = rows.groupBy("id").agg(F.max("ends").alias("first"), F.array_sort(F.collect_list("event_at")).alias("times"))
        none = F.array().cast("array<timestamp>")
        begun = lambda made, t: F.when(made["ends"].isNull() | (t >= made["ends"]), F.struct((t + life).alias("ends"), F.concat(made["starts"], F.array(t)).alias("starts"))).otherwise(made)
        times = times.select("id", F.array_compact(F.array("first")).alias("first"), F.aggregate("times", F.struct(F.col("first").alias("ends"), none.alias("starts")), begun).alias("made"))
        ends = F.concat("first", F.transform("made.starts", lambda t: t + life))
        times = times.select("id", F.col("made.starts").alias("starts"), ends.alias("ends"), F.col("made.ends").alias("last")).crossJoin(mark(after))
        over = F.filter("ends", lambda t: (t < F.col("last")) | (t <= F.col("mark")))
        states = lambda name, at: F.transform(at, lambda t: F.struct(F.lit(name).alias("state"), t.alias("at")))
        found = times.select("id", F.concat(states("active", F.col("starts")), states("expired", over)).alias("x"), F.when(F.col("last") > F.col("mark"), F.col("last")).alias("ends"))
        found.where("ends is not null").select("id", "ends").write.mode("overwrite").parquet(f"{after}/alive")
        found.select("id", F.explode("x").alias("x")).select("id", "x.state", "x.at").write.mode("overwrite").parquet(to)

    return _logged(alerts, path, step)
