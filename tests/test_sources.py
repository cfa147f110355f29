"""Readers, sinks and streams over small files."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, digests, gate_chain, history
from tidemark.plans import stream_queries
from tidemark.sources import readers, schemas, writers
from tidemark.streaming import alerts as stream_alerts
from tidemark.streaming import ingest

GOOD = {"date": "2026-09-15", "ticker": "avgo", "reportedFiscalPeriodEnding": "Oct 2029", "consensus": 40.66, "analysts": None, "updateTime": "2026-09-15T01:36:00Z"}


def put(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")
    return str(path)


def test_history_strict_and_lenient(spark, tmp_path):
    path = put(tmp_path / "2026-09.jsonl", GOOD, "{broken", {**GOOD, "date": "2026-09-16"}, {**GOOD, "consensus": "n/a"})
    assert readers.canonical_history(spark, path, strict=False).count() == 2
    with pytest.raises(Exception, match="inadmissible row"):
        readers.canonical_history(spark, path).collect()
    fine = put(tmp_path / "fine.jsonl", GOOD)
    assert readers.canonical_history(spark, fine).first()["entity"] == "AVGO"


def test_rejected_lines_keep_number_and_text(spark, tmp_path):
    good, bad = readers.split_lines(readers.json_lines(spark, put(tmp_path / "x.jsonl", GOOD, "", "[1]", "{oops"), schemas.RAW_OBSERVATION))
    assert good.count() == 1
    assert sorted((r["line_no"], r["raw"], r["reason"]) for r in bad.collect()) == [(3, "[1]", "malformed_jsonl"), (4, "{oops", "malformed_jsonl")]


def test_staged_batch_contract(spark, tmp_path):
    assert readers.staged_batch(spark, put(tmp_path / "a.json", [GOOD])).count() == 1
    assert readers.staged_batch(spark, put(tmp_path / "b.json", {"rows": [GOOD, GOOD]})).count() == 2
    assert readers.staged_batch(spark, str(tmp_path / "missing.json")).count() == 0
    for bad in ("3", '{"other": 1}', "[1]", "{nope"):
        with pytest.raises(ValueError, match="staged batch"):
            readers.staged_batch(spark, put(tmp_path / "c.json", bad))


def test_nested_series_needs_the_update_time_key(spark, tmp_path):
    nested = {"X": {"2027E": [{"date": "2026-09-01", "eps": 1.0, "reportedFiscalLabel": "Jan 2027"}, {"date": "2026-09-02", "eps": 2.0, "reportedFiscalLabel": "Jan 2027", "updateTime": None}]}}
    rows = readers.nested_series(spark, put(tmp_path / "s.json", nested)).orderBy("date").collect()
    assert [r["provable"] for r in rows] == [False, True]


def test_universe_and_drivers(spark, tmp_path):
    watch, months, domains = readers.universe(spark, put(tmp_path / "u.json", {"tickers": ["a", "B"], "fiscalEndMonthByTicker": {"a": 6}, "officialDomainsByTicker": {"a": ["x.example"]}}))
    assert {r["entity"] for r in watch.collect()} == {"A", "B"}
    assert months.first()["fiscal_end_month"] == 6 and domains.first()["domain"] == "x.example"
    folder = tmp_path / "drivers"
    folder.mkdir()
    put(folder / "A.json", {"ticker": "A", "updated": "2026-09-01", "drivers": [{"name": "demand", "currentStatus": "Improving", "previousStatus": "stable", "reason": "orders"}]})
    put(folder / "B.json", "{broken")
    rows, errors = readers.drivers(spark, str(folder))
    got = alerts.driver_transitions(rows).first()
    assert (got["id"], got["severity"], got["event_date"]) == ("driver_status_change:A:na:2026-09-01:demand", "medium", "2026-09-01")
    assert errors.first()["file"] == "B.json"


def test_corrupt_digest_keeps_the_last_good_copy(spark, tmp_path):
    folder = tmp_path / "digests"
    folder.mkdir()
    put(folder / "A.json", {"ticker": "A", "guidance": "up", "results": [], "revenue": [{"label": "q"}]})
    first = readers.digests(spark, str(folder)).toPandas()
    previous = spark.createDataFrame(first.to_dict("records"), readers.digests(spark, str(folder)).schema)
    put(folder / "A.json", "{broken")
    again = readers.digests(spark, str(folder), previous).first()
    assert again["is_corrupt"] and again["guidance"] == "up"
    assert digests.has_content(previous, ("revenue",), ("guidance",)).first()["has_content"]


def test_estimates_page(spark):
    table = '<tr data-period="Jan 2027"><td class="fiscal-period-ending">Jan 2027</td><td class="consensus">9.31</td><td class="high">10.50</td><td class="low">8.20</td><td class="analyst-count">42</td><td class="rev-1m">1.25%</td></tr>'
    block = '<script type="application/json" id="sa-estimates-json">{"rows": [{"fiscalPeriodEnding": "Jan 2028", "consensus": 15.61, "analystCount": 38}]}</script>'
    pages = spark.createDataFrame([(1, table), (2, table + block), (3, "<p>nothing</p>"), (4, None)], "id long, html string")
    got = {r["id"]: (r["fiscal_period"], r["consensus"], r["analystCount"]) for r in digests.extracted_estimates(pages).collect()}
    assert got == {1: ("Jan 2027", "9.31", "42"), 2: ("Jan 2028", "15.61", "38")}


def test_month_writes_touch_only_months_that_gain_rows(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([("X", "Jan 2027", d, "t", float(x), 1.0) for d, x in v], "entity string, period string, obs_date string, update_time string, value double, coverage double").withColumn("obs_date", F.to_date("obs_date"))
    path = str(tmp_path / "history")
    assert writers.write_months(rows(("2026-08-01", 1), ("2026-09-01", 2)), path) == ["2026-08", "2026-09"]
    assert writers.write_months(rows(("2026-09-01", 2)), path) == []
    assert writers.write_months(rows(("2026-09-01", 2), ("2026-09-02", 3)), path) == ["2026-09"]
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(history.ConflictError):
        writers.write_months(rows(("2026-09-01", 7)), path)
    with pytest.raises(writers.NotFiniteError):
        writers.write_months(rows(("2026-10-01", float("inf"))), path)


def test_a_large_month_is_several_files(spark, tmp_path, monkeypatch):
    rows = spark.range(20_000).select(F.lit("X").alias("entity"), F.concat(F.lit("P"), "id").alias("period"), F.to_date(F.lit("2026-08-01")).alias("obs_date"), F.lit("t").alias("update_time"), F.col("id").cast("double").alias("value"), F.lit(1.0).alias("coverage"))
    path = str(tmp_path / "history")
    monkeypatch.setattr(writers, "FILE_ROWS", 3000)
    assert writers.write_months(rows.unionByName(rows.limit(3).withColumn("obs_date", F.to_date(F.lit("2026-09-01")))), path) == ["2026-08", "2026-09"]
    assert len(list((tmp_path / "history_staged").glob("part-*"))) > 2 and spark.read.parquet(path).count() == 20_003
    assert writers.write_months(rows, path) == []


def test_events_are_kept_by_day(spark, tmp_path):
    events = spark.createDataFrame([("a", "2026-09-01T01:00:00Z"), ("b", "2026-09-02T01:00:00Z"), ("c", None), ("d", "soon")], "event_id string, update_time string")
    path = tmp_path / "log"
    assert writers.append_events(events, str(path)) == 4 and writers.append_events(events, str(path)) == 0
    assert {p.name for p in path.glob("day=*")} == {"day=2026-09-01", "day=2026-09-02", "day=none"}
    for p in path.glob("day=2026-09-01/*"):
        p.write_bytes(b"not read by a batch of other days")
    assert writers.append_events(events.where("event_id <> 'a'"), str(path)) == 0


def test_a_runtime_table_is_swapped(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([("X", "P", "t", v)], "entity string, period string, update_time string, value double").withColumn("obs_date", F.to_date(F.lit("2026-09-01")))
    path = str(tmp_path / "table")
    for v in (1.0, 2.0):
        writers.materialize(rows(v), path)
        assert spark.read.parquet(path).first()["value"] == v
    with pytest.raises(Exception, match="broken"):
        writers.materialize(rows(3.0).withColumn("value", F.raise_error(F.lit("broken")).cast("double")), path)
    assert spark.read.parquet(path).first()["value"] == 2.0
    writers.moved(spark, path, f"{path}_previous")  # as a run leaves it that fails between the renames
    with pytest.raises(Exception, match="broken"):
        writers.materialize(rows(3.0).withColumn("entity", F.raise_error(F.lit("broken")).cast("string")), path)
    assert spark.read.parquet(path).first()["value"] == 2.0
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith("_next")) == ["table"]


def test_volatile_fields_go_at_any_depth(spark):
    rows = spark.sql("""SELECT 1 AS a, named_struct('run_id', 'r', 'b', 2) AS s, array(array(named_struct('c', 3, 'build_id', 'x'))) AS aa, map('k', named_struct('d', 4, 'run_id', 'r')) AS m,
      map('run_id', 'r', 'e', 'f') AS keys, map(1, array(map('build_id', 5, 'g', 6))) AS deep, named_struct('run_id', 'r') AS only, array(named_struct('h', named_struct('run_id', 'r'), 'i', 7)) AS inner, 'z' AS run_id""")
    got = writers.stripped(rows).first().asDict(recursive=True)
    assert got == {"a": 1, "s": {"b": 2}, "aa": [[{"c": 3}]], "m": {"k": {"d": 4}}, "keys": {"e": "f"}, "deep": {1: [{"g": 6}]}, "inner": [{"i": 7}]}
    none = writers.stripped(rows.where("false").unionByName(rows.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))).first()
    assert all(v is None for v in none)


def test_event_append_and_quarantine_are_idempotent(spark, tmp_path):
    events = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "event_id string, value double")
    assert writers.append_events(events, str(tmp_path / "e")) == 2
    assert writers.append_events(events, str(tmp_path / "e")) == 0
    bad = lambda run, v: spark.createDataFrame([("s", run, v)], "snapshot_id string, run_id string, price string")
    assert [writers.quarantine(bad(*x), str(tmp_path / "q")) for x in (("r1", "1"), ("r2", "1"), ("r3", "2"))] == [1, 0, 1]


def snapshot(value, stamp, price=100.0, **more):
    eps = {"2026E": {"consensus": value, "high": value + 1, "low": value - 1, "analysts": 8, "reported_fiscal_label": "Jan 2027"}, "2027E": {"consensus": 6.0, "high": 7, "low": 5, "analysts": 8, "reported_fiscal_label": "Jan 2028"}}
    return {"snapshot_utc": stamp, "tickers": {"AAA": {"price": price, "eps": eps, **more}}}


def test_snapshot_stream(spark, tmp_path):
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    store = ingest.Store(str(tmp_path / "store"))
    watch = spark.createDataFrame([("AAA",)], "entity string")
    ends = spark.createDataFrame([("AAA", 1)], "entity string, fiscal_end_month int")
    now = F.lit("2026-09-20T00:00:00Z").cast("timestamp")
    run = lambda: ingest.start(spark, str(incoming), store, watch, ends, now).awaitTermination()
    put(incoming / "2026-09-15.json", snapshot(5.0, "2026-09-15T01:00:00Z"))
    run()
    put(incoming / "2026-09-16.json", snapshot(5.5, "2026-09-16T01:00:00Z"))
    put(incoming / "2026-09-17.json", snapshot(50.0, "2026-09-17T01:00:00Z"))
    put(incoming / "2026-09-18.json", snapshot(5.5, "2026-10-18T01:00:00Z"))
    run()
    run()
    events = sorted((r["kind"], r["period"], r["value"]) for r in spark.read.parquet(store.path("events")).collect())
    assert events == [("baseline", "Jan 2027", 5.0), ("baseline", "Jan 2028", 6.0), ("upgrade", "Jan 2027", 5.5)]
    assert spark.read.parquet(store.path("history")).count() == 4
    reasons = {r["snapshot_id"]: r["gate_reason"] for r in spark.read.parquet(store.path("quarantine")).collect()}
    assert reasons == {"2026-09-17.json": "extreme_eps_change", "2026-09-18.json": "future_snapshot_timestamp"}
    # a replayed batch changes nothing
    again = readers.snapshots(spark, str(incoming)).where("snapshot_id = '2026-09-16.json'").drop(readers.CORRUPT)
    ingest.ingest_batch(again, store, watch, ends, now)
    assert spark.read.parquet(store.path("events")).count() == 3 and spark.read.parquet(store.path("history")).count() == 4


@pytest.mark.parametrize("refresh", [True, False])
def test_stream_alerts_equal_batch(spark, tmp_path, refresh):
    rng = random.Random(4)
    rows = [(e, "P", dt.datetime(2026, 1, 1) + dt.timedelta(days=i), rng.choice([None, rng.uniform(-8, 8), rng.uniform(3, 6)])) for e in "ABCDE" for i in range(40)]
    schema = "entity string, period string, as_of timestamp, pct double"
    df = spark.createDataFrame(rows, schema)
    for k, (a, b) in enumerate(((0, 15), (15, 30), (30, 40))):
        edge = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(days=i)
        df.where((F.col("as_of") >= edge(a)) & (F.col("as_of") < edge(b))).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    out = str(tmp_path / "out")
    for k in range(3):  # batch after batch through one checkpoint
        for f in (tmp_path / f"in{k}").glob("part-*"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with stream_alerts.rocksdb(spark):
            q = stream_alerts.alert_stream(stream, refresh).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()), key=repr)
    assert got == sorted(map(tuple, alerts.hysteresis(df, refresh_in_band=refresh).collect()), key=repr)


def test_one_shot_alerts_expire_in_event_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    schema = "id string, event_at timestamp"
    for k, rows in enumerate(([("a", day(0)), ("d", day(0))], [("d", day(20))], [("b", day(40)), ("d", day(22))], [("c", day(41))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"x{k}"))
        for f in (tmp_path / f"x{k}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with stream_alerts.rocksdb(spark):
            q = stream_alerts.one_shot_lifecycle(stream).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    states = sorted((r["id"], (r["at"] - day(0)).days, r["state"]) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    # d is told again on the 20th, which prolongs nothing, and on the 22nd, after its end
    assert states == [("a", 0, "active"), ("a", 21, "expired"), ("b", 40, "active"), ("c", 41, "active"), ("d", 0, "active"), ("d", 21, "expired"), ("d", 22, "active")]


def test_a_merge_groups_identities_once(spark, tmp_path, monkeypatch):
    """Conflicts, months, counts and rows of a merge were each grouped and joined from its inputs again."""
    for f in ("conflicts_between", "new_observations"):
        monkeypatch.setattr(history, f, lambda *_: pytest.fail("grouped again"))
    row = lambda e, d, v: (e, "P", dt.date(2026, *d), "t", v, 3.0)
    table = lambda *rows: spark.createDataFrame(rows, "entity string, period string, obs_date date, update_time string, value double, coverage double")
    path = str(tmp_path / "h")
    assert writers.write_months(table(row("A", (1, 2), 1.0), row("A", (1, 2), 1.0), row("B", (2, 3), None)), path) == ["2026-01", "2026-02"]
    assert writers.write_months(table(row("B", (2, 3), None), row("B", (2, 4), 5.0), row("A", (1, 2), 1.0)), path) == ["2026-02"]
    for bad in (table(row("A", (1, 2), None)), table(row("C", (3, 1), 1.0), row("C", (3, 1), 2.0))):
        with pytest.raises(history.ConflictError, match="identity with several payloads"):
            writers.write_months(bad, path)
    assert sorted((r["entity"], str(r["obs_date"]), r["value"]) for r in spark.read.parquet(path).collect()) == [("A", "2026-01-02", 1.0), ("B", "2026-02-03", None), ("B", "2026-02-04", 5.0)]


def _batches(spark, folder, rows, schema):
    """Stream after stream over one more file each, as runs of a job are."""
    (folder / "in").mkdir(exist_ok=True)
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(folder / f"new{k}"))
        for f in (folder / f"new{k}").glob("part-*"):
            f.rename(folder / "in" / f"{k}-{f.name}")
        yield spark.readStream.schema(schema).parquet(str(folder / "in"))


@pytest.mark.parametrize("refresh", [True, False])
def test_alert_log_equals_batch_without_python(spark, tmp_path, refresh):
    """Over several batches and with alerts that are open before; late rows are ignored, and no key has a Python call of its own."""
    rng = random.Random(8)
    day = lambda i: dt.datetime(2026, 1, 20) + dt.timedelta(days=i)
    value = lambda: rng.choice([None, float("nan"), rng.uniform(-8, 8), rng.uniform(3, 6), 6.0])
    schema = "entity string, period string, as_of timestamp, pct double"
    rows = [(e, "P", day(i), value()) for e in "ABCDEFG" for i in range(40)] + [("A", "P", day(3), 5.5), ("A", "P", None, 9.0), ("H", "P", day(38), 7.0)]
    valid = [r for r in rows if r[3] is not None and r[3] == r[3] and r[2] is not None]
    known = spark.createDataFrame([("A", "P", 5.2), ("B", "P", -7.0), ("Z", "P", 6.0)], "entity string, period string, pct double")
    want = sorted(map(tuple, alerts.hysteresis(spark.createDataFrame(valid, schema), refresh_in_band=refresh, open_alerts=known).collect()), key=repr)
    seen = max(r[2] for r in valid if r[0] == "C" and r[2] < day(15))
    late = [("C", "P", seen, 30.0), ("C", "P", day(-9), 30.0)]
    cut = [[r for r in rows if r[2] is None or r[2] < day(15)], [*late, *(r for r in rows if r[2] and day(15) <= r[2] < day(16))], [r for r in rows if r[2] and r[2] >= day(16)]]
    assert len(want) > 60 and {r[4] for r in want} == {"Open", "Hold", "Updated", "Resolved"}
    path = str(tmp_path / "log")
    for stream in _batches(spark, tmp_path, cut, schema):
        q = stream_alerts.alert_log(stream, path, refresh, known)
        q.awaitTermination()
        assert "TransformWithState" not in q.lastProgress["sink"]["description"] and not q.lastProgress["stateOperators"]
    assert sorted(map(tuple, stream_alerts.logged(spark, path, stream_alerts.EVENTS).collect()), key=repr) == want
    assert sorted(p.name for p in (tmp_path / "log" / "state").iterdir()) == ["1", "2"]
    assert not stream_alerts.logged(spark, str(tmp_path / "none"), stream_alerts.EVENTS).collect()


def test_one_shot_log_equals_one_shot_lifecycle(spark, tmp_path):
    """Batch after batch, with chains of activations inside a batch, late rows and rows without a time."""
    rng = random.Random(3)
    at = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    schema = "id string, event_at timestamp"
    spans = ((0, 30), (30, 31), (25, 140), (60, 141), (139, 200))  # some rows are older than the stream has got to
    rows = [[(rng.choice("abcdefgh"), at(rng.uniform(*span))) for _ in range(n)] for span, n in zip(spans, (30, 10, 60, 40, 12), strict=True)]
    rows[0] += [("a", at(0)), ("a", at(21)), ("x", at(2)), ("n", None)]
    out, path = str(tmp_path / "o"), str(tmp_path / "log")
    for stream in _batches(spark, tmp_path, rows, schema):
        with stream_alerts.rocksdb(spark):
            q = stream_alerts.one_shot_lifecycle(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        stream_alerts.one_shot_log(stream, path).awaitTermination()
    got = sorted(map(tuple, stream_alerts.logged(spark, path, stream_alerts.STATES).collect()))
    assert got == sorted(map(tuple, spark.read.parquet(out).collect()))
    assert len(got) > 60 and ("x", "expired", at(23)) in got


@pytest.mark.parametrize("name", ["stream_alerts", "one_shot_states", "resumed_alerts"])
def test_stream_queries_keep_no_python_state(spark, monkeypatch, name):
    """A Python call for each series and batch took over a minute on 22,500 series."""
    called = lambda *_: pytest.fail("a series by itself")
    for f in ("alert_stream", "one_shot_lifecycle"):
        monkeypatch.setattr(stream_alerts, f, called)
    assert stream_queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_checkpoint_cursor(spark, tmp_path):
    path = str(tmp_path / "cursor")
    assert spark.range(1).select(ingest.read_checkpoint(spark, path).alias("x")).first()["x"] is None
    ingest.advance_checkpoint(spark, path, "2026-09-01T00:00:00Z")
    ingest.advance_checkpoint(spark, path, "2026-09-03T00:00:00Z")
    assert spark.range(1).select(F.date_format(ingest.read_checkpoint(spark, path), "dd").alias("x")).first()["x"] == "03"


def test_gate_chain_needs_few_rounds(spark, tmp_path):
    """A level that moves and stays is refused to the end, by its own series in one round."""
    names = [f"s{k:02d}" for k in range(30)]
    rows = [(n, e, "P", 10.0 if k < 4 or e == "B" else 20.0 + k % 2, 3.0, 5.0, True) for k, n in enumerate(names) for e in "AB"]
    rows = spark.createDataFrame(rows, "snapshot_id string, entity string, period string, value double, coverage double, price double, valid boolean")
    flags = spark.createDataFrame([(n, 2, 0, None, False, False, "t", None) for n in names], "snapshot_id string, n_received int, n_missing int, ts_reason string, zero_coverage boolean, rejected boolean, collected_at string, snapshot_utc string")
    flags = flags.withColumn("ts_status", F.lit(None).cast("string"))
    series = gate_chain.by_identity(rows, None)
    entities = gate_chain.by_entity(rows.select("snapshot_id", "entity", "price", F.lit(1).cast("long").alias("n_usable")), series)
    out = gate_chain.decided(flags, series, entities, str(tmp_path))
    assert sorted(r["snapshot_id"] for r in out.where("publishable").collect()) == names[:4]
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("round=")]) <= 4
