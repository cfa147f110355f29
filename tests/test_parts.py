"""Parts without a registered query of their own: readers, sinks, small functions, and runs that go on from an earlier state."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, fiscal, ids, numbers, text
from tidemark.operators import alerts, datasets, history, windows
from tidemark.plans.stream_queries import _drained
from tidemark.sources import readers, writers
from tidemark.streaming import alerts as stream
from tidemark.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_event_log(spark, tmp_path):
    rows = [
        {"Date": "2026-09-01", "Ticker": "nvda", "Fiscal Year": "2027E", "Calendar Alignment": "2027E", "Previous EPS": "n/a", "Current EPS": "4.5", "Revision %": "n/a", "Reason": "baseline", "Update Time": "t1"},
        {"Date": "2026-09-02", "Ticker": "nvda", "Fiscal Year": "x", "Reported Fiscal Period Ending": "Jan 2027", "Previous EPS": "4.5", "Current EPS": "5.0", "Revision %": "+11.11%", "Update Time": "t2", "eventId": "e2"},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(rows[0]), "{broken", "", json.dumps(rows[1])]))
    got = readers.revision_events(spark, str(tmp_path / "log.jsonl")).orderBy("seq").collect()
    assert [(r["seq"], r["entity"], r["period"], r["previous_value"], r["current_value"], r["pct"], r["event_id"]) for r in got] == [
        (1, "NVDA", "2027E", None, 4.5, None, None),
        (4, "NVDA", "Jan 2027", 4.5, 5.0, 11.11, "e2"),
    ]
    assert [r["event_id"] for r in history.known_ids(readers.revision_events(spark, str(tmp_path / "log.jsonl"))).collect()] == ["e2"]


def test_line_numbers_over_blocks(spark, tmp_path):
    lines = [json.dumps({"ticker": f"T{k}", "date": "2026-09-01"}) + " " * (k % 7) for k in range(4000)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found = readers.json_lines(spark, str(tmp_path), readers.schemas.RAW_OBSERVATION)
        assert found.rdd.getNumPartitions() > 3
        got = [(r["file"][-7:], r["line_no"], r["parsed"]["ticker"]) for r in found.select("file", "line_no", "parsed").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted((f"{n}.jsonl", k + 1, f"T{k}") for n in ("a", "b") for k in range(4000))


def test_snapshot_listing(spark, tmp_path):
    now = F.lit("2026-09-15T12:00:00Z").cast("timestamp")
    for name, at in (("2026-09-14.json", "2026-09-14T08:00:00Z"), ("2026-09-15.json", "2026-09-15T12:09:00Z"), ("2026-09-16.json", "2026-09-15T12:11:00Z"), ("draft.json", "2026-09-14T08:00:00Z"), ("2026-09-13.json", "2026-09-13T08:00:00")):
        (tmp_path / name).write_text(json.dumps({"snapshot_utc": at, "tickers": {}}))
    snaps = readers.snapshots(spark, str(tmp_path))
    listed = readers.validated(snaps, now)
    assert sorted(r["snapshot_id"] for r in listed.collect()) == ["2026-09-14.json", "2026-09-15.json"]  # no zone, too far ahead, no date: out
    assert [r["snapshot_id"] for r in readers.latest(listed).collect()] == ["2026-09-15.json"]
    gate = spark.createDataFrame([("2026-09-15.json", False), ("2026-09-14.json", True)], "snapshot_id string, publishable boolean")
    assert [r["snapshot_id"] for r in readers.latest(readers.validated(snaps, now, gate)).collect()] == ["2026-09-14.json"]


RAW = "ticker string, date string, reportedFiscalPeriodEnding string, consensus string, analysts string, updateTime string, source string"


def test_tagged_sources(spark):
    rows = spark.createDataFrame([("x", "2026-09-01", "Jan 2027", "1", "3", None, None), ("x", "bad", "Jan 2027", "1", "3", None, None)], RAW)
    tagged = readers.tagged_sources([("canonical", "history", 0, True, rows), ("site", "export", 3, False, rows)])
    assert sorted((r["source_name"], r["kind"], r["priority"], r["reject_reason"] or "") for r in tagged.collect()) == [
        ("canonical", "history", 0, ""),
        ("canonical", "history", 0, "invalid_date"),
        ("site", "export", 3, "untrusted_source"),
        ("site", "export", 3, "untrusted_source"),
    ]
    assert history.reconcile(tagged).first()["action"] == "existing"


def test_materialize_and_export(spark, tmp_path):
    rows = spark.createDataFrame([("B", "p", "2026-09-02", "t", 2.0), ("A", "p", "2026-09-01", "t", 1.0)], "entity string, period string, obs_date string, update_time string, value double")
    writers.materialize(rows.coalesce(1), str(tmp_path / "runtime"))
    assert [r["entity"] for r in spark.read.parquet(str(tmp_path / "runtime")).collect()] == ["A", "B"]
    with pytest.raises(writers.NotFiniteError):
        writers.materialize(rows.withColumn("value", F.lit(float("nan"))), str(tmp_path / "runtime"))
    assert spark.read.parquet(str(tmp_path / "runtime")).count() == 2  # nothing was written
    series = writers.nested_export(rows.withColumns({"slot": F.col("period"), "obs_date": F.to_date("obs_date")}))
    writers.export({"table": rows, "series": series}, str(tmp_path / "out"), "build-1", form="json")
    assert {r["build_id"] for name in ("table", "series") for r in spark.read.json(str(tmp_path / "out" / name)).collect()} == {"build-1"}
    days = writers.daily_summary(spark.createDataFrame([("A", 1.0, None), ("B", 2.0, "LAST_KNOWN_GOOD")], "entity string, value double, badge string"), "2026-09-01")
    assert sorted((str(r["day"]), r["entity"], r["value"], r["state"]) for r in days.collect()) == [("2026-09-01", "A", 1.0, "FRESH"), ("2026-09-01", "B", 2.0, "LAST_KNOWN_GOOD")]


def test_small_functions(spark):
    d = lambda x: F.lit(x).cast("date")
    got = one(
        spark,
        dates.baseline_gap_allowed(d("2026-09-11"), d("2026-09-14")),  # Friday to Monday
        dates.baseline_gap_allowed(d("2026-09-11"), d("2026-09-15")),
        dates.baseline_gap_allowed(d("2026-09-15"), d("2026-09-14")),
        fiscal.period_key(F.lit("January 2027")),
        fiscal.period_key(F.lit("  ")),
        numbers.number_text(F.lit(1234.5)),
        alerts.event_day(F.lit("2026-09-11T08:00:00Z")).cast("string"),
        alerts.event_day(F.lit("soon")).cast("string"),
    )
    assert tuple(got) == (True, False, False, "Jan 2027", None, "1,234.50", "2026-09-11", None)
    direction = lambda **kv: text.analyst_direction(F.create_map(*[F.lit(x) for p in kv.items() for x in p]) if kv else F.create_map().cast("map<string,string>"))
    a, b, c = one(spark, direction(numUp="4", upCount="9", numDown="n/a"), direction(consensus="3"), direction())
    assert tuple(a) == (4.0, None, "ok", None) and tuple(b) == tuple(c) == (None, None, "unavailable", "not_in_source")


def test_orders(spark):
    rows = spark.createDataFrame([("d", "low", 3), ("a", "high", 1), ("b", "HIGH", 2), ("c", "odd", 9), ("e", "high", 2)], "id string, severity string, t long").withColumn("event_at", F.timestamp_seconds("t"))
    assert [r["id"] for r in rows.orderBy(*alerts.active_order()).collect()] == ["b", "e", "a", "d", "c"]
    table = spark.createDataFrame([("X", p) for p in ("TTM", "Oct 2026", "Jan 2028", "Jan 2027")], "entity string, period string")
    assert [r["period"] for r in table.orderBy(*windows.momentum_order()).collect()] == ["Jan 2027", "Jan 2028", "Oct 2026", "TTM"]
    reported = spark.createDataFrame([("X", "Jan 2027", "+1.5%", "n/a", "-3")], "entity string, period string, rev_1m string, rev_3m string, rev_6m string")
    got = {r["period"]: tuple(r)[2:] for r in windows.with_reported(table, reported).collect()}
    assert got["Jan 2027"] == (1.5, None, -3.0) and got["TTM"] == (None, None, None)


SERIES = "entity string, period string, t long, pct double"


def series(spark, rows):
    return spark.createDataFrame(rows, SERIES).select("entity", "period", F.timestamp_seconds("t").alias("as_of"), "pct")


def told(df):
    return sorted((r["entity"], r["as_of"].timestamp(), r["pct"], r["event"], r["episode"]) for r in df.collect())


@pytest.mark.parametrize("in_band", [True, False])
def test_batch_and_stream_agree_on_equal_times(spark, tmp_path, in_band):
    rows = series(spark, [("A", "p", 1, 6.0), ("A", "p", 1, 3.0), ("A", "p", 1, 9.0), ("A", "p", 2, 4.5), ("A", "p", 3, 2.0), ("A", "p", 3, 7.0), ("B", "p", 1, None), ("B", "p", 1, -8.0)])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    streamed = _drained(stream.alert_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), in_band), "ties")
    batch = told(alerts.hysteresis(rows, refresh_in_band=in_band))
    assert batch == told(streamed) and {e for _, _, _, e, _ in batch} >= {"Open", "Resolved"}


@pytest.mark.parametrize("in_band", [True, False])
def test_a_run_goes_on_from_open_alerts(spark, in_band):
    rows = [("A", "p", k, v) for k, v in enumerate([6.0, 6.2, 4.5, 7.0, 8.5])] + [("B", "p", k, v) for k, v in enumerate([1.0, 5.5, -5.5, 4.2, 3.0])]
    whole = told(alerts.hysteresis(series(spark, rows), refresh_in_band=in_band))
    for cut in range(1, 5):
        first = series(spark, [r for r in rows if r[2] < cut])
        # the stored percentage: the last one seen, or the last strong one where holds don't refresh it
        stored = {}
        for e, p, _, v in (r for r in rows if r[2] < cut and (in_band or abs(r[3]) >= 5)):
            stored[e, p] = v
        past = told(alerts.hysteresis(first, refresh_in_band=in_band))
        state = {}
        for e, _, _, event, _ in past:
            state[e] = event != "Resolved"
        still = [(e, p, stored[e, p]) for e, p in stored if state.get(e)]
        going = alerts.hysteresis(series(spark, [r for r in rows if r[2] >= cut]), refresh_in_band=in_band, open_alerts=spark.createDataFrame(still, "entity string, period string, pct double"))
        assert [x[:4] for x in sorted(past + told(going))] == [x[:4] for x in whole]


def test_a_rule_that_fails_while_it_runs(spark, tmp_path):
    rows = spark.createDataFrame([(f"{r}:{k}", r, k) for r in ("good", "bad") for k in range(3)], "id string, rule string, seq long").withColumns(
        {"status": F.lit("open"), "lifecycle": F.lit("Open"), "pct": F.lit(1.0), **{c: F.timestamp_seconds("seq") for c in ("created_at", "opened_at", "event_at")}}
    )
    bad = lambda: rows.where("rule = 'bad'").withColumn("pct", F.raise_error(F.lit("broken source")).cast("double"))
    rules = {"good": lambda: rows.where("rule = 'good'"), "bad": bad}
    merged, _, report = datasets.evaluate(rules, rows.limit(0), rows.where("rule = 'bad' and seq = 1"), F.current_timestamp(), folder=str(tmp_path / "run"))
    assert [r[:2] for r in report] == [("good", "ok"), ("bad", "error")]
    assert sorted(r["id"] for r in merged.collect()) == ["bad:1", "good:0", "good:1", "good:2"]


def test_cutoff_in_a_stream(spark, tmp_path):
    day = 86400
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([0, 5 * day, 20 * day, 20 * day + 500, 20 * day + 700])], "id long, t long").withColumn("known_at", F.timestamp_seconds("t"))
    rows.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    now = F.timestamp_seconds(F.lit(20 * day))
    kept = lambda **kv: sorted(r["id"] for r in _drained(ingest.within_cutoff(source(), now, **kv), "cutoff").collect())
    assert kept() == [2, 3]
    assert kept(backfill=True) == [0, 1, 2, 3]
    assert kept(as_of=F.timestamp_seconds(F.lit(6 * day)), backfill=True) == [0, 1]


def test_ranking_over_ranges(spark):
    rows = [(f"E{k:04d}", float(k * 7919 % 500) if k % 5 else None, "label" if k % 11 == 0 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "entity string, v double, label string")
    from tidemark.operators import valuation

    for down in (False, True):
        got = {r["entity"]: r["place"] for r in valuation.ranked(df, "v", down, "label").collect()}
        want = sorted(rows, key=lambda r: (r[1] is None or r[2] is not None, 0 if r[1] is None or r[2] else (-r[1] if down else r[1]), r[0]))
        assert got == {r[0]: k + 1 for k, r in enumerate(want)}


def test_restated_panel_against_brute_force(spark):
    """Days known early, promptly, late, and more than once, against a look at all rows for each as-of."""
    import datetime as dt
    import random

    rng, start, rows = random.Random(3), dt.datetime(2026, 1, 1), []
    for seq in range(260):
        day = start + dt.timedelta(days=rng.randint(0, 60))
        lag = rng.choice([0, 0, 0, 0.3, 0.9, 1.5, 4, 12, -2])
        update = None if rng.random() < 0.2 else day + dt.timedelta(days=lag, minutes=seq)
        rows.append((rng.choice("AB"), "Jan 2027", day.date(), update, seq, float(rng.randint(0, 30))))
    utc = dt.timezone.utc
    obs = spark.createDataFrame([(*r[:3], r[3].replace(tzinfo=utc) if r[3] else None, *r[4:]) for r in rows], "entity string, period string, obs_date date, update_ts timestamp, seq long, value double")
    grid = [start + dt.timedelta(days=k) for k in range(2, 75, 4)]
    got = {}
    for r in windows.restated_panel(obs, spark.createDataFrame([(g.replace(tzinfo=utc),) for g in grid], "as_of timestamp"), (1, 7, 14)).collect():
        got[r["entity"], r["as_of"].timestamp(), r["days"]] = (r["anchor_date"], r["base_date"], r["reason"], r["start_value"], r["end_value"])
    known = lambda r: r[3] or dt.datetime.combine(r[2], dt.time())
    for entity in "AB":
        for g in grid:
            best = {}
            for r in (r for r in rows if r[0] == entity and known(r) <= g):
                if r[2] not in best or (r[3] is not None, r[3] or start, r[4]) > (best[r[2]][3] is not None, best[r[2]][3] or start, best[r[2]][4]):
                    best[r[2]] = r
            anchor = max(best.values(), key=lambda r: (known(r), r[2], r[4]), default=None)
            for days in (1, 7, 14):
                target = (anchor[2] if anchor else g.date()) - dt.timedelta(days=days)
                base = max((d for d in best if d <= target), default=None)
                a = got[entity, g.replace(tzinfo=utc).timestamp(), days]
                assert a[0] == (anchor[2] if anchor else None) and a[1] == base, (entity, g, days)
                if a[2] is None:
                    assert a[3] == best[base][5] and a[4] == anchor[5]


def _times(df, word):
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_numbers_of_an_event_are_read_once(spark):
    """The three texts of an event were each matched many times, in the filter and again after it."""
    rows = [("A", "P", "1,000", "$1020.5", None, "update", "2026-01-02", None), ("A", "P", "100", "90", "n/a", "update", None, "2026-01-03T00:00:00Z"), ("A", "P", "100", "101", None, "update", "2026-01-04", None), ("A", "P", None, "5", "n/a", "", "2026-01-05", None), ("A", "P", "1e999", "5", "-3%", "", "2026-01-06", None), (None, "P", "1", "2", None, "", "2026-01-06", None)]
    events = spark.createDataFrame(rows, "entity string, period string, previous string, current string, revision string, reason string, date string, update_time string").repartition(2)
    out = alerts.single_revisions(events)
    assert _times(out, "RLIKE") == 3
    assert sorted((r["event_date"], r["direction"], round(r["pct"], 6)) for r in out.collect()) == [("2026-01-02", "upgrade", 2.05), ("2026-01-03", "downgrade", -10.0), ("2026-01-06", "downgrade", -3.0)]


def test_margins_of_a_digest_are_read_once(spark):
    """Texts were matched again for every use of a number."""
    rows = [("D", "Q1", "2026-01-02", "40%", "60%", "50%", "margin fell 10 bps", "45%"), ("D", "Q2", "2026-01-02", "40%", "40%", "50%", "rose by 350 bps", "45%"), ("D", None, "2026-01-02", None, "41%", "46%", None, "45%"), ("D", "Q3", "2026-01-02", "40%", "n/a", None, "down 90 bps", None)]
    digests = spark.createDataFrame(rows, "entity string, period string, report_date string, previous_guidance string, current_guidance string, guided string, free_text string, reported string").repartition(2)
    out = alerts.margin_alerts(digests)
    assert _times(out, "regexp_extract_all(") == 4 and _times(out, "bps") < 20
    got = sorted((r["period"], r["rule"], r["severity"], r["bps"]) for r in out.collect())
    assert got == [("Q1", alerts.MARGIN_GUIDANCE, "high", 2000.0), ("Q1", alerts.PRESSURE, "high", 500.0), ("Q2", alerts.PRESSURE, "high", 350.0), ("Q3", alerts.MARGIN_GUIDANCE, "medium", None)]


def test_parts_of_an_id_are_matched_once(spark):
    texts = spark.createDataFrame([("a  b",), ("  ",), ("\t",), (None,), ("a:b/c",), ("",)], "t string").repartition(2)
    out = texts.select(ids.alert_id(F.lit("x"), F.col("t")).alias("i"))
    assert _times(out, "regexp_replace(") == 1
    assert sorted(r["i"] for r in out.collect()) == ["x:_", "x:a_b", "x:a_b-c", "x:na", "x:na", "x:na"]
