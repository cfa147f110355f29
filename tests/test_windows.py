"""Golden cases of the windows, and the fast form against the general one on random histories."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows

OBS = "entity string, period string, obs_date date, update_ts timestamp, seq long, value double"


def obs(spark, rows):
    return spark.createDataFrame([("X", "Jan 2027", d, u, i, v) for i, (d, u, v) in enumerate(rows)], OBS)


def grid(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "as_of timestamp")


D = dt.date(2026, 9, 15)


def back(n):
    return D - dt.timedelta(days=n)


def panel(spark, rows, at=None):
    out = windows.revision_panel(obs(spark, rows), grid(spark, at or dt.datetime(2026, 9, 15, 23)))
    return {r["days"]: r for r in out.collect()}


def test_three_windows(spark):
    got = panel(spark, [(back(90), None, 10.0), (back(60), None, 11.0), (back(30), None, 12.0), (D, None, 15.0)])
    assert [round(got[n]["pct"], 4) for n in (30, 60, 90)] == [25.0, 36.3636, 50.0]


def test_cutoff_hides_later_updates(spark):
    rows = [(D, dt.datetime(2026, 9, 15, 8), 10.0), (D, dt.datetime(2026, 9, 15, 18), 12.0)]
    kept = windows.same_day_collapse(obs(spark, rows), F.lit("2026-09-15T12:00:00Z").cast("timestamp"))
    assert kept.first()["value"] == 10.0
    assert windows.same_day_collapse(obs(spark, rows)).first()["value"] == 12.0


def test_timed_beats_untimed_and_later_append_wins(spark):
    assert windows.same_day_collapse(obs(spark, [(D, dt.datetime(2026, 9, 15, 1), 1.0), (D, None, 2.0)])).first()["value"] == 1.0
    assert windows.same_day_collapse(obs(spark, [(D, None, 1.0), (D, None, 2.0)])).first()["value"] == 2.0


def test_friday_serves_a_monday_target(spark):
    monday = dt.date(2026, 8, 17)
    got = windows.asof_baseline(obs(spark, [(monday - dt.timedelta(days=3), None, 8.0)]), spark.createDataFrame([("X", "Jan 2027", monday)], "entity string, period string, target date")).first()
    assert (got["gap"], got["base_value"]) == (1, 8.0)


def test_a_gap_is_never_bridged_by_an_older_row(spark):
    got = panel(spark, [(back(40), None, 9.0), (back(35), None, 10.0), (D, None, 12.0)])[30]
    assert (got["status"], got["reason"], got["pct"], got["anchor_date"], got["target"]) == ("unavailable", "baseline_gap", None, D, back(30))


def test_zero_baseline_is_reported(spark):
    got = panel(spark, [(back(30), None, 0.0), (D, None, 12.0)])[30]
    assert (got["reason"], got["start_value"], got["pct"]) == ("zero_baseline", 0.0, None)


def test_no_rows_no_window(spark):
    assert windows.revision_panel(obs(spark, []), grid(spark, dt.datetime(2026, 9, 15))).count() == 0


def test_restated_history(spark):
    late = dt.datetime(2026, 9, 20)
    rows = [(back(30), dt.datetime(2026, 8, 16, 1), 10.0), (back(30), late, 5.0), (D, dt.datetime(2026, 9, 15, 1), 15.0)]
    out = windows.restated_panel(obs(spark, rows), grid(spark, dt.datetime(2026, 9, 15, 23), dt.datetime(2026, 9, 21)), (30,)).collect()
    got = {r["as_of"].day: r for r in out}
    assert got[15]["pct"] == pytest.approx(50.0)
    assert got[21]["anchor_date"] == back(30)  # the restatement is the latest thing known by then


def test_fast_and_general_form_agree_without_restatements(spark):
    rng = random.Random(11)
    rows = []
    for e in "ABC":
        for i in range(120):
            day = D - dt.timedelta(days=rng.randrange(200))
            stamp = dt.datetime.combine(day, dt.time(rng.randrange(24)))
            rows.append((e, "Jan 2027", day, stamp, len(rows), float(rng.randrange(5))))
    df = spark.createDataFrame(rows, OBS)
    at = grid(spark, *[dt.datetime.combine(back(k), dt.time(23, 59)) for k in (0, 17, 45, 80)])
    key = lambda r: tuple(r)
    fast = sorted(map(key, windows.revision_panel(df, at).collect()), key=repr)
    assert fast == sorted(map(key, windows.restated_panel(df, at).collect()), key=repr)


def test_input_partitions_do_not_matter(spark):
    rows = [(back(k), None, float(k % 7)) for k in range(120)]
    one = obs(spark, rows)
    many = one.repartition(7, F.rand(3))
    at = grid(spark, dt.datetime(2026, 9, 15, 23))
    assert sorted(map(tuple, windows.revision_panel(one, at).collect())) == sorted(map(tuple, windows.revision_panel(many, at).collect()))


def test_restated_history_is_dealt_twice(spark):
    """It was dealt for each of three lookups, their slices and the joins between them."""
    df = obs(spark, [(back(k), dt.datetime(2026, 9, 15), float(k)) for k in range(40)])
    plan = windows.restated_panel(df, grid(spark, dt.datetime(2026, 9, 16), dt.datetime(2026, 9, 20)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "SortMergeJoin" not in plan


def test_one_day_restated_between_many_as_ofs(spark):
    """More as-ofs than a block holds, given twice and with one of no time; a row of no known time is seen by none, also as an anchor."""
    day = dt.date(2026, 9, 1)
    rows = [(day, dt.datetime(2026, 9, 1) + dt.timedelta(hours=k), float(k + 1)) for k in range(24 * 30)]
    rows += [(day + dt.timedelta(days=1), dt.datetime(2026, 9, 20, 12), 7.0), (None, None, 9.0)]
    at = [dt.datetime(2026, 9, 1) + dt.timedelta(days=k) for k in range(-1, 3 * windows.BLOCK)]
    df = obs(spark, rows).union(spark.createDataFrame([("Y", "Jan 2027", None, None, 1, 5.0)], OBS)).repartition(5)
    out = windows.restated_panel(df, grid(spark, *at, *at, None), (0,)).collect()
    got = {(r["entity"], r["as_of"]): (r["anchor_date"], r["base_date"], r["start_value"], r["end_value"], r["reason"]) for r in out}
    assert len(out) == len(got) == 2 * (len(at) + 1)
    assert got["X", None] == got["X", at[0]] == got["Y", None] == got["Y", at[-1]] == (None, None, None, None, "no_anchor")
    for g in at[1:]:
        value = float((g - at[1]) / dt.timedelta(hours=1) + 1)
        assert got["X", g] == (day, day, None, value, "same_date")
    assert windows.restated_panel(df, grid(spark, at[0]).where("false")).count() == 0


def test_later_day_with_an_older_update_is_the_baseline(spark):
    """A day behind the anchor's that was known before it, and the versions of it that each as-of saw."""
    rows = [(back(2), dt.datetime(2026, 9, 14), 4.0), (back(1), dt.datetime(2026, 9, 14, 12), 5.0), (back(1), dt.datetime(2026, 9, 17), 6.0), (D, dt.datetime(2026, 9, 16), 12.0), (back(1), dt.datetime(2026, 9, 17, 1), 8.0)]
    out = windows.restated_panel(obs(spark, rows), grid(spark, *[dt.datetime(2026, 9, k) for k in (15, 16, 17, 18)]), (1,)).collect()
    got = {r["as_of"].day: (r["anchor_date"], r["base_date"], r["start_value"], r["end_value"]) for r in out}
    assert got == {15: (back(1), back(2), 4.0, 5.0), 16: (D, back(1), 5.0, 12.0), 17: (back(1), back(2), 4.0, 6.0), 18: (back(1), back(2), 4.0, 8.0)}


def test_days_known_in_advance_are_baselines(spark):
    """An anchor in the future, and days before it that were known early: those behind a prompt day after the as-of were missed."""
    early = dt.datetime(2026, 9, 1)
    rows = [(back(10), dt.datetime(2026, 9, 5, 8), 1.0), (back(5), early, 2.0), (back(4), dt.datetime(2026, 9, 11, 8), 3.0), (back(2), early, 4.0), (D, dt.datetime(2026, 9, 6), 5.0)]
    out = windows.restated_panel(obs(spark, rows), grid(spark, dt.datetime(2026, 9, 8)), (0, 1, 3)).collect()
    assert {r["days"]: (r["anchor_date"], r["base_date"]) for r in out} == {0: (D, D), 1: (D, back(2)), 3: (D, back(5))}
