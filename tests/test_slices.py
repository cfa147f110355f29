"""Series worked on by slices: the same rows as whole series give, and one series is many tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import alerts, history, slices
from tidemark.streaming.alerts import step


def slow_lifecycle(rows, in_band, seeds):
    """The state machine row by row."""
    out, states = [], {k: (True, pct, 1) for k, pct in seeds.items()}
    for e, t, pct in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        states[e], event = step(states.get(e, (False, None, 0)), pct, in_band)
        if event:
            out.append((e, t, pct, event, states[e][2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("in_band", [True, False])
@pytest.mark.parametrize("seeded", [True, False])
def test_state_machine_by_blocks_of_three(spark, in_band, seeded):
    rng = random.Random(in_band + 2 * seeded)
    rows = [(rng.choice("ABC"), rng.choice([None, *range(1, 100)]), rng.choice([None, 0.0, 3.0, 4.2, -4.5, 5.0, 5.6, -5.2, 6.5, -9.0, 12.0])) for _ in range(400)]
    seeds = {"A": 7.5, "B": -5.4, "D": 9.0} if seeded else {}
    series = spark.createDataFrame([(e, "p", t, v) for e, t, v in rows], "entity string, period string, as_of long, pct double")
    opened = spark.createDataFrame([(e, "p", v) for e, v in seeds.items()], "entity string, period string, pct double")
    want = slow_lifecycle(rows, in_band, seeds)
    for width in (3, 1, 1000):
        cut = F.coalesce(F.floor(F.col("as_of") / width), F.lit(-1))
        got = alerts.hysteresis(series.repartition(7), refresh_in_band=in_band, open_alerts=opened, cut=cut).drop("period").collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert {r[3] for r in want} == {"Open", "Resolved", "Updated", "Hold"}


@pytest.mark.parametrize("before", [True, False])
def test_running_last(spark, before):
    rng = random.Random(4)
    rows = spark.createDataFrame([(rng.choice("AB"), rng.choice([None, *range(60)]), k, rng.choice([None, None, float(k)]), rng.choice([None, str(k)])) for k in range(300)], "entity string, at long, seq long, v double, s string")
    w = Window.partitionBy("entity").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = sorted(map(tuple, rows.withColumns({"x": F.last("v", True).over(w), "y": F.last("s", True).over(w)}).collect()), key=repr)
    for cut in (None, F.coalesce(F.floor(F.col("at") / 4), F.lit(-5))):
        got = slices.running_last(rows, ("entity",), ("at", "seq"), {"x": "v", "y": "s"}, before=before, cut=cut)
        assert got.columns == [*rows.columns, "x", "y"] and sorted(map(tuple, got.collect()), key=repr) == want


def test_slices_rise_with_their_column(spark):
    rows = spark.sql("SELECT d, CAST(d AS timestamp) AS t, n, v FROM VALUES (DATE'1995-12-31', 5L, 'a'), (DATE'1996-01-01', 70000L, 'b'), (CAST(NULL AS date), NULL, NULL), (DATE'0044-03-15', -9L, 'c') AS x(d, n, v)")
    for c in ("d", "t", "n"):
        got = rows.select(c, slices.slice_of(rows, c).alias("s")).orderBy(F.col(c).asc_nulls_first()).collect()
        assert [r["s"] for r in got] == sorted(r["s"] for r in got) and len({r["s"] for r in got}) >= 3
    assert rows.select(slices.slice_of(rows, "v").alias("s")).distinct().count() == 1


def test_one_series_of_ten_million_rows_is_many_tasks(spark):
    n = 10_000_000
    rows = spark.range(n).select(F.lit("X").alias("entity"), F.lit("p").alias("period"), F.timestamp_seconds(F.col("id") * 60).alias("as_of"), F.when(F.col("id") % 5000 < 3000, 6.0).otherwise(1.0).alias("pct"))
    out = alerts.hysteresis(rows).where("event <> 'Hold'").groupBy("event", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("episode").alias("last")).collect()
    assert {e: sum(r["n"] for r in out if r["event"] == e) for e in ("Open", "Resolved")} == {"Open": n // 5000, "Resolved": n // 5000}
    assert max(r["last"] for r in out) == n // 5000 and len({r["task"] for r in out}) > 2


def test_changes_over_slices(spark):
    rows = spark.range(3 * slices.WIDTH).select(F.lit("X").alias("entity"), F.lit("p").alias("period"), F.col("id").alias("seq"), F.floor(F.col("id") / 1000).cast("double").alias("value"))
    kinds = {r["kind"]: r["count"] for r in history.change_events(rows, ("seq",)).groupBy("kind").count().collect()}
    assert kinds == {"baseline": 1, "upgrade": (3 * slices.WIDTH - 1) // 1000}
