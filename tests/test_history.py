"""Merging, conflicts and change capture."""

import pytest

from tidemark.operators import history

ROWS = "entity string, period string, obs_date string, update_time string, value double, coverage double"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).selectExpr("entity", "period", "to_date(obs_date) as obs_date", "update_time", "value", "coverage")


A = ("X", "Jan 2027", "2026-09-01", "t1", 1.0, 5.0)
B = ("X", "Jan 2027", "2026-09-02", "t2", 2.0, 5.0)


def test_replay_is_a_no_op(spark):
    old = table(spark, [A, B])
    assert history.idempotent_merge(old, old).count() == 2
    assert history.new_observations(old, old).count() == 0
    assert history.touched_months(old, history.idempotent_merge(old, old)).count() == 0


def test_conflict_stops_the_merge(spark):
    changed = (*A[:4], 1.5, 5.0)
    for old, new in (([A], [changed]), ([], [A, changed]), ([A], [(*A[:5], None)]), ([(*A[:4], None, 1.0)], [(*A[:4], 1.0, None)])):
        assert history.conflicts_between(table(spark, old), table(spark, new)).count() == 1
        with pytest.raises(Exception, match="several payloads"):
            history.idempotent_merge(table(spark, old), table(spark, new)).collect()


def test_rows_that_are_there_twice_stay(spark):
    assert sorted(map(tuple, history.idempotent_merge(table(spark, [A, A]), table(spark, [A, B, B])).select("update_time", "value").collect())) == [("t1", 1.0), ("t1", 1.0), ("t2", 2.0)]


def test_null_coverage_is_not_zero(spark):
    rows = table(spark, [(*A[:5], None), (*A[:5], 0.0)])
    assert history.identity_groups(rows).first()["kind"] == "conflict"


def test_reconcile_does_not_depend_on_order(spark):
    def tagged(order):
        parts = {"canonical": (0, [A]), "archive": (1, [A, B]), "export": (2, [(*B[:4], 9.0, 5.0)])}
        out = None
        for name in order:
            priority, rows = parts[name]
            df = table(spark, rows).selectExpr("*", f"'{name}' as source_name", f"{priority} as priority", "cast(null as string) as reject_reason")
            out = df if out is None else out.unionByName(df)
        return sorted(map(tuple, history.reconcile(out).collect()), key=repr)

    assert tagged(["canonical", "archive", "export"]) == tagged(["export", "archive", "canonical"])
    actions = {r[2].day: r[5] for r in tagged(["archive", "export", "canonical"])}
    assert actions == {1: "existing", 2: "conflict"}


def test_a_value_that_returns_is_kept(spark):
    rows = spark.createDataFrame([("X", "P", "d", i, v) for i, v in enumerate([1.0, 2.0, 1.0, 1.0])], "entity string, period string, obs_date string, seq long, value double")
    assert [r["seq"] for r in history.change_only(rows).orderBy("seq").collect()] == [0, 1, 2]


def test_new_period_in_an_old_slot_is_a_baseline(spark):
    rows = spark.createDataFrame([("X", "Jan 2027", "2026E", 1, 5.0), ("X", "Jan 2028", "2026E", 2, 9.0)], "entity string, period string, slot string, seq long, value double")
    assert [r["kind"] for r in history.change_events(rows, ("seq",)).collect()] == ["baseline", "baseline"]


def test_fingerprint_ignores_row_order(spark):
    rows = table(spark, [A, B])
    one, two = (history.dataset_fingerprint(x).first() for x in (rows, rows.orderBy("obs_date", ascending=False).repartition(3)))
    assert one == two
    assert history.dataset_fingerprint(table(spark, [A])).first() != one


def test_admission_order_of_reasons(spark):
    raw = spark.createDataFrame(
        [
            ("x", "2026-09-01", "Jan 2027", "1", "revision_history_seed", None, None),
            ("x", "2026-09-01", "Jan 2027", "1", None, "true", None),
            ("x", "2026-09-01", "2027E", "1", None, None, None),
            ("x", "2026-09-01", None, "1", None, None, None),
            ("x", "2026-09-01", None, "1", None, None, "2027E"),
            ("x", "2026-09-01", "Jan 2027", "n/a", None, None, None),
            ("x", "2026-99-01", "Jan 2027", "1", None, None, None),
            (" ", "2026-09-01", "Jan 2027", "1", None, None, None),
            ("x", "2026-09-01", "Jan 2027", "1", None, None, None),
        ],
        "ticker string, date string, reportedFiscalPeriodEnding string, consensus string, source string, collectionFailed string, slot string",
    )
    got = [r["reject_reason"] for r in history.classified(raw).collect()]
    assert got == ["seed_from_revision_history", "collection_failed_or_lkg", "mapped_year_not_identity", "invalid_fiscal_identity", "mapped_year_not_identity", "invalid_consensus", "invalid_date", "rejected_by_canonical_admission", None]
    assert history.admitted(raw).first()["update_time"] == "2026-09-01T00:00:00Z"
