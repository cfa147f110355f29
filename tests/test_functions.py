"""Golden cases of the scalar functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, fiscal, ids, labels, numbers, text, urls


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(v, kind="double"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1,234.5", 1234.5), ("$7", 7.0), ("0.13%", 0.13), (" -1.5e2 ", -150.0), (".5", 0.5), ("true", None), ("12d", None), ("NaN", None), ("Infinity", None), ("1e999", None), ("n/a", None), ("—", None), ("", None), (None, None), ("1_000", None)],
)
def test_to_num(spark, raw, want):
    assert value(spark, numbers.to_num(lit(raw, "string"))) == want


def test_formulas(spark):
    g = lambda a, b: (value(spark, numbers.growth_ratio(lit(a), lit(b))), value(spark, numbers.growth_label(lit(a), lit(b))))
    assert value(spark, numbers.pe(lit(100.0), lit(0.0))) is None
    assert value(spark, numbers.pe(lit(100.0), lit(5.0))) == 20
    assert g(-1.0, 2.0) == (None, "Turn profitable")
    assert g(2.0, -1.0) == (None, "Turn loss")
    assert g(0.0, 1.0) == (None, None)
    assert g(10.0, 12.0) == (pytest.approx(0.2), None)
    assert g(5.0, 0.0) == (-1.0, None)
    assert g(-1.0, 0.0) == (None, "Break-even")
    assert [g(-2.0, -1.0)[1], g(-1.0, -2.0)[1], g(-1.0, -1.0)[1]] == ["Loss narrowing", "Loss widening", "Loss unchanged"]
    assert g(None, 1.0) == (None, None)
    assert value(spark, numbers.cagr(lit(-1.0), lit(5.0))) is None
    assert value(spark, numbers.dispersion(lit(10.0), lit(5.0), lit(-2.0))) is None
    assert value(spark, numbers.alert_dispersion(lit(10.0), lit(5.0), lit(-2.0))) == 2.5
    assert value(spark, numbers.growth_adjusted_pe(lit(20.0), lit(0.25))) == pytest.approx(0.8)
    assert value(spark, numbers.revision_pct(lit(-2.0), lit(-1.0))) == 50
    assert value(spark, numbers.revision_pct(lit(0.0), lit(1.0))) is None
    assert value(spark, numbers.price_outlier(lit(10.1), lit(1.0))) is True
    assert value(spark, numbers.price_outlier(lit(1.2), lit(1.0))) is False
    assert value(spark, numbers.range_position(lit(12.0), lit(5.0), lit(10.0))) == 100
    assert value(spark, numbers.range_position(lit(7.0), lit(10.0), lit(10.0))) is None
    assert value(spark, numbers.same_value(lit(None), lit(None))) is True
    assert value(spark, numbers.same_value(lit(None), lit(0.0))) is False


def test_two_lists_of_sentinels(spark):
    at_gate = lambda x: value(spark, numbers.is_unavailable(lit(x, "string")))
    at_export = lambda x: value(spark, numbers.is_unavailable(lit(x, "string"), at_export=True))
    assert at_gate("—") and not at_export("—")
    assert at_export("n/a (baseline)") and not at_gate("n/a (baseline)")
    assert at_gate(None) and at_export(" NULL ")


def test_weekday_gap_against_counting(spark):
    rng = random.Random(5)
    pairs = [(dt.date(1995, 1, 1) + dt.timedelta(days=rng.randrange(12000)), rng.randrange(40)) for _ in range(400)]
    rows = [(a, a + dt.timedelta(days=n)) for a, n in pairs]
    df = spark.createDataFrame(rows, "a date, b date").select("a", "b", dates.weekday_gap(F.col("a"), F.col("b")).alias("gap"))
    for r in df.collect():
        assert r["gap"] == sum((r["a"] + dt.timedelta(days=k)).weekday() < 5 for k in range(1, (r["b"] - r["a"]).days + 1))


@pytest.mark.parametrize(
    ("label", "end", "want"),
    [("January 2027", None, "Jan 2027"), ("sept 2027", None, "Sep 2027"), ("2027-01", None, "Jan 2027"), ("2027-13", None, None), ("FY2027", 6, "Jun 2027"), ("FY 2027", None, None), ("2027E", 1, "Jan 2027"), ("2027", 12, "Dec 2027"), ("n/a", 6, None), (None, 6, None), ("junk", 6, None)],
)
def test_reported_period(spark, label, end, want):
    assert value(spark, fiscal.reported_period(lit(label, "string"), lit(end, "int"))) == want


def test_slots_and_years(spark):
    slot = lambda x: value(spark, fiscal.mapped_slot(lit(x, "string")))
    assert [slot("Jan 2027"), slot("Mar 2027"), slot("Apr 2027")] == ["2026E", "2026E", "2027E"]
    assert value(spark, fiscal.normalized_period(lit(" odd label ", "string"))) == "odd label"
    assert value(spark, fiscal.looks_like_slot(lit(" 2027e", "string"))) is True
    assert value(spark, fiscal.slot_from_alignment(lit("CY2027", "string"))) == "2027E"
    years = fiscal.display_years(lit(2026, "int"))
    assert value(spark, years) == ["2026E", "2027E", "2028E", "2029E"]
    assert value(spark, fiscal.chart_years(years)) == ["2026E", "2027E", "2028E"]
    assert value(spark, fiscal.default_year(years)) == "2027E"
    assert value(spark, fiscal.valid_years(F.array(F.lit("2026E"), F.lit("soon")))) == []


def test_labels(spark):
    m = lambda a, b: value(spark, labels.momentum(lit(a), lit(b)))
    r = lambda a, b: value(spark, labels.revision_regime(lit(a), lit(b)))
    assert [m(3.0, 3.0), m(1.0, 5.0), m(-3.0, -4.0), m(-1.0, -9.0), m(0.5, 9.0), m(None, 9.0)] == ["Strong Positive", "Positive", "Strong Negative", "Negative", "Neutral", "Neutral"]
    pairs = [(None, 1.0), (-1.0, 5.0), (5.0, -1.0), (3.0, 4.0), (-3.0, -4.0), (0.5, -0.5), (1.0, 2.0), (-1.0, -2.0), (2.0, -2.0)]
    assert [r(*p) for p in pairs] == ["Insufficient Data", "Back-end Loaded / Divergent", "Front-loaded / Divergent", "Broad Upward Revision", "Broad Downward Revision", "Stable", "Mild Upward", "Mild Downward", "Divergent / Mixed"]
    s = lambda p, n, far: value(spark, labels.source_severity(lit(p), lit(n), F.lit(far)))
    assert [s(20.0, 12.0, False), s(6.0, None, False), s(2.0, None, True), s(8.0, 4.0, True), s(12.0, 4.0, True), s(6.0, 3.0, False)] == ["high", "medium", "low", "low", "medium", "medium"]
    assert value(spark, labels.window_momentum(lit(-5.0))) == "Strong Negative"
    assert value(spark, labels.coverage_confidence(lit(1.9))) == "Single estimate"
    assert value(spark, labels.collection_failed(F.array(F.lit("Fetch FAILED")))) is True


def test_text(spark):
    bps = lambda x: value(spark, text.bps_change(lit(x, "string")))
    assert [bps("Margin declined by 250 bps"), bps("up 80 bps"), bps("guided -150 bps"), bps("no change"), bps("down 5 bps")] == [-250, 80, -150, None, None]
    assert value(spark, text.margin_numbers(lit("from 45% to 46.5 %, tax 12%", "string"))) == [45.0, 46.5]
    assert value(spark, text.after_hours_price(lit("close; Post-market $101.25", "string"))) == 101.25
    assert value(spark, text.event_date(lit("11/25/2026 (Post-Market)", "string"))) == dt.date(2026, 11, 25)
    assert value(spark, text.event_session(lit("2026-11-25 (pre market)", "string"))) == "Pre-Market"
    assert value(spark, text.event_display(lit("11/25/2026 (Post-Market)", "string"), lit(None, "string"))) == "Nov 25, 2026 · Post-Market · Estimated"
    status = lambda declared, official: value(spark, text.event_status(lit("2026-11-25", "string"), lit(declared, "string"), lit(None, "string"), F.lit(official), F.lit(True)))
    assert [status("confirmed", True), status("confirmed", False), status(None, True)] == ["confirmed", "estimated", "estimated"]
    base = lambda *x: value(spark, text.is_baseline(*[lit(v, "string") for v in x]))
    assert [base("new Baseline", "1", "2"), base("x", "n/a (baseline)", "2"), base("x", None, None), base("x", "3", None)] == [True, True, True, False]


def test_urls(spark):
    host = lambda u: value(spark, urls.hostname(lit(u, "string")))
    assert [host("https://WWW.Sec.gov./x?u=http://a.b"), host("nothing"), host(None)] == ["www.sec.gov", None, None]
    tier = lambda u, kind, official: value(spark, urls.source_tier(lit(u, "string"), lit(kind, "string"), F.lit(official)))
    assert tier("https://sec.gov.evil.example/x", None, False) == "Unknown"
    assert tier("https://evilseekingalpha.com/x", None, False) == "Unknown"
    assert tier("https://data.sec.gov/x", None, False) == "1"
    assert tier("https://investor.acme.example/", None, False) == "unverified_ir_candidate"
    assert tier("https://investor.acme.example/", "company_ir", False) == "source_mismatch"
    assert tier(None, "transcript", False) == "official"
    assert tier("https://a.wsj.com", "dowjones", False) == "3"
    assert tier(None, None, False) is None


def test_ids(spark):
    s = lambda x: lit(x, "string")
    assert value(spark, ids.alert_id(s("a b"), s("X:Y"), s(None), s("1/2"), s(" "))) == "a_b:X_Y:na:1-2:na"
    one = value(spark, ids.event_id(s("nvda"), s("Jan 2027"), s("1.0"), s("2"), s("t")))
    assert one == value(spark, ids.event_id(s("NVDA"), s(" Jan 2027 "), s("1"), s("2.000000"), s("t")))
    assert one != value(spark, ids.event_id(s("NVDA"), s("Jan 2027"), s(None), s("2"), s("t")))


def test_freshness(spark):
    ts = lambda x: F.lit(x).cast("timestamp")
    stale = lambda last, now: value(spark, dates.is_stale(ts(last), ts(now)))
    assert stale("2026-09-18T00:30:00Z", "2026-09-20T12:00:00Z") is False  # Friday's success, on Sunday
    assert stale("2026-09-18T00:30:00Z", "2026-09-21T05:59:00Z") is False  # Monday, within the grace
    assert stale("2026-09-18T00:30:00Z", "2026-09-21T06:00:00Z") is True
    assert stale(None, "2026-09-21T06:00:00Z") is True
    assert value(spark, F.date_format(dates.next_due(ts("2026-09-18T01:00:00Z")), "yyyy-MM-dd HH:mm")) == "2026-09-21 00:00"
    assert value(spark, dates.age_days(ts("2026-09-10T00:00:00Z"), ts("2026-09-12T23:00:00Z"))) == 2
    active = lambda status, now: value(spark, dates.is_active(s(status), ts("2026-09-01T00:00:00Z"), F.lit(None).cast("timestamp"), ts(now), F.lit(True)))
    s = lambda x: lit(x, "string")
    assert [active("open", "2026-09-22T00:00:00Z"), active("open", "2026-09-22T00:00:01Z"), active("Resolved", "2026-09-02T00:00:00Z")] == [True, False, False]
    assert value(spark, dates.aware_timestamp_of(lit("2026-09-01T10:00:00", "string"))) is None
    assert value(spark, dates.strict_date_of(lit("2026-99-99", "string"))) is None
