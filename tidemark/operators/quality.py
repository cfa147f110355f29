"""The quality gate: row checks, comparison with the last known good snapshot, and one decision per snapshot.

A flat snapshot table has ``snapshot_id, entity, slot`` and raw text columns ``label, value, high, low, coverage, rev_1m, rev_3m, rev_6m``;
prices are in an entity table ``snapshot_id, entity, price``. Decisions follow one fixed order of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import FUTURE_MINUTES, STALE_DAYS, aware_timestamp_of
from tidemark.functions.fiscal import label_parsable, looks_like_slot, mapped_slot, reported_period, was_normalized
from tidemark.functions.numbers import is_unavailable, price_outlier, to_num

MIN_ROWS, EXTREME_PCT, PRICE_PCT, COVERAGE_DROP = 2, 30.0, 30.0, 2


def normalized_snapshot(rows: DataFrame, fiscal_end: DataFrame) -> DataFrame:
    """Labels rewritten to ``Mon YYYY`` where the fiscal calendar (``entity, fiscal_end_month``, one row per watched entity) allows, with the
    display slot they map to."""
    joined = rows.join(fiscal_end, "entity", "left")
    period = reported_period(F.col("label"), F.col("fiscal_end_month"))
    return joined.withColumns({"period": period, "was_normalized": F.coalesce(was_normalized(F.col("label"), F.col("fiscal_end_month")), F.lit(False)), "mapped_slot": mapped_slot(period)})


def row_errors(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``period``) and ``errors``, the list of all that is wrong with the row."""
    value, high, low, coverage = (to_num(F.col(c)) for c in ("value", "high", "low", "coverage"))
    label = F.col("label")
    missing = is_unavailable(label)
    identity = F.when(value.isNotNull() & F.col("period").isNull(), F.when(missing, F.lit("missing_fiscal_identity")).otherwise(F.concat(F.lit("fiscal_identity_unnormalizable:"), label)))
    parsable = F.when(value.isNull() & (F.trim(label) != "") & ~label_parsable(label) & ~looks_like_slot(label), F.concat(F.lit("fiscal_label_unparsable:"), label))
    numeric = F.when(value.isNull() & ~is_unavailable(F.col("value")), F.lit("consensus_not_numeric"))
    order = F.when(~((low <= value) & (value <= high)), F.lit("dispersion_order"))
    bad_count = coverage.isNull() | (coverage < 0) | (coverage != F.floor(coverage))
    count = F.when(~is_unavailable(F.col("coverage")) & bad_count, F.concat(F.lit("analyst_count_invalid:"), F.col("coverage")))
    revisions = [F.when(~is_unavailable(F.col(c)) & to_num(F.col(c)).isNull(), F.lit(f"revision_not_numeric:{c}")) for c in ("rev_1m", "rev_3m", "rev_6m") if c in rows.columns]
    return rows.withColumn("errors", F.array_compact(F.array(identity, parsable, numeric, order, count, *revisions)))


def _by_entity(rows: DataFrame, *more: Column) -> DataFrame:
    value = to_num(F.col("value"))
    return row_errors(rows).groupBy("snapshot_id", "entity").agg(
        F.count_if(value.isNotNull()).alias("n_usable"),
        F.flatten(F.collect_list("errors")).alias("row_errors"),
        F.count(F.when(~is_unavailable(F.col("label")), F.trim("label"))).alias("n_labels"),
        F.count_distinct(F.when(~is_unavailable(F.col("label")), F.trim("label"))).alias("n_distinct"),
        F.bool_or(value.isNotNull() & (to_num(F.col("coverage")) == 0)).alias("zero_coverage"),
        *more,
    )


def _verdict(entities: DataFrame, min_rows: int, *more: str) -> DataFrame:
    price = to_num(F.col("price"))
    n = F.coalesce("n_usable", F.lit(0))
    extra = F.array_compact(
        F.array(
            F.when(price.isNull() | (price <= 0), F.lit("price_invalid")),
            F.when(n < min_rows, F.concat(F.lit("min_fiscal_rows:"), n, F.lit(f"<{min_rows}"))),
            F.when(F.col("n_labels") > F.col("n_distinct"), F.lit("duplicate_reported_fiscal")),
        )
    )
    errors = F.array_sort(F.concat(F.coalesce("row_errors", F.array().cast("array<string>")), extra))
    return entities.select("snapshot_id", "entity", n.alias("n_usable"), price.alias("price"), F.coalesce("zero_coverage", F.lit(False)).alias("zero_coverage"), errors.alias("errors"), (F.size(errors) > 0).alias("rejected"), *more)


def entity_gate(rows: DataFrame, prices: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Per snapshot and entity: usable rows and all errors, with invalid prices, too few rows and repeated labels among them."""
    return _verdict(prices.join(_by_entity(rows), ["snapshot_id", "entity"], "full_outer"), min_rows)


def snapshot_flags(rows: DataFrame, extreme_pct: float = EXTREME_PCT, price_pct: float = PRICE_PCT, min_rows: int = MIN_ROWS, entity_price: Column | None = None) -> DataFrame:
    """All checks of all snapshots in one pass, a row for each snapshot: ``n_received, zero_coverage, rejected, extreme, price, coverage``, each snapshot compared with the one
    before it. ``rows`` is what :func:`row_errors` takes, with ``number`` and ``paid`` (compared with those of the series' snapshot before), ``paid_checked``, ``counted`` (whether the row
    counts for coverage). ``entity_price`` is an aggregate of an entity's rows in a snapshot, the largest of ``entity_price`` by default.

    The rows are dealt by entity once; series, entities and what each of them had before follow from that, and only the flags of an entity and snapshot, one row
    for both, are shuffled again. The rows of one entity, which are its periods by its snapshots, meet in one task."""
    series = Window.partitionBy("entity", "period_name").orderBy("snapshot_id")
    dealt = rows.repartition("entity").withColumns({"was_number": F.lag("number").over(series), "was_paid": F.lag("paid").over(series)})
    flags = {
        "extreme": change_pct(F.col("number"), F.col("was_number")) > extreme_pct,
        "outlier": F.col("paid_checked") & price_outlier(F.col("paid"), F.col("was_paid"), price_pct),
    }
    per = _by_entity(dealt, (F.max("entity_price") if entity_price is None else entity_price).alias("price"), F.count_if("counted").alias("n_new"), *[F.bool_or(c).alias(n) for n, c in flags.items()])
    past = Window.partitionBy("entity").orderBy("snapshot_id").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("n_old", F.last(F.when(F.col("n_new") > 0, F.col("n_new")), ignorenulls=True).over(past))
    per = per.withColumn("lost", (F.col("n_new") > 0) & coverage_lost(F.col("n_new"), F.col("n_old")))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return _verdict(per, min_rows, "extreme", "outlier", "lost").groupBy("snapshot_id").agg(
        F.count("*").alias("n_received"), any_of("zero_coverage").alias("zero_coverage"), any_of("rejected").alias("rejected"), any_of("extreme").alias("extreme"), any_of("outlier").alias("price"), any_of("lost").alias("coverage")
    )


def watchlist_diff(received: DataFrame, expected: DataFrame) -> DataFrame:
    """``entity, status``: received, missing or unexpected. Both sides have ``entity``."""
    a = expected.select("entity").distinct().withColumn("expected", F.lit(True))
    b = received.select("entity").distinct().withColumn("received", F.lit(True))
    status = F.when(F.col("received").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("received")
    return a.join(b, "entity", "full_outer").select("entity", status.alias("status"))


def last_known_good(rows: DataFrame, before: Column | None = None) -> DataFrame:
    """Per entity the rows of its newest snapshot with a usable value that did not fail. ``rows`` has ``snapshot_id, entity, value,
    failed`` and further columns."""
    usable = rows if before is None else rows.where(F.col("snapshot_id") < before)
    newest = usable.where(to_num(F.col("value")).isNotNull() & ~F.coalesce("failed", F.lit(False))).groupBy("entity").agg(F.max("snapshot_id").alias("snapshot_id"))
    return usable.join(newest, ["entity", "snapshot_id"], "left_semi")


def against_previous(rows: DataFrame, keys: tuple[str, ...] = ("entity", "period"), order: str = "snap_date") -> DataFrame:
    """Every row with the value of its own identity in the snapshot before; a new identity has none, whatever slot it shows in."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({f"previous_{c}": F.lag(c).over(w) for c in ("value", "price", order)})


def change_pct(value: Column, previous: Column) -> Column:
    return F.when(previous != 0, F.abs(value - previous) / F.abs(previous) * 100.0)


def extreme_changes(rows: DataFrame, threshold: float = EXTREME_PCT) -> DataFrame:
    """``rows`` with ``value`` and ``previous_value``: the changes over ``threshold`` percent."""
    return rows.withColumn("change_pct", change_pct(F.col("value"), F.col("previous_value"))).where(F.col("change_pct") > threshold)


def price_outliers(rows: DataFrame, threshold: float = PRICE_PCT) -> DataFrame:
    return rows.where(price_outlier(F.col("price"), F.col("previous_price"), threshold))


def coverage_lost(new: Column, old: Column) -> Column:
    """A sudden drop of usable periods by two or more, or to half of four or more."""
    return (old >= COVERAGE_DROP) & (new < old) & ((new <= old - COVERAGE_DROP) | ((old >= 4) & (new <= F.floor(old / 2))))


def coverage_regression(counts: DataFrame) -> DataFrame:
    """The rows of ``counts`` (``n_new`` and ``n_old`` usable periods) with :func:`coverage_lost`."""
    return counts.where(coverage_lost(F.col("n_new"), F.col("n_old")))


def timestamp_gate(snapshots: DataFrame, now: Column, backfill: bool = False) -> DataFrame:
    """``snapshots`` (collected_at, source_as_of, snapshot_utc as text) with ``ts_status`` and ``ts_reason``; NULL where all is well."""
    texts = [F.col(c) for c in ("collected_at", "source_as_of", "snapshot_utc")]
    times = [aware_timestamp_of(c) for c in texts]
    bad = [F.when(c.isNotNull() & t.isNull(), "invalid_snapshot_timestamp").when(t > now + F.expr(f"INTERVAL {FUTURE_MINUTES} MINUTES"), "future_snapshot_timestamp") for c, t in zip(texts, times, strict=True)]
    primary = F.coalesce(*[F.when(c.isNotNull(), t) for c, t in zip(texts, times, strict=True)])
    stale = F.when(F.lit(not backfill) & (primary < now - F.expr(f"INTERVAL {STALE_DAYS} DAYS")), "stale_snapshot_timestamp")
    reason = F.coalesce(*bad, stale)
    status = F.when(reason == "stale_snapshot_timestamp", "needs_verification").when(reason.isNotNull(), "reject")
    return snapshots.withColumns({"ts_status": status, "ts_reason": reason})


def gate_decision(flags: DataFrame) -> DataFrame:
    """The one decision per snapshot. ``flags``: ``n_received, n_missing, ts_status, ts_reason`` and booleans ``extreme, coverage, price,
    zero_coverage, rejected``. The first reason in this order decides; partial snapshots may be published."""
    reason = (
        F.when(F.col("n_received") == 0, "parser_zero_rows")
        .when(F.col("ts_reason").isNotNull(), F.col("ts_reason"))
        .when(F.col("extreme"), "extreme_eps_change")
        .when(F.col("coverage"), "fiscal_coverage_regression")
        .when(F.col("price"), "price_outlier")
        .when(F.col("zero_coverage"), "consensus_with_zero_analysts")
        .when(F.col("rejected"), "validation_failed")
        .when(F.col("n_missing") > 0, "missing_watchlist_tickers")
    )
    status = (
        F.when(reason.isNull(), "ok")
        .when(reason == "missing_watchlist_tickers", "partial")
        .when(reason.isin("parser_zero_rows", "validation_failed"), "reject")
        .when(reason == F.col("ts_reason"), F.col("ts_status"))
        .otherwise("needs_verification")
    )
    return flags.withColumn("reason", reason).withColumn("status", status).withColumn("publishable", F.col("status").isin("ok", "partial"))


def completeness(entities: DataFrame) -> DataFrame:
    """One row: complete, partial or failed, and its label. ``entities`` has ``collected`` per expected entity."""
    one = entities.agg(F.count_if("collected").alias("n_ok"), F.count("*").alias("n_expected"))
    status = F.when(F.col("n_ok") == 0, "failed").when(F.col("n_ok") < F.col("n_expected"), "partial").otherwise("complete")
    return one.withColumn("status", status).withColumn("label", F.when(F.col("status") == "partial", F.concat(F.lit("PARTIAL · "), "n_ok", F.lit("/"), "n_expected")).otherwise(F.upper("status")))


def filled_from_known_good(watch: DataFrame, current: DataFrame, prior: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A row per watched entity: the current values, else the prior ones with badge STALE, else a stub with badge FAILED. Filled and
    stub rows are flagged and never become observations. ``current`` and ``prior`` have one row per entity."""
    c = current.select("entity", F.lit(True).alias("has_current"), *[F.col(x).alias(f"current_{x}") for x in columns])
    p = prior.select("entity", F.lit(True).alias("has_prior"), *[F.col(x).alias(f"prior_{x}") for x in columns])
    both = watch.select("entity").join(c, "entity", "left").join(p, "entity", "left")
    badge = F.when(F.col("has_current"), F.lit(None).cast("string")).when(F.col("has_prior"), "STALE").otherwise("FAILED")
    values = [F.when(F.col("has_current"), F.col(f"current_{x}")).otherwise(F.col(f"prior_{x}")).alias(x) for x in columns]
    note = F.when(badge == "STALE", "last known good shown").when(badge == "FAILED", "no data")
    return both.select("entity", *values, badge.alias("badge"), note.alias("gap_note"), badge.isNotNull().alias("is_filled"))
