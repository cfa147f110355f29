"""Append-only histories: admission, conflicts, merging, reconciliation and change capture.

An observation's identity is ``entity, period, obs_date, update_time``; its payload is ``value`` and ``coverage``. Two rows with the same
identity and payload are one observation; the same identity with different payloads is a conflict, and no row of it wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import missing_update_time, month_key, strict_date_of
from tidemark.functions.fiscal import entity_key, looks_like_slot, month_name, period_month, period_year
from tidemark.functions.ids import content_hash
from tidemark.functions.numbers import revision_pct, same_value, to_num, whole_count
from tidemark.operators.slices import running_last

IDENTITY = ("entity", "period", "obs_date", "update_time")
PAYLOAD = ("value", "coverage")
OBSERVATION = (*IDENTITY, *PAYLOAD)
#: Fixed value: rows of this source are seeds and never observations.
SEED_SOURCES = ("revision_history_seed",)


class ConflictError(ValueError):
    """A write met one identity with two payloads."""


def canonical_columns(raw: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """``raw`` with one column per name of ``aliases``: the first alias that isn't blank. Missing columns count as blank."""

    def first(names: tuple[str, ...]) -> Column:
        there = [F.when(F.trim(F.col(f"`{n}`").cast("string")) != "", F.col(f"`{n}`").cast("string")) for n in names if n in raw.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    return raw.select("*", *[first(names).alias(f"c_{name}") for name, names in aliases.items()])


ALIASES = {
    "entity": ("entity", "ticker", "Ticker"),
    "period": ("reportedFiscalPeriodEnding", "reportedFiscalLabel", "fiscalKey", "Fiscal Year", "reported_fiscal_label", "fiscalPeriodEnding", "period"),
    "value": ("consensus", "eps", "value"),
    "coverage": ("analysts", "analystCount", "coverage"),
    "update_time": ("updateTime", "Update Time", "update_time"),
    "date": ("date", "Date"),
    "slot": ("mappedYear", "slot"),
    "source": ("source",),
    "failed": ("collectionFailed", "usingLastKnownGood"),
}


def classified(raw: DataFrame) -> DataFrame:
    """``raw`` with the canonical columns and ``reject_reason``, the first reason that applies (NULL: admitted)."""
    rows = canonical_columns(raw, ALIASES)
    c = lambda n: F.col(f"c_{n}")
    # each parsed once, by a generator: the optimizer would push filters on what follows below a projection, and parse again there
    parsed = {
        "p_month": period_month(c("period")),
        "p_year": period_year(c("period")),
        "p_value": to_num(c("value")),
        "p_coverage": to_num(c("coverage")),
        "p_date": strict_date_of(F.substring(F.trim(c("date")), 1, 10)),
        "p_entity": entity_key(c("entity")),
        "p_slot": looks_like_slot(c("period")),
    }
    rows = rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in parsed.items()]))))
    no_period, day = c("period").isNull() | F.col("p_slot"), F.col("p_date")
    reason = (
        F.when(F.coalesce(c("source").isin(*SEED_SOURCES), F.lit(False)), "seed_from_revision_history")
        .when(F.coalesce(F.lower(c("failed")) == "true", F.lit(False)), "collection_failed_or_lkg")
        .when(no_period & (c("slot").isNotNull() | F.col("p_slot")), "mapped_year_not_identity")
        .when(no_period, "invalid_fiscal_identity")
        .when(F.col("p_value").isNull(), "invalid_consensus")
        .when(day.isNull(), "invalid_date")
        .when(F.col("p_entity").isNull() | F.col("p_month").isNull(), "rejected_by_canonical_admission")
    )
    period = F.when(F.col("p_month").isNotNull(), F.concat_ws(" ", month_name(F.col("p_month")), F.col("p_year").cast("string"))).otherwise(F.trim(c("period")))
    update = F.coalesce(F.trim(c("update_time")), missing_update_time(day))
    made = {"entity": F.col("p_entity"), "period": period, "obs_date": day, "update_time": update, "value": F.col("p_value"), "coverage": whole_count(F.col("p_coverage"))}
    return rows.select(*[F.col(x) for x in raw.columns if x not in made], *[v.alias(k) for k, v in made.items()], F.col("c_update_time").isNotNull().alias("had_update_time"), reason.alias("reject_reason"))


def admitted(raw: DataFrame) -> DataFrame:
    return classified(raw).where("reject_reason is null").select(*OBSERVATION)


def rejected(raw: DataFrame) -> DataFrame:
    return classified(raw).where("reject_reason is not null")


def fingerprint() -> Column:
    return content_hash(*PAYLOAD)


def payload_hash() -> Column:
    """A number for each payload, to tell several payloads of one identity by its least and its largest, without a second shuffle."""
    return F.xxhash64(*[x for c in PAYLOAD for x in (F.col(c), F.col(c).isNull())])


def identity_groups(rows: DataFrame) -> DataFrame:
    """Per identity that occurs more than once: row count, distinct payloads, and whether they conflict or repeat exactly."""
    groups = rows.withColumn("payload", fingerprint()).groupBy(*IDENTITY).agg(F.count("*").alias("n_rows"), F.count_distinct("payload").alias("n_payloads"))
    kind = F.when(F.col("n_payloads") > 1, "conflict").otherwise("exact_duplicate")
    return groups.where("n_rows > 1").withColumn("kind", kind)


def source_stats(tagged: DataFrame) -> DataFrame:
    """Per ``source_name``: raw, valid, rejected, distinct, repeated and conflicting identities, missing update times, first and last
    date. ``tagged`` is a classified table with ``source_name``."""
    valid = F.col("reject_reason").isNull()
    counts = tagged.groupBy("source_name").agg(
        F.count("*").alias("n_raw"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(~valid).alias("n_rejected"),
        F.count_if(valid & ~F.col("had_update_time")).alias("n_missing_update_time"),
        F.min(F.when(valid, F.col("obs_date"))).alias("earliest"),
        F.max(F.when(valid, F.col("obs_date"))).alias("latest"),
    )
    ids = tagged.where(valid).withColumn("payload", fingerprint()).groupBy("source_name", *IDENTITY).agg(F.count("*").alias("n"), F.count_distinct("payload").alias("k"))
    per = ids.groupBy("source_name").agg(F.count("*").alias("n_identities"), F.count_if((F.col("n") > 1) & (F.col("k") == 1)).alias("n_duplicate_ids"), F.count_if(F.col("k") > 1).alias("n_conflict_ids"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_identities", "n_duplicate_ids", "n_conflict_ids")}
    return counts.join(per, "source_name", "left").withColumns(zero)


def reject_histogram(tagged: DataFrame) -> DataFrame:
    return tagged.where("reject_reason is not null").groupBy("source_name", "reject_reason").agg(F.count("*").alias("n"))


def entity_ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.min("obs_date").alias("earliest"), F.max("obs_date").alias("latest"))


def conflicts_between(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Identities that would have two payloads after a merge."""
    both = existing.select(*OBSERVATION).unionByName(incoming.select(*OBSERVATION))
    return identity_groups(both).where("kind = 'conflict'")


def new_observations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What an idempotent merge adds: incoming rows of identities that aren't there, once each."""
    return incoming.select(*OBSERVATION).dropDuplicates(list(IDENTITY)).join(existing.select(*IDENTITY), list(IDENTITY), "left_anti")


def idempotent_merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing and new rows, from one aggregate by identity; a replay adds nothing. An identity with several payloads makes every action on
    the result fail, so that nothing of it can be written; :func:`conflicts_between` lists them."""
    side = lambda df, n: df.select(*OBSERVATION, F.lit(n).alias("side"), payload_hash().alias("payload"))
    groups = side(existing, 0).unionByName(side(incoming, 1)).groupBy(*IDENTITY).agg(
        F.count_if(F.col("side") == 0).alias("n_there"), F.min("payload").alias("least"), F.max("payload").alias("most"), *[F.first(c).alias(c) for c in PAYLOAD]
    )
    told = F.concat(F.lit("identity with several payloads: "), F.to_json(F.struct(*IDENTITY)))
    good = groups.where(F.when(F.col("least") == F.col("most"), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    times = F.array_repeat(F.lit(0), F.greatest("n_there", F.lit(1)).cast("int"))  # rows that are there twice stay so
    return good.select(*OBSERVATION, F.explode(times).alias("time")).drop("time")


def reconcile(tagged: DataFrame, canonical: str = "canonical") -> DataFrame:
    """The plan of a multi-source reconciliation, a row per identity over all sources (``source_name, priority``): the kept payload
    is that of the least priority, then name. ``action`` is conflict (nothing kept), existing, or add. It doesn't depend on the
    order of sources."""
    keyed = tagged.where("reject_reason is null").withColumn("payload", payload_hash())
    rank = F.struct("priority", "source_name")
    groups = keyed.groupBy(*IDENTITY).agg(
        F.count("*").alias("n_rows"),
        (F.min("payload") == F.max("payload")).alias("kept"),
        F.min_by(F.struct(*PAYLOAD, "source_name"), rank).alias("keeper"),
        F.bool_or(F.col("source_name") == canonical).alias("is_existing"),
    )
    action = F.when(~F.col("kept"), "conflict").when(F.col("is_existing"), "existing").otherwise("add")
    return groups.select(*IDENTITY, "n_rows", action.alias("action"), *[F.when(F.col("kept"), F.col(f"keeper.{c}")).alias(c) for c in (*PAYLOAD, "source_name")])


def reconcile_report(plan: DataFrame) -> DataFrame:
    """One row: identities by action, exact duplicates dropped, and whether the plan may be applied."""
    n = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(
        n("add").alias("n_new"), n("existing").alias("n_existing"), n("conflict").alias("n_conflicts"), F.coalesce(F.sum(F.when(F.col("action") != "conflict", F.col("n_rows") - 1)), F.lit(0)).alias("n_duplicates")
    ).withColumn("applicable", F.col("n_conflicts") == 0)


def month_fingerprints(rows: DataFrame) -> DataFrame:
    """Per month a count and an order-free sum of row hashes; partial sums combine before the shuffle."""
    h = F.xxhash64(*sorted(OBSERVATION)).cast("decimal(38,0)")
    return rows.withColumn("month", month_key(F.col("obs_date"))).groupBy("month").agg(F.count("*").alias("n"), F.sum(h).alias("fingerprint"))


def touched_months(before: DataFrame, after: DataFrame) -> DataFrame:
    """Months whose content differs, with the row counts of both sides."""
    a = month_fingerprints(before).select("month", F.col("n").alias("n_before"), F.col("fingerprint").alias("fa"))
    b = month_fingerprints(after).select("month", F.col("n").alias("n_after"), F.col("fingerprint").alias("fb"))
    return a.join(b, "month", "full_outer").where(~F.col("fa").eqNullSafe(F.col("fb")) | ~F.col("n_before").eqNullSafe(F.col("n_after"))).select("month", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def dataset_fingerprint(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row that stays the same under any order of rows: their number and a hash over it and the sum of row hashes."""
    h = F.xxhash64(*sorted(columns or rows.columns)).cast("decimal(38,0)")
    total = rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias("total"))
    return total.select("n_rows", F.sha2(F.concat_ws("|", "n_rows", "total"), 256).alias("fingerprint"))


def missing_at_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Observations that are here and, with the same payload, not there."""
    return local.select(*OBSERVATION).withColumn("payload", fingerprint()).join(remote.withColumn("payload", fingerprint()).select(*IDENTITY, "payload"), [*IDENTITY, "payload"], "left_anti").drop("payload")


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, as many times as it has them more, with ``side``. One aggregate over both."""
    both, columns = a.select("*", F.lit(1).alias("_more")).unionByName(b.select("*", F.lit(-1).alias("_more"))), a.columns
    more = both.groupBy(*columns).agg(F.sum("_more").alias("_more")).where("_more <> 0")
    return more.select(*columns, F.when(F.col("_more") > 0, "left").otherwise("right").alias("side"), F.explode(F.sequence(F.lit(1), F.abs("_more"))).alias("_copy")).drop("_copy")


def leaf_of(rows: DataFrame) -> DataFrame:
    """``rows`` with their leaf of the hash tree: ``month`` and ``bucket``, one of 256 by entity."""
    return rows.withColumns({"month": month_key(F.col("obs_date")), "bucket": F.substring(F.md5(F.coalesce("entity", F.lit("")).cast("binary")), 1, 2)})


def hash_tree(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The leaves of a hash tree: ``month, bucket, n, fingerprint``, a row for each, to be stored beside the table. A leaf's fingerprint is the sum of its rows' hashes, so the one
    of a month, or of all, is the sum of its leaves' and partial sums combine before the shuffle."""
    h = F.xxhash64(*sorted(columns or rows.columns)).cast("decimal(38,0)")
    return leaf_of(rows.withColumn("h", h)).groupBy("month", "bucket").agg(F.count("*").alias("n"), F.sum("h").alias("fingerprint"))


def differing_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """The leaves in which two hash trees differ, ``month, bucket, n_before, n_after``, looked for in months that differ only."""
    sums = (F.sum("n").alias("n"), F.sum("fingerprint").alias("fingerprint"))

    def other(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        left = a.select(*keys, F.col("n").alias("n_before"), F.col("fingerprint").alias("fa"))
        right = b.select(*keys, F.col("n").alias("n_after"), F.col("fingerprint").alias("fb"))
        same = F.col("n_before").eqNullSafe(F.col("n_after")) & F.col("fa").eqNullSafe(F.col("fb"))
        return left.join(right, keys, "full_outer").where(~same).select(*keys, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))

    months = other(before.groupBy("month").agg(*sums), after.groupBy("month").agg(*sums), ["month"]).select("month")
    return other(before.join(months, "month", "left_semi"), after.join(months, "month", "left_semi"), ["month", "bucket"])


def differences_in(before: DataFrame, after: DataFrame, leaves: DataFrame) -> DataFrame:
    """:func:`table_differences` of the rows in ``leaves`` only, with ``month`` and ``bucket``. Of a table that is kept by ``month`` the other months are not read."""
    keys = leaves.select("month", "bucket")
    cut = lambda df: leaf_of(df).join(keys, ["month", "bucket"], "left_semi")
    return table_differences(cut(before), cut(after))


def change_events(rows: DataFrame, order: tuple[str, ...] = ("obs_date", "seq")) -> DataFrame:
    """Revision events of each series in order: a baseline first, nothing while the value stays, else change, percentage and
    direction. ``rows`` has ``entity, period, value`` and the order columns. A series is worked on by slices of its order."""
    rows = running_last(rows.where("value is not null"), ("entity", "period"), order, {"previous": "value"}, before=True)
    rows = rows.where(F.col("previous").isNull() | ~same_value(F.col("value"), F.col("previous")))
    change = F.col("value") - F.col("previous")
    kind = F.when(F.col("previous").isNull(), "baseline").when(change > 0, "upgrade").otherwise("downgrade")
    return rows.select("entity", "period", *order, "previous", "value", change.alias("change"), revision_pct(F.col("previous"), F.col("value")).alias("pct"), kind.alias("kind"))


def change_only(rows: DataFrame) -> DataFrame:
    """Rows that differ from the one before of their series and day; a value that comes back is kept again."""
    w = Window.partitionBy("entity", "period", "obs_date").orderBy("seq")
    before = F.lag("value").over(w)
    first = F.row_number().over(w) == 1
    return rows.withColumns({"first_of_day": first, "before": before}).where(F.col("first_of_day") | ~same_value(F.col("value"), F.col("before"))).drop("first_of_day", "before")


def last_write(rows: DataFrame, keys: tuple[str, ...] = ("entity", "period", "obs_date")) -> DataFrame:
    """The last append of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("last")).select(*keys, "last.*")


def canonical_order(rows: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("obs_date", "entity", "period", "update_time")] + ([F.col("seq")] if "seq" in rows.columns else [])


def known_ids(rows: DataFrame, column: str = "event_id") -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def with_previous(current: DataFrame, known_good: DataFrame, events: DataFrame) -> DataFrame:
    """``current`` (``entity, period, value``) with the value before it: the last known good one of its identity, else the last one the event log
    has. ``kind``: baseline for an identity that neither knows, none where an identity is known without a value, else the direction."""
    good = known_good.select("entity", "period", F.col("value").alias("good_value"), F.lit(True).alias("in_good"))
    last = events.groupBy("entity", "period").agg(F.max_by("current_value", "seq").alias("event_value")).withColumn("in_events", F.lit(True))
    rows = current.join(good, ["entity", "period"], "left").join(last, ["entity", "period"], "left")
    previous = F.coalesce("good_value", "event_value")
    known = F.coalesce(F.col("in_good"), F.col("in_events"), F.lit(False))
    change = F.col("value") - F.col("previous")
    kind = (
        F.when(~F.col("known"), "baseline").when(F.col("previous").isNull(), "none").when(same_value(F.col("value"), F.col("previous")), "none").when(change > 0, "upgrade").otherwise("downgrade")
    )
    rows = rows.withColumns({"previous": previous, "known": known})
    return rows.select(*current.columns, "previous", kind.alias("kind"))
