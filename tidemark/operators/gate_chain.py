"""The quality gate over many snapshots at once.

A snapshot is compared with what the last publishable ones before it left, and whether those are publishable depends on the ones before them. All snapshots are
decided together, in rounds: in each round every series, and every entity, goes through its own snapshots in order, and is not carried over one that the round
before refused or that it refuses itself; whatever any of them refuses is refused. Rounds go on until no decision changes. A decision is final once all before
it are, so the rounds end, and with the decisions that taking the snapshots one after the other gives. A long run of refusals is found in one round, since it
comes from the same series; a further round is needed where one series' refusal changes what another one is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ids import event_id
from tidemark.functions.numbers import price_outlier, revision_pct, same_value
from tidemark.operators import quality

#: Sorts before every name: what is known before the first snapshot.
BEFORE = ""


def by_identity(rows: DataFrame, good: DataFrame | None) -> DataFrame:
    """One row for each snapshot, entity and period with the range of its values, and ``carry`` (value, coverage, price, origin), what it leaves if it is publishable.
    ``rows``: ``snapshot_id, entity, period, value, coverage, price, valid``; of several valid values the largest is carried. ``good``: ``entity, period, value, price,
    snapshot_id``, the state before."""
    carry = F.max(F.when(F.col("valid"), F.struct("value", "coverage", "price", F.col("snapshot_id").alias("origin")))).alias("carry")
    made = rows.where("period IS NOT NULL AND value IS NOT NULL").groupBy("snapshot_id", "entity", "period").agg(F.min("value").alias("low"), F.max("value").alias("high"), carry)
    if good is None:
        return made
    state = F.struct("value", F.lit(None).cast("double").alias("coverage"), "price", F.col("snapshot_id").alias("origin")).alias("carry")
    nothing = F.lit(None).cast("double")
    return made.unionByName(good.select(F.lit(BEFORE).alias("snapshot_id"), "entity", "period", nothing.alias("low"), nothing.alias("high"), state))


def by_entity(entities: DataFrame, series: DataFrame) -> DataFrame:
    """One row for each snapshot and entity: ``price, n_usable`` and ``carry`` (price, n), the price and number of usable periods that it leaves. Of the state before
    the newest snapshot of each entity counts."""
    left = series.where("carry IS NOT NULL").groupBy("snapshot_id", "entity", F.coalesce("carry.origin", F.lit(BEFORE)).alias("origin")).agg(F.max("carry.price").alias("price"), F.count("*").alias("n"))
    left = left.groupBy("snapshot_id", "entity").agg(F.max_by(F.struct("price", "n"), "origin").alias("carry"))
    return entities.select("snapshot_id", "entity", "price", "n_usable").join(left, ["snapshot_id", "entity"], "full_outer")


def _refusals(rows: DataFrame, keys: tuple[str, ...], kind: str, checks: dict) -> DataFrame:
    """``snapshot_id, name`` for each check that a snapshot fails. ``rows`` has ``snapshot_id, held, carry`` (of the type ``kind``) and what the checks read; a check
    is a function of a row and the carried value. The snapshots of one series, a row each, are one array."""
    found = "array<struct<snapshot_id:string,name:string>>"

    def step(state, row):
        failed = {n: F.coalesce(check(row, state["past"]), F.lit(False)) for n, check in checks.items()}
        any_failed = F.greatest(*failed.values(), F.lit(False))
        named = F.array_compact(F.array(*[F.when(f, F.struct(row["snapshot_id"].alias("snapshot_id"), F.lit(n).alias("name"))) for n, f in failed.items()]))
        past = F.when(row["held"] & ~any_failed & row["carry"].isNotNull(), row["carry"]).otherwise(state["past"])
        return F.struct(past.cast(kind).alias("past"), F.concat(state["found"], named).cast(found).alias("found"))

    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("snapshot_id", "held", *[c for c in rows.columns if c not in (*keys, "snapshot_id", "held")]))).alias("rows"))
    start = F.struct(F.lit(None).cast(kind).alias("past"), F.array().cast(found).alias("found"))
    return listed.select(F.explode(F.aggregate("rows", start, step)["found"]).alias("f")).select("f.*")


def _compared(series: DataFrame, entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Which snapshots have an extreme change, a lost coverage or a price outlier, after ``decisions`` of the round before."""
    last = decisions.select("snapshot_id", F.col("publishable").alias("held"))

    def held(df: DataFrame) -> DataFrame:
        return df.join(last, "snapshot_id", "left").withColumn("held", F.coalesce("held", F.lit(True)))  # the state before has no decision

    pct = lambda row, past: F.greatest(quality.change_pct(row["low"], past), quality.change_pct(row["high"], past)) > quality.EXTREME_PCT
    values = _refusals(held(series.withColumn("carry", F.col("carry.value"))), ("entity", "period"), "double", {"extreme": pct})
    checks = {
        "price": lambda row, past: price_outlier(row["price"], past["price"], quality.PRICE_PCT),
        "coverage": lambda row, past: quality.coverage_lost(row["n_usable"], past["n"]),
    }
    prices = _refusals(held(entities), ("entity",), "struct<price:double,n:bigint>", checks)
    return values.unionByName(prices).groupBy("snapshot_id").agg(*[F.bool_or(F.col("name") == n).alias(n) for n in ("extreme", "price", "coverage")])


def decided(flags: DataFrame, series: DataFrame, entities: DataFrame, work: str) -> DataFrame:
    """``flags`` (a row for each snapshot, with all that :func:`quality.gate_decision` needs but the comparisons) with the comparisons and the decision. ``series`` and
    ``entities`` are those of :func:`by_identity` and :func:`by_entity`. Each round's decisions are a table below the folder ``work``."""
    spark, names = flags.sparkSession, ("extreme", "price", "coverage")
    made, k, before = quality.gate_decision(flags.withColumns({n: F.lit(False) for n in names})), 0, None
    while True:
        made.write.mode("overwrite").parquet(f"{work}/round={k}")
        now = spark.read.parquet(f"{work}/round={k}")
        if before is not None:
            other = before.select("snapshot_id", F.col("publishable").alias("was"))
            if now.join(other, "snapshot_id").where("publishable <> was").isEmpty():
                return now
        compared = flags.join(_compared(series, entities, now), "snapshot_id", "left").fillna(False, list(names))
        made, before, k = quality.gate_decision(compared), now, k + 1


def left_behind(series: DataFrame, decisions: DataFrame) -> DataFrame:
    """What the publishable snapshots leave, in order: ``snapshot_id, entity, period, value, coverage, price, origin, previous`` (the value before) and ``stamp``. The
    state before is among the rows, as snapshot :data:`BEFORE`."""
    stamp = F.coalesce(F.nullif(F.col("collected_at"), F.lit("")), F.col("snapshot_utc")).alias("stamp")
    known = series.where("carry IS NOT NULL").join(decisions.select("snapshot_id", "publishable", stamp), "snapshot_id", "left").where(F.coalesce("publishable", F.lit(True)))
    w = Window.partitionBy("entity", "period").orderBy("snapshot_id")
    return known.select("snapshot_id", "entity", "period", "carry.*", "stamp").withColumn("previous", F.lag("value").over(w))


def revisions(left: DataFrame) -> DataFrame:
    """The revision events of :func:`left_behind`'s rows."""
    changed = left.where((F.col("snapshot_id") != BEFORE) & (F.col("previous").isNull() | ~same_value(F.col("value"), F.col("previous"))))
    kind = F.when(F.col("previous").isNull(), "baseline").when(F.col("value") > F.col("previous"), "upgrade").otherwise("downgrade")
    ident = event_id(F.col("entity"), F.col("period"), F.col("previous"), F.col("value"), F.col("stamp"))
    return changed.select(ident.alias("event_id"), "entity", "period", "previous", "value", revision_pct(F.col("previous"), F.col("value")).alias("pct"), kind.alias("kind"), F.col("stamp").alias("update_time"))


def state(left: DataFrame) -> DataFrame:
    """The state after all of them: ``entity, period, value, price, snapshot_id``."""
    last = F.max_by(F.struct("value", "price", F.col("origin").alias("snapshot_id")), "snapshot_id").alias("last")
    return left.groupBy("entity", "period").agg(last).select("entity", "period", "last.*")
