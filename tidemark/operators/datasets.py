"""Composite datasets over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fiscal, labels, text
from tidemark.functions.numbers import dispersion, display_text, to_num
from tidemark.operators import alerts


def periods(rows: DataFrame) -> DataFrame:
    """Typed display periods of flat snapshot rows (``snapshot_id, entity, slot, label`` and raw texts)."""
    n = lambda c: to_num(F.col(c))
    label = display_text(F.col("label"))
    return rows.select(
        "snapshot_id", "entity", "slot", label.alias("label"), fiscal.normalized_period(label).alias("period"), n("value").alias("value"), n("high").alias("high"), n("low").alias("low"), n("coverage").alias("coverage"),
        dispersion(n("high"), n("low"), n("value")).alias("dispersion"), n("rev_1m").alias("rev_1m"), n("rev_3m").alias("rev_3m"), n("rev_6m").alias("rev_6m"), F.coalesce(fiscal.fiscal_equals_calendar(label), F.lit(False)).alias("fiscal_equals_calendar"),
    )


def companies(rows: DataFrame, entities: DataFrame, years: list[str]) -> DataFrame:
    """One wide row per snapshot and entity: price and after-hours price, next event, momentum and regime from the second and third display
    year's one-month revisions, and a value column per display year. ``entities``: ``snapshot_id, entity, price, price_as_of, next_earnings, data_gaps``."""
    typed = periods(rows)
    wide = typed.groupBy("snapshot_id", "entity").agg(
        *[F.max(F.when(F.col("slot") == y, F.col("value"))).alias(f"value_{y}") for y in years],
        F.max(F.when(F.col("slot") == years[1], F.col("rev_1m"))).alias("near"),
        F.max(F.when(F.col("slot") == years[2], F.col("rev_1m"))).alias("far"),
    )
    out = entities.join(wide, ["snapshot_id", "entity"], "left")
    return out.select(
        "snapshot_id", "entity", to_num(F.col("price")).alias("last_close"), text.after_hours_price(F.col("price_as_of")).alias("after_hours"),
        text.event_display(F.col("next_earnings"), F.lit("estimated")).alias("next_event"), text.event_session(F.col("next_earnings")).alias("session"),
        labels.momentum(F.col("near"), F.col("far")).alias("momentum"), labels.revision_regime(F.col("near"), F.col("far")).alias("regime"),
        labels.collection_failed(F.col("data_gaps")).alias("collection_failed"), *[f"value_{y}" for y in years],
    )


def mapping_audit(rows: DataFrame) -> DataFrame:
    """How each period came to its display year: ``entity, period, value, slot, rule``."""
    month = fiscal.period_month(F.col("period"))
    rule = F.when(month.isNull(), "unmapped").when(month <= 3, "January to March: prior year").when(month == 12, "calendar year").otherwise("ending year")
    return rows.select("entity", "period", "value", fiscal.mapped_slot(F.col("period")).alias("slot"), rule.alias("rule"))


def revision_browser(events: DataFrame, entity: str | None = None, slot: str | None = None, date: str | None = None) -> DataFrame:
    """Revision events filtered by any of entity, slot and date; to be shown newest first (by ``seq``)."""
    for column, wanted in (("entity", entity), ("slot", slot), ("date", date)):
        if wanted is not None:
            events = events.where(F.col(column) == wanted)
    return events


def event_dates(events: DataFrame) -> DataFrame:
    return events.select("date").distinct()


def summary_values(rows: DataFrame, today: Column) -> DataFrame:
    """The last value of each series with its age in days."""
    newest = Window.partitionBy("entity", "period").orderBy(F.desc("obs_date"), F.desc("seq"))
    last = rows.withColumn("n", F.row_number().over(newest)).where("n = 1")
    return last.select("entity", "period", "obs_date", "value", F.datediff(today, F.col("obs_date")).alias("age_days"))


def evaluate(rules: dict[str, Callable[[], DataFrame]], history: DataFrame, previous: DataFrame, now: Column, folder: str | None = None) -> tuple[DataFrame, DataFrame, list[tuple[str, str, str]]]:
    """All alert rules of a run: generated alerts, deduplicated, merged into the history; the active ones; and a status per rule.

    A rule that fails keeps its alerts of ``previous`` and is reported, so one bad source never empties the others. Without a ``folder`` this
    holds for rules that fail to plan. With one (shared by all executors, new for each run) every rule's rows are written below it first,
    so that a rule which fails while it runs is kept apart as well. Rules give
    ``id, rule, status, lifecycle, pct, created_at, opened_at, event_at, seq``."""
    columns = ["id", "rule", "status", "lifecycle", "pct", "created_at", "opened_at", "event_at", "seq"]
    made, report = None, []
    for name, rule in rules.items():
        try:
            rows = rule().select(*columns)
            if folder is not None:
                path = f"{folder.rstrip('/')}/{len(report)}"
                rows.write.mode("overwrite").parquet(path)
                rows = history.sparkSession.read.schema(rows.schema).parquet(path)
            report.append((name, "ok", ""))
        except Exception as error:
            rows = previous.where(F.col("rule") == name).select(*columns)
            report.append((name, "error", str(error).split("\n", 1)[0][:200]))
        made = rows if made is None else made.unionByName(rows)
    merged = alerts.upsert(history, alerts.first_by_id(made))
    return merged, alerts.active(merged.withColumns({"expires_at": F.lit(None).cast("timestamp"), "one_shot": F.lit(False)}), now), report
