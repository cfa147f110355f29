"""Digests and extracted pages: first matching elements, provenance with tiers, extraction and policies for repeated rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fiscal import mapped_slot, normalized_period
from tidemark.functions.numbers import to_num
from tidemark.functions.urls import hostname, source_tier, suffixes

PAGE_JSON = "struct<rows:array<struct<fiscalPeriodEnding:string,consensus:string,high:string,low:string,analystCount:string,rev1M:string,rev3M:string,rev6M:string>>>"
# The id of the embedded block, and the cell classes of the table by field.
BLOCK_ID = "sa-estimates-json"
CELLS = {"consensus": "consensus", "high": "high", "low": "low", "analystCount": "analyst-count", "rev1M": "rev-1m", "rev3M": "rev-3m", "rev6M": "rev-6m"}
PAGE_FIELDS = ("consensus", "high", "low", "analystCount", "rev1M", "rev3M", "rev6M")


def first_match(items: Column, wanted: Callable[[Column], Column]) -> Column:
    """The first element of an array that fits, NULL without one."""
    return F.try_element_at(F.filter(items, wanted), F.lit(1))


def official_hosts(urls: DataFrame, domains: DataFrame) -> DataFrame:
    """``urls`` (``entity, url``) with ``host`` and ``official``: the host or a parent domain of it is on the entity's own list, or on any list
    where the entity is unknown. Hosts are opened into their suffixes, so that the allow list joins by equality; it's left to the
    optimizer whether its measured size is broadcast."""
    rows = urls.withColumn("host", hostname(F.col("url")))
    listed = domains.select(F.upper("entity").alias("list_entity"), F.rtrim(F.lower("domain"), F.lit(".")).alias("suffix")).distinct()
    hits = rows.select(F.upper("entity").alias("entity_key"), "host").distinct().where("host is not null").select("entity_key", "host", F.explode(suffixes(F.col("host"))).alias("suffix"))
    found = hits.join(listed, "suffix").where(F.col("entity_key").isNull() | (F.col("entity_key") == F.col("list_entity"))).select(F.coalesce("entity_key", F.lit("")).alias("k"), F.col("host").alias("h")).distinct().withColumn("official", F.lit(True))
    joined = rows.join(found, (F.coalesce(F.upper("entity"), F.lit("")) == F.col("k")) & (F.col("host") == F.col("h")), "left")
    return joined.drop("k", "h").withColumn("official", F.coalesce("official", F.lit(False)))


def tiered(urls: DataFrame, domains: DataFrame) -> DataFrame:
    """``urls`` (``entity, url, declared``) with ``tier``."""
    return official_hosts(urls, domains).withColumn("tier", source_tier(F.col("url"), F.col("declared"), F.col("official")))


def provenance(digests: DataFrame, domains: DataFrame) -> DataFrame:
    """Digest actuals and the comparison with their own source and tier each. ``digests``: ``entity, sources`` (array of structs ``title, url, kind``),
    ``actuals_url, comparison_url``; the comparison falls back to the first aggregator source, the actuals to the first other one."""
    aggregator = lambda s: s["kind"] == "seeking_alpha"
    rows = digests.withColumns(
        {
            "actual_source": F.coalesce("actuals_url", first_match(F.col("sources"), lambda s: ~F.coalesce(aggregator(s), F.lit(False)))["url"]),
            "compared_source": F.coalesce("comparison_url", first_match(F.col("sources"), aggregator)["url"]),
        }
    )
    both = rows.select("entity", F.explode(F.array(F.struct(F.lit("actuals").alias("part"), F.col("actual_source").alias("url")), F.struct(F.lit("comparison").alias("part"), F.col("compared_source").alias("url")))).alias("x"))
    return tiered(both.select("entity", "x.part", "x.url", F.lit(None).cast("string").alias("declared")), domains).select("entity", "part", "url", "tier")


def has_content(digests: DataFrame, lists: tuple[str, ...], texts: tuple[str, ...]) -> DataFrame:
    """``digests`` with ``has_content``: any of the lists has an element or any of the texts a word."""
    parts = [F.coalesce(F.size(c) > 0, F.lit(False)) for c in lists] + [F.coalesce(F.trim(c) != "", F.lit(False)) for c in texts]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole | p
    return digests.withColumn("has_content", whole)


def extracted_estimates(pages: DataFrame, html: str = "html") -> DataFrame:
    """Estimate rows of web pages, whole and in parallel: the embedded JSON block where there is one, else the rows of the table. Columns of
    ``pages`` with ``place, fiscal_period`` and the text of each field."""
    quote = "[\"']"
    block = F.nullif(F.trim(F.regexp_extract(html, rf"(?is)<script[^>]*id={quote}{BLOCK_ID}{quote}[^>]*>(.*?)</script>", 1)), F.lit(""))
    rows = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)(<tr[^>]*data-period={quote}.*?</tr>)"), 1)
    cell = lambda r, name: F.nullif(F.trim(F.regexp_extract(r, rf"(?is)<td[^>]*class={quote}[^\"']*{name}[^\"']*{quote}[^>]*>([^<]*)<", 1)), F.lit(""))
    parsed = F.from_json(block, PAGE_JSON)["rows"]
    period = lambda r: F.coalesce(cell(r, "fiscal-period-ending"), F.regexp_extract(r, rf"(?is)data-period={quote}([^\"']*)", 1))
    table = F.transform(rows, lambda r: F.struct(period(r).alias("fiscalPeriodEnding"), *[cell(r, CELLS[n]).alias(n) for n in PAGE_FIELDS]))
    found = F.when(F.coalesce(F.size(parsed) > 0, F.lit(False)), parsed).otherwise(table)
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("place", "row")).select(
        *[c for c in pages.columns if c != html], "place", F.col("row.fiscalPeriodEnding").alias("fiscal_period"), *[F.col(f"row.{n}").alias(n) for n in PAGE_FIELDS]
    )


def repeated_row_policy(rows: DataFrame) -> DataFrame:
    """Per page (``entity``): exact repeats are dropped; the first violation by ``seq`` decides: two payloads for one period, or two periods
    in one display slot. Returns ``entity, n_rows, n_kept, violation``."""
    rows = rows.withColumn("period", normalized_period(F.col("fiscal_period"))).withColumn("slot", mapped_slot(F.col("period")))
    signal = F.concat_ws("|", *[F.coalesce(to_num(F.col(c)).cast("string"), F.lit("")) for c in PAGE_FIELDS if c in rows.columns])
    periods = rows.groupBy("entity", "period", "slot").agg(F.count_distinct(signal).alias("k"), F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    slots = periods.where("slot is not null").groupBy("entity", "slot").agg(F.count_distinct("period").alias("k"), F.max("first_seq").alias("at"))
    bad = periods.where("k > 1").select("entity", F.col("first_seq").alias("at"), F.lit("duplicate_conflicting_fiscal_row").alias("violation")).unionByName(slots.where("k > 1").select("entity", "at", F.lit("mapped_slot_collision").alias("violation")))
    first = bad.groupBy("entity").agg(F.min_by("violation", F.struct("at", "violation")).alias("violation"))
    return periods.groupBy("entity").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_kept")).join(first, "entity", "left")
