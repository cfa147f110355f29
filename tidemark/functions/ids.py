"""Stable identifiers and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import to_num


def id_part(value: Column) -> Column:
    given = F.trim(value.cast("string"))
    s = F.regexp_replace(given, r"\s+", "_")
    s = F.substring(F.replace(F.replace(s, F.lit(":"), F.lit("_")), F.lit("/"), F.lit("-")), 1, 80)
    return F.coalesce(F.when(given != "", s), F.lit("na"))  # what is replaced stays as long or keeps a character, so the pattern is tried once


def alert_id(*parts: Column) -> Column:
    """Rule, entity, period, date and key, joined by colons."""
    return F.concat_ws(":", *[id_part(p) for p in parts])


def number_token(value: Column) -> Column:
    """Six decimals for a number, the trimmed text otherwise, ``null`` for nothing."""
    return F.coalesce(F.when(to_num(value).isNotNull(), F.format_string("%.6f", to_num(value))), F.trim(value.cast("string")), F.lit("null"))


def event_id(entity: Column, period: Column, previous: Column, current: Column, update_time: Column) -> Column:
    parts = [F.upper(F.coalesce(entity, F.lit(""))), F.trim(F.coalesce(period, F.lit(""))), number_token(previous), number_token(current), F.trim(F.coalesce(update_time, F.lit("")))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def content_hash(*columns: str) -> Column:
    """Hash of the named columns, whatever their order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
