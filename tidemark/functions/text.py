"""Facts read out of short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import is_unavailable, to_num


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def after_hours_price(note: Column) -> Column:
    return to_num(first_group(note, r"(?i)(?:post[- ]market|after[- ]hours|extended)\s*\$?\s*([0-9]+(?:\.[0-9]+)?)"))


def event_date(raw: Column) -> Column:
    """``M/D/YYYY`` or ISO, with whatever stands in brackets after it ignored."""
    s = F.trim(F.regexp_replace(F.trim(raw), r"\s*\(.*$", ""))
    part = lambda n: F.lpad(F.regexp_extract(s, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", n), 2 if n < 3 else 4, "0")
    american = s.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$")
    iso = F.when(american, F.concat_ws("-", part(3), part(1), part(2))).when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s)
    return F.when(~is_unavailable(raw, at_export=True), F.to_date(F.try_to_timestamp(iso)))


def event_session(raw: Column) -> Column:
    lower = F.lower(raw)
    found = F.when(lower.rlike(r"pre[\s-]*market"), "Pre-Market").when(lower.rlike(r"post[\s-]*market"), "Post-Market")
    return F.when(~is_unavailable(raw, at_export=True), found)


def event_status(raw: Column, declared: Column, source: Column, url_is_official: Column, has_url: Column) -> Column:
    """Confirmed only on a declared confirmation with evidence from the issuer; otherwise estimated."""
    proven = has_url & (F.coalesce(url_is_official, F.lit(False)) | F.coalesce(F.lower(source).isin("company ir", "investor relations"), F.lit(False)))
    confirmed = F.coalesce(F.lower(declared) == "confirmed", F.lit(False)) & proven
    return F.when(~is_unavailable(raw, at_export=True), F.when(confirmed, "confirmed").otherwise("estimated"))


def event_display(raw: Column, status: Column) -> Column:
    """``Nov 25, 2026 · Post-Market · Estimated``."""
    shown = F.coalesce(F.date_format(event_date(raw), "MMM d, yyyy"), F.trim(F.regexp_replace(F.trim(raw), r"\s*\(.*$", "")))
    label = F.when(F.lower(status) == "confirmed", "Confirmed").otherwise("Estimated")
    return F.when(~is_unavailable(raw, at_export=True), F.concat_ws(" · ", shown, event_session(raw), label))


# The phrases and units that the patterns of the next two functions match, and the range of a margin.
def margin_numbers(text: Column) -> Column:
    """All percentages from 20 to 95."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]{1,3}(?:\.[0-9]+)?)\s*%"), 1)
    return F.filter(F.transform(found, lambda x: x.cast("double")), lambda x: x.between(20.0, 95.0))


def bps_change(text: Column) -> Column:
    """Basis points with a sign: words of decline first, then of increase, then the sign as written."""
    down = first_group(text, r"(?i)(?:down|declined?|fell|lower(?:ed)?)\s+(?:by\s+)?([0-9]{2,4})\s*bps")
    up = first_group(text, r"(?i)(?:up|increased?|rose|higher)\s+(?:by\s+)?([0-9]{2,4})\s*bps")
    plain = first_group(text, r"(?i)([+-]?[0-9]{2,4})\s*bps")
    return F.coalesce(-down.cast("double"), up.cast("double"), plain.cast("double"))


def versus(text: Column) -> Column:
    s = F.lower(F.trim(text))
    return F.when(s.isin("above", "below"), s)


#: The keys under which a source may give its own counts of analysts, in the order in which they are tried.
UP_ANALYST_KEYS = ("upAnalysts", "analystsUp", "numUp", "upCount", "up_analysts", "analystsRaising", "upRevisions", "numberOfUpwardRevisions")
DOWN_ANALYST_KEYS = ("downAnalysts", "analystsDown", "numDown", "downCount", "down_analysts", "analystsLowering", "downRevisions", "numberOfDownwardRevisions")


def analyst_direction(fields: Column) -> Column:
    """``up, down, status, reason`` from a map of a row's fields: the source's own counts, never derived from anything else."""
    up, down = (to_num(F.coalesce(*[fields[k] for k in keys])) for keys in (UP_ANALYST_KEYS, DOWN_ANALYST_KEYS))
    there = up.isNotNull() | down.isNotNull()
    return F.struct(up.alias("up"), down.alias("down"), F.when(there, "ok").otherwise("unavailable").alias("status"), F.when(~there, "not_in_source").alias("reason"))


def transition_date(*candidates: Column) -> Column:
    """The first of the dates that is given; none means unknown, never today."""
    clean = [F.when(~is_unavailable(c, at_export=True), F.substring(F.trim(c), 1, 10)) for c in candidates]
    return F.coalesce(*clean)


def is_baseline(reason: Column, previous: Column, revision: Column, previous_number: Column | None = None) -> Column:
    """The event opens a series: it says so, or has neither a percentage nor a previous number (``previous_number``, where that is known)."""
    said = lambda c: F.coalesce(F.lower(c).contains("baseline"), F.lit(False))
    empty = F.coalesce(F.lower(revision), F.lit("")).isin("n/a", "n/a (baseline)", "na", "")
    return said(reason) | said(previous) | (empty & (to_num(previous) if previous_number is None else previous_number).isNull())
