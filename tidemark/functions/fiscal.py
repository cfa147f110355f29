"""Fiscal periods, identities and display slots. A slot (``2027E``) is for display and is never an identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import is_unavailable

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
PERIOD = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+([0-9]{4})$"


def month_name(month: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(m) for m in MONTHS]), F.when(month.between(1, 12), month).cast("int"))


def period_month(label: Column) -> Column:
    """1 to 12 of a ``Mon YYYY`` label (a longer month name will do), else NULL."""
    found = F.initcap(F.regexp_extract(F.trim(label), PERIOD, 1))
    return F.when(found != "", F.array_position(F.array(*[F.lit(m) for m in MONTHS]), found)).cast("int")


def period_year(label: Column) -> Column:
    found = F.regexp_extract(F.trim(label), PERIOD, 2)
    return F.when(found != "", found.cast("int"))


def normalized_period(label: Column) -> Column:
    """``Mon YYYY`` where the label can be read; other labels pass through trimmed."""
    named = F.concat(month_name(period_month(label)), F.lit(" "), period_year(label).cast("string"))
    return F.when(period_month(label).isNotNull(), named).otherwise(F.trim(label))


def reported_period(label: Column, fiscal_end_month: Column | None = None) -> Column:
    """The identity that a reported label gives: ``Mon YYYY``, ``YYYY-MM``, or ``FY2027``, ``2027E`` and ``2027`` with the
    entity's fiscal-end month; NULL if none."""
    s = F.trim(label)
    year, month = F.regexp_extract(s, r"^([0-9]{4})-([0-9]{2})$", 1), F.regexp_extract(s, r"^([0-9]{4})-([0-9]{2})$", 2)
    named = F.when(month != "", month_name(month.try_cast("int")))
    fiscal = F.regexp_extract(s, r"(?i)^(?:FY\s*)?([0-9]{4})E?$", 1)
    end = month_name(fiscal_end_month) if fiscal_end_month is not None else F.lit(None).cast("string")
    return (
        F.when(is_unavailable(label), F.lit(None).cast("string"))
        .when(period_month(s).isNotNull(), normalized_period(s))
        .when(named.isNotNull(), F.concat(named, F.lit(" "), year))
        .when((fiscal != "") & end.isNotNull(), F.concat(end, F.lit(" "), fiscal))
    )


def was_normalized(label: Column, fiscal_end_month: Column) -> Column:
    """The identity needed the fiscal-end month."""
    s = F.trim(label)
    return reported_period(label, fiscal_end_month).isNotNull() & F.coalesce(s.rlike(r"(?i)^(FY\s*)?[0-9]{4}E?$"), F.lit(False))


def label_parsable(label: Column) -> Column:
    s = F.trim(label)
    known = s.rlike(PERIOD) | s.rlike(r"^[0-9]{4}-[0-9]{2}$") | s.rlike(r"(?i)^FY\s*[0-9]{4}$") | s.rlike(r"(?i)^[0-9]{4}E$")
    return label.isNotNull() & (is_unavailable(label) | F.coalesce(known, F.lit(False)))


def looks_like_slot(label: Column) -> Column:
    return F.coalesce(F.trim(label).rlike("(?i)^[0-9]{4}E$"), F.lit(False))


def mapped_year(label: Column) -> Column:
    """Calendar year that a period is shown under: January to March count to the year before."""
    month, year = period_month(label), period_year(label)
    return F.when(month <= 3, year - 1).otherwise(year)


def mapped_slot(label: Column) -> Column:
    return F.concat(mapped_year(label).cast("string"), F.lit("E"))


def slot_from_alignment(alignment: Column) -> Column:
    """``CY2027`` is slot ``2027E``."""
    year = F.regexp_extract(alignment, "^CY([0-9]{4})", 1)
    return F.when(year != "", F.concat(year, F.lit("E")))


def fiscal_equals_calendar(label: Column) -> Column:
    return F.coalesce(F.trim(label).rlike(r"(?i)^dec[a-z]*\s+[0-9]{4}$"), F.lit(False))


def entity_key(entity: Column) -> Column:
    key = F.upper(F.trim(entity))
    return F.when(key != "", key)


def period_key(label: Column) -> Column:
    key = normalized_period(label)
    return F.when(key != "", key)


def display_years(first: Column, count: int = 4) -> Column:
    """Slots of ``count`` years from ``first`` on."""
    return F.transform(F.sequence(first, first + count - 1), lambda y: F.concat(y.cast("string"), F.lit("E")))


def valid_years(years: Column) -> Column:
    """The slots, or an empty array if any isn't one: all or nothing."""
    fine = F.coalesce(F.size(years) > 0, F.lit(False)) & F.coalesce(F.forall(years, lambda y: F.coalesce(y.rlike("^[0-9]{4}E$"), F.lit(False))), F.lit(False))
    return F.when(fine, years).otherwise(F.array().cast("array<string>"))


def chart_years(years: Column) -> Column:
    return F.slice(valid_years(years), 1, 3)


def default_year(years: Column) -> Column:
    """The second slot, or the only one."""
    ok = F.filter(years, lambda y: F.coalesce(y.rlike("^[0-9]{4}E$"), F.lit(False)))
    return F.coalesce(F.try_element_at(ok, F.lit(2)), F.try_element_at(ok, F.lit(1)))
