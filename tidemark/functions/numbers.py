"""Numbers that may arrive as text, and the formulas over them. Missing never becomes zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as "known to be unavailable" at the gate and at export.
GATE_UNAVAILABLE = ("", "n/a", "na", "data unavailable", "unavailable", "null", "none", "—", "-")
EXPORT_UNAVAILABLE = ("", "data unavailable", "n/a", "n/a (baseline)", "na", "null", "none")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def finite(value: Column) -> Column:
    """A double, or NULL where it's NaN or infinite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def to_num(text: Column) -> Column:
    """Text to a finite double: thousands separators, percent and dollar signs go; anything else that is not a plain
    number, "true" and sentinels included, is NULL."""
    s = F.trim(text.cast("string"))
    for sign in ",%$":  # a replacement that finds nothing is much cheaper than a translation
        s = F.replace(s, F.lit(sign), F.lit(""))
    s = F.trim(s)
    number = s.try_cast("double")  # the pattern is tried once, and infinities fail the comparison
    return F.when(s.rlike(NUMBER) & (F.abs(number) < float("inf")), number)


def is_unavailable(text: Column, at_export: bool = False) -> Column:
    """NULL or one of the listed sentinels; the gate and the export have a list each."""
    listed = EXPORT_UNAVAILABLE if at_export else GATE_UNAVAILABLE
    return text.isNull() | F.coalesce(F.lower(F.trim(text)).isin(*listed), F.lit(False))


def display_text(text: Column) -> Column:
    return F.when(~is_unavailable(text, at_export=True), F.trim(text))


def pe(price: Column, value: Column) -> Column:
    return F.when(value > 0, price / value)


def growth_ratio(prior: Column, current: Column) -> Column:
    """The ordinary ratio; only a positive prior has one, and a positive value may still turn negative (a label)."""
    return F.when((prior > 0) & (current >= 0), (current - prior) / prior)


def growth_label(prior: Column, current: Column) -> Column:
    return (
        F.when((prior < 0) & (current > 0), "Turn profitable")
        .when((prior > 0) & (current < 0), "Turn loss")
        .when((prior < 0) & (current == 0), "Break-even")
        .when((prior < 0) & (current < 0) & (current > prior), "Loss narrowing")
        .when((prior < 0) & (current < 0) & (current < prior), "Loss widening")
        .when((prior < 0) & (current < 0), "Loss unchanged")
    )


def cagr(start: Column, end: Column, years: float = 2.0) -> Column:
    return F.when((start > 0) & (end > 0) & F.lit(years > 0), F.pow(end / start, F.lit(1.0 / years)) - 1.0)


def growth_adjusted_pe(forward_pe: Column, growth: Column) -> Column:
    return finite(F.when(growth > 0, forward_pe / (growth * 100.0)))


def dispersion(high: Column, low: Column, value: Column) -> Column:
    """Spread over the value, for positive values."""
    return F.when(value > 0, (high - low) / value)


def alert_dispersion(high: Column, low: Column, value: Column) -> Column:
    """Spread over the value's size, for any value but zero."""
    return F.when(value != 0, (high - low) / F.abs(value))


def revision_pct(previous: Column, current: Column) -> Column:
    return F.when(previous != 0, (current - previous) / F.abs(previous) * 100.0)


def same_value(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.coalesce(a.eqNullSafe(b) | (F.abs(a - b) < tolerance), F.lit(False))


def whole_count(value: Column) -> Column:
    """A coverage count as a double, rounded where it is within 1e-9 of a whole number."""
    return F.when(F.abs(value - F.round(value)) < 1e-9, F.round(value)).otherwise(value)


def range_position(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.least(F.lit(100.0), F.greatest(F.lit(0.0), (value - low) / (high - low) * 100.0)))


def price_scale_hit(ratio: Column) -> Column:
    """The new price is about ten or a hundred times the old one, or a tenth or a hundredth."""
    # fixed values: the factors, and the shares by which a ratio may miss them
    hits = [
        (F.abs(ratio - f) < 0.05 * f) | (F.abs(ratio - 1.0 / f) < 0.05 / f) | (F.abs(ratio - f) / f < 0.02) | (F.abs(ratio * f - 1.0) < 0.02)
        for f in (10.0, 100.0)
    ]
    return hits[0] | hits[1]


def price_outlier(new: Column, old: Column, threshold_pct: float = 30.0) -> Column:
    usable = (new > 0) & (old != 0)
    return F.coalesce(usable & ((F.abs(new - old) / F.abs(old) * 100.0 > threshold_pct) | price_scale_hit(new / old)), F.lit(False))


def number_text(value: Column, places: int = 2) -> Column:
    return F.format_number(value, places)


def percent_text(value: Column, places: int = 2) -> Column:
    return F.when(value.isNotNull(), F.concat(F.when(value > 0, "+").otherwise(""), F.format_number(value, places), F.lit("%")))
