"""Running values of long series in two levels.

A window over a whole series is one task, however long the series. Here a series falls into slices of its order (months of a date or time, ranges of a
whole number). The first level runs inside each slice, so that slices of one series are separate tasks; the second runs over one summary row a
slice, and what it finds is carried into the slice as its entry. Rows of equal order are in one slice. Keys of series are never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whole numbers of a slice.
WIDTH = 65_536


def slice_of(rows: DataFrame, column: str) -> Column:
    """The slice of a value of ``column``: never null, rising with the column, nulls first; one slice for a kind of column that can't be cut."""
    kind = rows.select(column).schema[0].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.coalesce(F.year(column) * 12 + F.month(column), F.lit(-1_000_000)).cast("long")
    if kind in ("long", "integer", "short", "byte"):
        return F.coalesce(F.floor(F.col(column) / WIDTH), F.lit(-(1 << 62)))
    return F.lit(0).cast("long")


def running_last(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], found: dict[str, str], before: bool = False, cut: Column | None = None) -> DataFrame:
    """``rows`` with, for each new name of ``found``, the last value that isn't null of the named column among the rows of the series up to this one (``before``:
    without this one). ``order`` is rising, nulls first, its first column gives the slices unless ``cut`` does."""
    sliced = rows.withColumn("slice", slice_of(rows, order[0]) if cut is None else cut)
    inside = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    made = sliced.withColumns({n: F.last(c, ignorenulls=True).over(inside) for n, c in found.items()})
    at = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    ends = made.groupBy(*keys, "slice").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"end_{n}") for n, c in found.items()])
    slices = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    entries = ends.select(*keys, "slice", *[F.last(f"end_{n}", ignorenulls=True).over(slices).alias(f"entry_{n}") for n in found])
    out = made.join(entries, [*keys, "slice"], "left")
    return out.withColumns({n: F.coalesce(n, f"entry_{n}") for n in found}).select(*rows.columns, *found)
