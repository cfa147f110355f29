"""Columns that are dear to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with the columns of ``made``, each computed once a row, by a generator: of a projection's columns the optimizer puts a copy wherever they are used, in
    filters that it pushes below the projection and in branches."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))
