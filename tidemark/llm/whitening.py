"""Whitening of embeddings by the singular values of the centred rows.

Entries become whole numbers (``x``), so that sums and deviations are exact. The distinct rows are centred and reduced, block by block, to a
triangular factor in each task; factors are stacked and reduced again in groups of ``FAN``, until few are left. The driver gets those and
finds singular values and vectors (:mod:`tidemark.llm.bidiagonal`), a matrix of the vectors' width on each side. No covariance is ever formed, so that
small components keep their digits.

Defined results: rows whose vector is null or holds null or non-finite entries go, and so do empty vectors and those whose length isn't the most
frequent one (the longer of equally frequent ones); a null id is carried; repeated rows each get their rows and count once for the fit; components
without variance (under ``NOTHING`` of the largest, in standard deviations) don't exist, so that one distinct row gives an empty result, and so
does an empty table; of equal eigenvalues any orthogonal vectors are taken; a ``deviation`` beyond a long is null; entries of magnitude
beyond 2**46 are an error; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bidiagonal import singular
from tidemark.llm.common import stored, table

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Factors that one task stacks; a component with less than this share of the largest standard deviation is rounding.
FAN, NOTHING = 16, 1e-12
FACTOR = "part int, factor binary"


def whole(vector: Column) -> Column:
    """The vector's entries as whole numbers, null for a vector that has to go."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    low = F.forall(vector, lambda c: F.abs(c.cast("double")) <= F.lit(float(1 << 46)))
    wide = F.raise_error(F.lit("an entry is too large to be whitened")).cast("array<bigint>")
    made = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET)
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0), F.when(low, made).otherwise(wide))


def whole_rows(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, x`` of the rows that stay."""
    made = rows.select(F.col(vec_id).alias("vec_id"), whole(F.col(vector)).alias("x")).where("x IS NOT NULL")
    sizes = made.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return made.where(F.size("x") == (sizes["size"] if sizes else 0))


def block(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


@dataclass
class Fit:
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    trace: float
    vectors: np.ndarray  # a column for each component

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n x - S``, exact, and ``x - S / n``."""
        reach = max([abs(v) for v in self.sums] + [self.n * int(np.abs(x).max(initial=0))])
        exact = x * self.n - np.array(self.sums) if reach < 1 << 62 else x.astype(object) * self.n - np.array(self.sums, object)
        return exact, exact.astype(float) / self.n

    def whitened(self, near: np.ndarray) -> np.ndarray:
        return near @ self.vectors / np.sqrt(self.eigenvalues)


def deviations(exact: np.ndarray) -> list[int | None]:
    if exact.dtype != object and np.abs(exact).max(initial=0) < (2**63 // exact.shape[1]) ** 0.5:
        return (exact**2).sum(axis=1).tolist()
    made = [sum(int(v) ** 2 for v in row) for row in exact]
    return [v if v < 1 << 63 else None for v in made]


def factors(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """A triangular factor of the centred rows of each task."""
    centre = Fit(n, sums, np.zeros(0), 0.0, np.zeros((0, 0)))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, d = None, len(sums)
        for batch in batches:
            near = centre.centred(block(batch.column(0)))[1]
            for at in range(0, len(near), max(1024, 4 * d)):
                part = near[at : at + max(1024, 4 * d)]
                held = np.linalg.qr(part if held is None else np.vstack([held, part]), mode="r")
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held.tobytes()])], ["part", "factor"])

    return fit.select("x").mapInArrow(reduce, FACTOR)


def triangular(made: DataFrame, d: int, fan: int = FAN) -> np.ndarray:
    """One factor of all, by stacking ``fan`` at a time."""

    def joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.frombuffer(f).reshape(-1, d) for f in group.sort_values("part")["factor"]])
        return pd.DataFrame({"part": [key[0]], "factor": [np.linalg.qr(stack, mode="r").tobytes()]})

    made = stored(made, "factors")
    while made.count() > fan:
        made = stored(made.groupBy((F.col("part") / fan).cast("int").alias("part")).applyInPandas(joined, FACTOR), "factors")
    stack = [np.frombuffer(r["factor"]).reshape(-1, d) for r in made.orderBy("part").collect()]
    r = np.linalg.qr(np.vstack([*stack, np.zeros((d, d))]), mode="r")
    return r


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """``fit`` has each distinct ``x`` once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = block(batch.column(0))
            if len(x):
                n += len(x)
                total = x.sum(axis=0, dtype=np.int64).astype(object) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_pydict({"at": list(range(-1, len(total))), "s": [str(v) for v in (n, *total)]})

    sums = fit.select("x").mapInArrow(add, "at long, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not sums:
        return None
    n, *sums = [int(r["s"]) for r in sorted(sums, key=lambda r: r["at"])]
    values, vectors = singular(triangular(factors(fit, n, sums), len(sums)))
    real = int((values > values[0] * NOTHING**2).sum()) if values[0] > 0 else 0
    keep = min(components, real)
    return Fit(n, sums, values[:keep] / n, float(values.sum()) / n, vectors[:, :keep])


def identity_error(fit: DataFrame, model: Fit) -> float:
    """The largest entry of the difference between the covariance of the whitened rows and the identity."""
    k, spark = len(model.eigenvalues), fit.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = shared.value.whitened(shared.value.centred(block(batch.column(0)))[1])
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": list(range(total.size)), "s": total.ravel().tolist()})

    found = fit.select("x").mapInArrow(add, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    total = np.array([r["s"] for r in sorted(found, key=lambda r: r["at"])]).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row that stays and each component."""
    spark = rows.sparkSession
    kinds = f"vec_id {rows.schema[vec_id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    made = whole_rows(rows, vec_id, vector)
    fit = stored(made.select("x").distinct(), "fit")
    model = fit_whitening(fit, components)
    k = len(model.eigenvalues) if model else 0
    if not k:
        return spark.createDataFrame([], kinds)
    error, shared = identity_error(fit, model), spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            exact, near = m.centred(block(batch.column(1)))
            w, each = m.whitened(near), np.repeat(np.arange(len(near)), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(near))),
                pa.array(np.full(len(each), m.n)),
                pa.array(deviations(exact), pa.int64()).take(pa.array(each)),
                pa.array(w.ravel()),
                pa.array(np.tile(m.eigenvalues / m.trace, len(near))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in kinds.split(", ")])

    return made.select("vec_id", "x").mapInArrow(project, kinds)


def op12_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
