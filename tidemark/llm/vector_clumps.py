"""Classes and clumps of vectors, so that dense groups never have to be listed pair by pair.

Equal vectors of a label are one *class*. A *clump* is a class, its leader, with classes of the same label that are within half the linking
angle of it: any two of them are within the linking angle of each other, so that all links inside are known without a look at the pairs. Leaders are
found in passes: vectors are sorted by random hyperplane signs, another order in each pass, and compared within blocks of ``BLOCK`` rows; the
vector with the most near ones in its block leads them, and goes on to the next pass alone. A pass in which no block was dense ends this. Members whose last
leader turns out to be too far away are set free and go through the passes again among themselves; what is still free then leads itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions, stored
from tidemark.llm.spans import NULL_ID

BLOCK, DENSE, PASSES, TRIES, SEED = 64, 12, 12, 3, 11
#: Bits of a sketch; a whole turn of 180 degrees is so many bits.
BITS = 256
SIGNS = tuple(f"s{k}" for k in range(BITS // 64))
#: Angles that differ by less are settled by the cosine itself.
ROUNDING = 1e-7


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null and no non-finite entry, and one that isn't zero."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angle between each row of ``a`` and the same row of ``b``, also for small angles."""
    return 2 * np.arctan2(np.linalg.norm(a - b, axis=1), np.linalg.norm(a + b, axis=1))


def sketches(x: np.ndarray) -> np.ndarray:
    """``BITS`` hyperplane signs of each row as four signed integers."""
    planes = np.random.default_rng(SEED + x.shape[1]).normal(size=(x.shape[1], BITS))
    return np.packbits(x @ planes > 0, axis=1).view("<i8")


def runs(dims: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with vectors of one length."""
    cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def classes(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``node, label, dim, least, weight, vec`` and the sketch of each distinct vector of a label, stored: ``least`` is its smallest id, ``weight`` its
    number of rows."""
    made = rows.groupBy(F.col(label).alias("label"), F.col(vector).alias("vec")).agg(F.min(F.coalesce(F.col(vec_id).cast("long"), F.lit(NULL_ID))).alias("least"), F.count("*").alias("weight"))
    made = made.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vec").alias("dim"), "least", "weight", "vec")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = batch.column(2).to_numpy(), np.zeros((batch.num_rows, len(SIGNS)), "<i8")
            for a, b in runs(dims):
                out[a:b] = sketches(matrix(batch.column(5).slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(out[:, k]) for k in range(len(SIGNS))]], [*batch.schema.names, *SIGNS])

    return stored(made.mapInArrow(sketched, f"{kinds}, {', '.join(f'{s} long' for s in SIGNS)}"), "classes")  # the numbers hold from here on


def in_order(rows: DataFrame, turn: int) -> DataFrame:
    """``rows`` sorted within ranges by label and sketch, the bits turned round; equal sketches go to several ranges."""
    sign, by = F.col(SIGNS[turn % len(SIGNS)]), 16 * (turn // len(SIGNS)) % 64
    key = F.shiftleft(sign, by).bitwiseOR(F.shiftrightunsigned(sign, 64 - by)) if by else sign
    order = [F.col("dim"), F.col("label"), key, F.xxhash64("node", F.lit(turn))]
    return rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


def led(near: np.ndarray) -> tuple[np.ndarray, int]:
    """For each row of a block the row that leads it (itself, if none does), and the size of the largest group. ``near`` is symmetric."""
    leader, left, most = np.arange(len(near)), near.copy(), 1
    while True:
        size = left.sum(axis=1)
        k = int(size.argmax())
        if size[k] < 2:
            return leader, most
        mine = np.flatnonzero(left[k])
        leader[mine], most = k, max(most, len(mine))
        left[mine] = False
        left[:, mine] = False


def one_pass(active: DataFrame, turn: int, half: float) -> DataFrame:
    """``active`` (``node, label, dim, vec`` and sketch) with ``leader``, null for those that go on, and ``dense``, the size of the row's group."""
    columns = ["node", "label", "dim", "vec", *SIGNS]
    kinds = ", ".join(f"{c} {active.schema[c].dataType.simpleString()}" for c in columns)
    least = math.cos(half) + 1e-12

    def absorb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, dims = batch.num_rows, batch.column(0).to_numpy(), batch.column(2).to_numpy()
            labels = pc.dictionary_encode(batch.column(1)).indices.to_numpy()
            to, dense = np.arange(n), np.ones(n, np.int32)
            for a, b in runs(dims):
                x = matrix(batch.column(3).slice(a, b - a))
                for at in range(a, b, BLOCK):
                    end = min(at + BLOCK, b)
                    u, mine = x[at - a : end - a], labels[at:end]
                    near = (u @ u.T >= least) & (mine[:, None] == mine)
                    np.fill_diagonal(near, True)
                    if near.sum() > len(u):
                        leader, most = led(near | near.T)
                        to[at:end], dense[at:end] = at + leader, most
            lead = pa.array(nodes[to], mask=to == np.arange(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, lead, pa.array(dense)], [*columns, "leader", "dense"])

    return stored(in_order(active.select(*columns), turn).mapInArrow(absorb, f"{kinds}, leader long, dense int"), "pass")


def absorbed(active: DataFrame, half: float, turn: int) -> tuple[DataFrame | None, int]:
    """``node, leader`` with the last leader of each class that some pass absorbed, and the next turn."""
    found = []
    for _ in range(PASSES):
        made = one_pass(active, turn, half)
        turn += 1
        active = made.where("leader IS NULL")
        gone, dense = made.agg(F.count("leader"), F.max("dense")).first()
        if gone:
            found.append(made.where("leader IS NOT NULL").select("node", "leader"))
        if (dense or 0) < DENSE:
            break
    last = found[-1] if found else None
    for before in reversed(found[:-1]):
        later = last.select(F.col("node").alias("leader"), F.col("leader").alias("over"))
        last = stored(before.join(later, "leader", "left").select("node", F.coalesce("over", "leader").alias("leader")).unionByName(last), "leaders")
    return last, turn


def angle_column(pairs: DataFrame, a: str, b: str, name: str = "angle") -> DataFrame:
    """``pairs`` with the angle between two columns of vectors of one length, which go."""
    kept = [c for c in pairs.columns if c not in (a, b)]
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in kept)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, made = batch.column(len(kept)), batch.column(len(kept) + 1), np.zeros(batch.num_rows)
            for x, y in runs(pc.list_value_length(u).to_numpy()):
                made[x:y] = angles(matrix(u.slice(x, y - x)), matrix(v.slice(x, y - x)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(made)], [*kept, name])

    return pairs.select(*kept, a, b).mapInArrow(measured, f"{kinds}, {name} double")


def clumps(points: DataFrame, angle: float) -> DataFrame:
    """``node, leader, angle, weight, least`` for every class of :func:`classes`, stored; a leader leads itself at angle 0."""
    active, turn, settled = points, 0, []
    vectors = points.select("node", "vec")
    for _ in range(TRIES):
        found, turn = absorbed(active, angle / 2, turn)
        if found is None:
            break
        pairs = found.join(vectors, "node").join(vectors.select(F.col("node").alias("leader"), F.col("vec").alias("lead_vec")), "leader")
        pairs = stored(angle_column(pairs, "vec", "lead_vec"), "led")
        settled.append(pairs.where(F.col("angle") <= angle / 2 - ROUNDING))
        active = points.join(pairs.where(F.col("angle") > angle / 2 - ROUNDING).select("node"), "node", "left_semi")
    info = points.select("node", "weight", "least")
    if not settled:
        return stored(info.select("node", F.col("node").alias("leader"), F.lit(0.0).alias("angle"), "weight", "least"), "clumps")
    members = settled[0]
    for more in settled[1:]:
        members = members.unionByName(more)
    made = info.join(members, "node", "left").select("node", F.coalesce("leader", "node").alias("leader"), F.coalesce("angle", F.lit(0.0)).alias("angle"), "weight", "least")
    return stored(made, "clumps")
