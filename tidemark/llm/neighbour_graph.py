"""A neighbour graph by NN-descent: a neighbour of a neighbour is likely to be a neighbour.

Nodes carry a sketch (hyperplane signs) and a radius; the distance ``d`` of two nodes counts the bits in which their sketches differ, less their radii. A
node's list has every node it met within ``near`` bits, however many, and the ``LIST`` nearest beyond, which show the way. So a list that is
saturated with near entries grows, and nothing near is ever dropped.

The first lists come from sorted orders of the sketches. In each round a node takes a bounded draw of its list and of those that list it, and
compares all of them that it didn't compare before; each learns what is near or better than what it has. Rounds go on until few lists
change, and begin again from new sorted orders until the audit says that enough links are found and a start brings hardly any new near entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.vector_clumps import SIGNS, in_order

#: Farther entries of a list; entries of a list and of those that list a node in one round; what a node learns of farther ones in a group or block.
LIST, DRAWN, LEARNED = 8, 8, 2
#: Rows compared with each other in a sorted order, and orders at a start.
BLOCK, ORDERS = 32, 4
#: Rounds of a start, the share of changed entries that ends it, starts at most, and the share of new near entries under which a start was the last.
ROUNDS, CHANGED, STARTS, GROWN = 2, 0.02, 10, 0.01
EDGE = "a long, b long, d short"


def differing(s: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs within each group: ``s`` is groups x members x signs."""
    s = s.view(np.uint64)  # of signed numbers the bits of the magnitude would count
    return np.bitwise_count(s[:, :, None, :] ^ s[:, None, :, :]).sum(axis=3, dtype=np.int16)


def edges(ids: np.ndarray, d: np.ndarray, open_: np.ndarray, near: int, worst: np.ndarray) -> pa.RecordBatch:
    """What the members of each group learn: all open pairs within ``near`` and the LEARNED best others that are better than the member's ``worst``."""
    far = np.where(open_ & (d > near) & (d < worst[:, :, None]), d, np.int16(9999))
    best = np.argpartition(far, min(LEARNED, far.shape[2] - 1), axis=2)[:, :, :LEARNED]
    taken = open_ & (d <= near)
    np.put_along_axis(taken, best, np.take_along_axis(taken, best, 2) | (np.take_along_axis(far, best, 2) < 9999), 2)
    g, i, j = np.nonzero(taken)
    return pa.RecordBatch.from_arrays([pa.array(ids[g, i]), pa.array(ids[g, j]), pa.array(d[g, i, j].astype(np.int16))], ["a", "b", "d"])


def from_order(nodes: DataFrame, turn: int, near: int) -> DataFrame:
    """Edges between nodes that stand close to each other in one sorted order."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            groups = -(-n // BLOCK)
            padded = lambda x, fill: np.concatenate([x, np.full((groups * BLOCK - n, *x.shape[1:]), fill, x.dtype)]).reshape(groups, BLOCK, *x.shape[1:])  # noqa: B023, E731
            ids, r = padded(batch.column(0).to_numpy(), -1), padded(batch.column(3).to_numpy().astype(np.int16), 0)
            space = padded(pc.dictionary_encode(batch.column(1)).indices.to_numpy().astype(np.int64) * (1 << 32) + batch.column(2).to_numpy(), -1)
            s = padded(np.stack([batch.column(4 + k).to_numpy() for k in range(len(SIGNS))], axis=1), 0)
            d = differing(s) - r[:, :, None] - r[:, None, :]
            same = (space[:, :, None] == space[:, None, :]) & (ids[:, :, None] != ids[:, None, :]) & (ids >= 0)[:, :, None]
            yield edges(ids, d, same, near, np.full(ids.shape, 9999, np.int16))

    return in_order(nodes.select("node", "label", "dim", "r", *SIGNS), turn).mapInArrow(compare, EDGE)


def kept_edges(known: DataFrame | None, learned: DataFrame, near: int) -> DataFrame:
    """Lists (``a, b, d, fresh``) out of the lists so far and what was learned."""
    every = learned.withColumn("fresh", F.lit(True))
    every = every.unionByName(known.withColumn("fresh", F.lit(False))) if known is not None else every
    every = every.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    far = every.where(F.col("d") > near).withColumn("place", place).where(F.col("place") <= LIST).drop("place")
    return stored(every.where(F.col("d") <= near).unionByName(far), "lists")


def drawn_members(lists: DataFrame, turn: int) -> DataFrame:
    """``hub, node, fresh`` of the groups that a round compares: a draw of each list and of those that list a node, fresh ones first."""
    there = lists.select(F.col("a").alias("hub"), F.col("b").alias("node"), "fresh")
    back = lists.select(F.col("b").alias("hub"), F.col("a").alias("node"), "fresh")
    out = None
    for k, side in enumerate((there, back)):
        most = DRAWN + LIST if k == 0 else DRAWN
        place = F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("fresh"), F.xxhash64("node", "hub", F.lit(turn))))
        side = side.withColumn("place", place).where(F.col("place") <= most).drop("place")
        out = side if out is None else out.unionByName(side)
    own = lists.where("fresh").select(F.col("a").alias("hub"), F.col("a").alias("node"), F.lit(False).alias("fresh")).distinct()
    return out.unionByName(own)


def one_round(nodes: DataFrame, lists: DataFrame, turn: int, near: int) -> DataFrame:
    """Lists after one round."""
    full = lists.where(F.col("d") > near).groupBy("a").agg(F.count("*").alias("n"), F.max("d").alias("most"))
    worst = stored(full.select(F.col("a").alias("node"), F.when(F.col("n") >= LIST, F.col("most")).otherwise(F.lit(9999)).cast("short").alias("worst")), "worst")
    state = nodes.select("node", "r", *SIGNS).join(worst, "node", "left")
    told = drawn_members(lists, turn).join(state, "node")
    member = F.struct("node", "fresh", "r", F.coalesce("worst", F.lit(9999).cast("short")).alias("worst"), *SIGNS)
    groups = told.groupBy("hub").agg(F.max("fresh").alias("fresh"), F.collect_list(member).alias("m")).where("fresh").select("m")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                lists_ = whole.column(0).slice(at, 512)
                sizes, flat = pc.list_value_length(lists_).to_numpy(), lists_.flatten()
                put = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

                def spread(name, fill, kind, flat=flat, put=put, shape=(len(sizes), int(sizes.max(initial=1)))):
                    out = np.full(shape, fill, kind)
                    out[put] = flat.field(name).to_numpy(zero_copy_only=False)
                    return out

                ids, fresh = spread("node", -1, np.int64), spread("fresh", False, bool)
                r, least = spread("r", 0, np.int16), spread("worst", 0, np.int16)
                s = np.stack([spread(x, 0, np.int64) for x in SIGNS], axis=2)
                d = differing(s) - r[:, :, None] - r[:, None, :]
                there = ids >= 0
                pairs = there[:, :, None] & there[:, None, :] & (ids[:, :, None] != ids[:, None, :]) & (fresh[:, :, None] | fresh[:, None, :])
                yield edges(ids, d, pairs, near, least)

    return kept_edges(lists.select("a", "b", "d"), groups.mapInArrow(compare, EDGE), near)


def neighbour_lists(nodes: DataFrame, near: int, recall: Callable[[DataFrame], float], target: float) -> tuple[DataFrame, float]:
    """``a, b, d`` and the audited recall. ``nodes`` has ``node, label, dim, r`` (radius in bits) and the sketch, is stored, and ``recall`` audits lists; only
    nodes of one label and vector length are compared."""
    lists, turn, found, before = None, 0, 0.0, 0
    for _ in range(STARTS):
        learned = from_order(nodes, turn, near)
        for k in range(1, ORDERS):
            learned = learned.unionByName(from_order(nodes, turn + k, near))
        turn += ORDERS
        lists = kept_edges(lists.select("a", "b", "d") if lists is not None else None, learned, near)
        for _ in range(ROUNDS):
            n, fresh = lists.agg(F.count("*"), F.count_if("fresh")).first()
            if fresh <= CHANGED * n:
                break
            lists = one_round(nodes, lists, turn, near)
            turn += 1
        found, now = recall(lists), lists.where(F.col("d") <= near).count()
        if found >= target and now <= before * (1 + GROWN):
            break
        before = now
    return lists.select("a", "b", "d"), found
