"""Near-duplicate embeddings: links of cosine ``THRESHOLD`` and more between vectors of one label, and their components.

Equal vectors and dense groups are clumps (:mod:`tidemark.llm.vector_clumps`) whose inner links are known; NN-descent
(:mod:`tidemark.llm.neighbour_graph`) finds which clumps may have links between them. The angle of two leaders and the clumps' radii
settle most of these as a whole; for the rest each member is compared with the other leader, and what that leaves open, in blocks, with the
members themselves. All that is counted is exact; what the graph may miss is measured: the links of ``AUDIT`` sampled leaders, from a look at
all leaders, and the graph goes on until it has ``RECALL`` of them.

Defined results: a null label, a null or empty vector, one that is zero or holds null or non-finite components links with nothing; vectors of different
length don't link; repeated rows are rows like others, equal vectors being linked; a null id is smaller than all others (its component's id is
null); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.components import components
from tidemark.llm.neighbour_graph import neighbour_lists
from tidemark.llm.spans import NULL_ID
from tidemark.llm.vector_clumps import BITS, ROUNDING, SIGNS, angle_column, classes, clumps, matrix, usable

THRESHOLD, RECALL = 0.93, 0.98
#: Leaders whose links the audit looks for; members of a clump compared at a time; standard deviations of a sketch's bits that a link may be off.
AUDIT, MEMBERS, SPREAD = 4000, 256, 4.0


def near_bits(threshold: float) -> int:
    """Bits within which two sketches of linked vectors differ."""
    p = math.acos(threshold) / math.pi
    return math.ceil(BITS * p + SPREAD * math.sqrt(BITS * p * (1 - p)))


def audit(leaders: DataFrame, threshold: float, most: int = AUDIT) -> DataFrame:
    """``a, b``: the links of a draw of leaders, from a look at all. About ``most`` leaders, twice that at most, are sent to all tasks."""
    n = leaders.count()
    draw = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = leaders.where(draw < F.lit(most / max(1, n))).select("node", "label", "dim", "vec").limit(2 * most).toPandas()
    groups = {}
    for key, g in sample.groupby(["label", "dim"]):
        groups[key] = g["node"].to_numpy(), matrix(pa.array(g["vec"].tolist()))
    shared = leaders.sparkSession.sparkContext.broadcast(groups)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for key in set(keys) & set(shared.value):
                at = np.array([k for k, x in enumerate(keys) if x == key])
                nodes, u = shared.value[key]
                i, j = np.nonzero(matrix(batch.column(3).take(pa.array(at))) @ u.T >= threshold)
                a, b = batch.column(0).to_numpy()[at[i]], nodes[j]
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    found = leaders.select("node", "label", "dim", "vec").mapInArrow(look, "a long, b long")
    return stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "audit")


def leader_pairs(leaders: DataFrame, lists: DataFrame, angle: float) -> DataFrame:
    """``a, b, angle, a_radius, b_radius, whole``, each pair in both directions, of clumps that may have links between them. ``whole`` is true where all
    of their members are linked, null where that is open."""
    pairs = lists.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: leaders.select(F.col("node").alias(x), F.col("radius").alias(f"{x}_radius"), F.col("vec").alias(f"{x}_vec"))
    met = angle_column(pairs.join(side("a"), "a").join(side("b"), "b"), "a_vec", "b_vec")
    reach = F.col("a_radius") + F.col("b_radius")
    met = met.where(F.col("angle") - reach <= angle + ROUNDING)
    whole = F.when(F.col("angle") + reach <= angle - ROUNDING, True)
    met = stored(met.withColumn("whole", whole), "leader_pairs")
    turned = met.select(F.col("b").alias("a"), F.col("a").alias("b"), "angle", F.col("b_radius").alias("a_radius"), F.col("a_radius").alias("b_radius"), "whole")
    return met.unionByName(turned)


def blocks(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """``rows`` of each key dealt to arrays of about MEMBERS structs."""
    sizes = stored(rows.groupBy(key).agg(F.ceil(F.count("*") / MEMBERS).alias("parts")), "sizes")
    dealt = rows.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    return dealt.groupBy(key, "part").agg(F.collect_list(F.struct(*fields)).alias("rows"))


def open_links(pairs: DataFrame, members: DataFrame, leaders: DataFrame, angle: float, threshold: float) -> DataFrame:
    """``node, a, b, n``: how many rows of clump ``b`` each member (of clump ``a``) is linked with, for the pairs that leaders alone don't settle."""
    whole = leaders.select(F.col("node").alias("b"), F.col("vec").alias("b_vec"), F.col("total").alias("b_total"))
    tried = pairs.where("whole IS NULL").select("a", "b", "b_radius").join(members.select(F.col("leader").alias("a"), "node", "vec"), "a").join(whole, "b")
    tried = stored(angle_column(tried.select("a", "b", "node", "b_radius", "b_total", F.col("vec").alias("kept_vec"), "vec", "b_vec"), "vec", "b_vec"), "tried")
    settled = tried.where(F.col("angle") + F.col("b_radius") <= angle - ROUNDING).select("node", "a", "b", F.col("b_total").alias("n"))
    rest = (F.col("angle") + F.col("b_radius") > angle - ROUNDING) & (F.col("angle") - F.col("b_radius") <= angle + ROUNDING)
    asked = blocks(tried.where(rest).select("node", "a", "b", F.col("kept_vec").alias("vec")), "b", ("node", "a", "vec")).withColumnRenamed("rows", "asked")
    there = members.join(tried.where(rest).select(F.col("b").alias("leader")).distinct(), "leader", "left_semi")
    there = blocks(there, "leader", ("weight", "vec")).select(F.col("leader").alias("b"), "rows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked, rows = batch.column(1).slice(k, 1).flatten(), batch.column(2).slice(k, 1).flatten()
                linked = matrix(asked.field("vec")) @ matrix(rows.field("vec")).T >= threshold
                n = linked @ rows.field("weight").to_numpy()
                some = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([asked.field("node").take(some), asked.field("a").take(some), pa.array(np.full(len(some), batch.column(0)[k].as_py())), pa.array(n).take(some)], ["node", "a", "b", "n"])

    exact = asked.select("b", "asked").join(there, "b").select("b", "asked", "rows").mapInArrow(compare, "node long, a long, b long, n long")
    return stored(settled.unionByName(exact), "open_links")


def near_embeddings(rows: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    angle = math.acos(threshold)
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    linkable = F.col("label").isNotNull() & usable(F.col("embedding"))
    points = classes(rows.where(linkable), "vec_id", "embedding", "label")
    groups = clumps(points, angle)
    sums = groups.groupBy(F.col("leader").alias("node")).agg(F.max("angle").alias("radius"), F.sum("weight").alias("total"), F.min("least").alias("smallest"))
    leaders = stored(points.drop("weight", "least").join(sums, "node"), "leaders")
    nodes = leaders.withColumn("r", F.ceil(F.col("radius") * (BITS / math.pi)).cast("short"))

    near = near_bits(threshold)
    truth = audit(leaders, threshold)
    wanted = truth.count()

    def measured(lists: DataFrame) -> float:
        near_ones = lists.where(F.col("d") <= near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return truth.join(near_ones, ["a", "b"], "left_semi").count() / wanted if wanted else 1.0

    lists, found = neighbour_lists(nodes, near, measured, recall)
    if found < recall:
        warnings.warn(f"audited recall of the neighbour graph is {found:.3f}, under {recall}", stacklevel=2)
    pairs = leader_pairs(leaders, lists.where(F.col("d") <= near), angle)
    members = groups.select("node", "leader", "weight").join(points.select("node", "vec"), "node")
    single = open_links(pairs, members, leaders, angle, threshold)
    links = pairs.where("whole").select("a", "b").unionByName(single.select("a", "b")).distinct()
    return _joined(rows, linkable, points, groups, leaders, pairs, single, links)


def _joined(rows, linkable, points, groups, leaders, pairs, single, links) -> DataFrame:
    roots = stored(components(links), "roots")
    by_root = leaders.select("node", "smallest", "total").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = stored(by_root.groupBy("root").agg(F.min("smallest").alias("component")), "least")
    totals = leaders.select(F.col("node").alias("b"), F.col("total").alias("n"))
    outside = pairs.where("whole").select("a", "b").join(totals, "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("outside"))
    clump = by_root.join(least, "root").join(outside, "node", "left")
    clump = stored(clump.select(F.col("node").alias("leader"), "component", (F.col("total") - 1 + F.coalesce("outside", F.lit(0))).alias("n")), "clump_links")
    more = single.groupBy("node").agg(F.sum("n").alias("more"))
    told = groups.select("node", "leader").join(clump, "leader").join(more, "node", "left")
    told = told.select("node", "component", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    told = stored(points.select("node", "label", "vec").join(told, "node").drop("node"), "told")
    same = (rows["label"] == told["label"]) & (rows["embedding"] == told["vec"])
    component = F.when(F.col("component") > NULL_ID, F.col("component"))
    linked = rows.where(linkable).join(told, same).select("vec_id", F.col("n").cast("long").alias("n_links"), component.alias("component_id"))
    alone = rows.where(~linkable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))
