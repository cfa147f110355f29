"""SimHash near-dedup through a vantage-point tree.

Every whole text gets a 64-bit fingerprint from its three-word shingles. Distinct fingerprints (copies are collapsed first) go to
the leaves of a vantage-point tree that is fitted on a bounded sample. At an inner node with vantage v and radius m, a
fingerprint at distance d goes to the near side if d < m + RADIUS and to the far side if d >= m. By the triangle inequality two
fingerprints within RADIUS of each other always share a leaf: if one is near (d < m), the other has d < m + RADIUS. So each
leaf, a shard, finds its pairs alone and exactly. Inside a leaf the same split goes on down to small blocks, which
are compared in full; pairs are joined at once, so a leaf gives at most one link a fingerprint. Components of all links give the
result.

Defined results: a null or empty text has fingerprint zero and links like any other; null document ids rank before all; repeated
rows each get a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, shuffle_partitions, stored, table
from tidemark.llm.components import components
from tidemark.llm.spans import NULL_ID, keyed

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a leaf, as aimed at: at least, so that few rows still make some leaves, and at most, since every level of the tree
#: repeats a fifth of them. Sampled fingerprints for each leaf; most sampled; block that is compared in full.
LEAF, LARGE_LEAF, SAMPLE_PER_LEAF, MAX_SAMPLE, BLOCK = 4096, 65_536, 64, 1 << 18, 192


def fingerprint(raw: bytes | None) -> int:
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        h = [digest(b" ".join(words), SEED)]
    else:
        h = [digest(s, SEED) for s in map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)], strict=False))]
    return majority(np.array(h, "<u8"))


def majority(values: np.ndarray) -> int:
    """The fingerprint of a text from the hashes of its shingles: the bits that are set in over half of them."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):
        part = values[at : at + 65536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key_id, key_text, fp``, stored; the fingerprint as a signed long."""
    docs, a, b = keyed(docs, doc_id, text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(2).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["key_id", "key_text", "fp"])

    return stored(docs.select(F.col(a).alias("key_id"), F.col(b).alias("key_text"), text).mapInArrow(made, "key_id long, key_text long, fp long"), "fingerprints")


def distance(values: np.ndarray, to) -> np.ndarray:
    return np.bitwise_count(values ^ to)


def split_radius(d: np.ndarray) -> int | None:
    """A radius that halves the distances about evenly, None if all are one."""
    low, high = int(d.min()), int(d.max())
    if low == high:
        return None
    return min(max(int(np.median(d)), low + 1), high)


def build(sample: np.ndarray, leaves: int) -> list:
    """The tree as a list of nodes: (vantage, radius, near, far), or None for a leaf; the root is first."""
    nodes: list = []

    def grow(values: np.ndarray, wanted: float) -> int:
        at = len(nodes)
        nodes.append(None)
        if wanted > 1 and len(values) >= 4:
            d = distance(values[1:], values[0])
            if (m := split_radius(d)) is not None:
                near = values[1:][d < m + RADIUS]
                far = values[1:][d >= m]
                if max(len(near), len(far)) < 0.9 * len(values):
                    total = len(values) - 1
                    nodes[at] = (values[0], m, grow(near, wanted * len(near) / total), grow(far, wanted * len(far) / total))
        return at

    grow(sample, leaves)
    return nodes


def route(nodes: list, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, places of the values that go there)."""
    stack = [(0, np.arange(len(values)))]
    while stack:
        at, mine = stack.pop()
        if not len(mine):
            continue
        if nodes[at] is None:
            yield at, mine
            continue
        vantage, m, near, far = nodes[at]
        d = distance(values[mine], vantage)
        stack += [(near, mine[d < m + RADIUS]), (far, mine[d >= m])]


class Union:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        different = self.root[a] != self.root[b]
        for i, j in zip(a[different].tolist(), b[different].tolist(), strict=True):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.root[max(i, j)] = min(i, j)


def link(values: np.ndarray) -> np.ndarray:
    """For each of the distinct ``values``, the place of the least one that it is linked to, over any number of steps."""
    union = Union(len(values))
    stack = [(np.arange(len(values)), 0)]
    while stack:
        mine, depth = stack.pop()
        if len(mine) > BLOCK:
            v = values[mine]
            d = distance(v, v[(depth * 7919) % len(v)])
            m = split_radius(d)
            if m is not None:
                near, far = mine[d < m + RADIUS], mine[d >= m]
                if max(len(near), len(far)) < 0.9 * len(mine):
                    stack += [(near, depth + 1), (far, depth + 1)]
                    continue
        step = max(1, (1 << 20) // max(1, len(mine)))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            a, b = np.nonzero(distance(values[rows][:, None], values[mine][None, at:]) <= RADIUS)
            upper = b > a
            if upper.any():
                union.join(rows[a[upper]], mine[at + b[upper]])
    return np.array([union.find(i) for i in range(len(values))], np.int64)


def near_links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect all that lie within RADIUS."""
    spark = distinct.sparkSession
    n = distinct.count()
    leaves = -(-n // min(LARGE_LEAF, max(LEAF, n // (4 * shuffle_partitions(spark)))))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(min(MAX_SAMPLE, SAMPLE_PER_LEAF * leaves)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = spark.sparkContext.broadcast(build(sample, leaves))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for leaf, mine in route(nodes.value, fps.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), leaf, np.int32)), pa.array(fps[mine])], ["leaf", "fp"])

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(frame["fp"].to_numpy(np.int64))
        root = link(fps.view(np.uint64))
        mine = root != np.arange(len(fps))
        return pd.DataFrame({"a": fps[mine], "b": fps[root[mine]]})

    return distinct.select("fp").mapInArrow(routed, "leaf int, fp long").groupBy("leaf").applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key_id, key_text, fp, first`` for each row: ``first`` is the least (key_id, key_text) of its component."""
    prints = fingerprints(docs, doc_id, text)
    classes = stored(prints.groupBy("fp").agg(F.min(F.struct("key_id", "key_text")).alias("first")), "classes")
    roots = components(near_links(classes)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    # stored, so that adaptive execution can split a fingerprint that very many rows share
    of_class = stored(rooted.select("fp", "root").join(firsts, "root").select("fp", "first"), "groups")
    return prints.join(of_class, "fp")


def first_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of every component the least document, once."""
    return keep_firsts(docs, near_duplicates(docs, doc_id, text), doc_id, text)


def keep_firsts(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose key is the ``first`` of its row in ``found``, once each. Of several rows with one id and text the one stays
    whose other columns, as JSON, come first."""
    kept = found.where(F.struct("key_id", "key_text") == F.col("first")).select("key_id", "key_text").distinct()
    rows, a, b = keyed(docs, doc_id, text)
    at, tie = free_name(rows, "kept_id"), free_name(rows, "kept_tie")
    kept = kept.select(F.col("key_id").alias(at), F.col("key_text").alias(tie))
    firsts = rows.join(kept, (F.col(a) == F.col(at)) & (F.col(b) == F.col(tie)), "left_semi")
    others = F.to_json(F.struct(*[c for c in docs.columns if c != text]), {"ignoreNullFields": "false"})
    whole = free_name(docs, "whole_row")
    return firsts.groupBy(a, b).agg(F.min_by(F.struct(*docs.columns), others).alias(whole)).select(f"{whole}.*")


def op7_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    named = lambda c: F.when(c != NULL_ID, c)
    return found.select(named(F.col("key_id")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), named(F.col("first.key_id")).alias("component_id"))
