"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the power of two of their number of distinct shingles (SHINGLE words; an item with fewer is one
shingle of its own length). An item's sketch is the bottom of its MinHash: the k least shingle hashes, k set for its partition
so that a document with a share of at least THRESHOLD of the item's shingles cannot miss all of them. A long document is searched
with the hashes of all its shingles, not with a signature of its own: signatures of equal length lose items that are a few
thousandths of a document. Candidates are verified by exact shingle containment, on words and not on hashes.

The items are the stated query set. They are taken in blocks of at most BLOCK_SHINGLES shingles, so that what the driver and every task
hold is bounded whatever the size of the benchmark; each block goes once over the documents, which never move, and is done and
given up before the next one is read.

Words are what stands between white space and ASCII punctuation, in lower case. Defined results: a null or empty text and an item
without a word match nothing; an item without an id matches like any other; repeated rows and items, and items of one id, match each;
a document that matches several items has a row for each; a null document id is carried; a very long text is searched whole, in one
task; empty tables give an empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, stored, table

SHINGLE, THRESHOLD, BLOCK_SHINGLES = 5, 0.8, 500_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
MATCH = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())]))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(PUNCTUATION).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out = out * FACTOR + h[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return set(zip(*[words[k:] for k in range(size)], strict=False))


@dataclass
class Block:
    """The items of one block, by their place in it; ``ids`` has the id of each, which may be null. ``sketches`` has, by shingle length, the sorted sketch hashes, a filter on their low bits and the
    items of each."""

    items: dict[int, tuple[int, set[tuple[bytes, ...]]]] = field(default_factory=dict)
    ids: list[int | None] = field(default_factory=list)
    sketches: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = field(default_factory=dict)
    n: int = 0

    def close(self) -> Block:
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        partitions: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item, (size, own) in self.items.items():
            partitions[size, len(own).bit_length()].append(item)
        for (size, _), members in partitions.items():
            most = max(len(self.items[i][1]) for i in members)
            k = most - ceil(THRESHOLD * most - 1e-9) + 1
            for i in members:
                own = sorted(self.items[i][1])
                hashes = np.array([shingle_hashes(word_hashes(list(s)), size)[0] for s in own], np.uint64)
                for h in np.sort(hashes)[:k].tolist():
                    found[size][h].append(i)
        for size, by_hash in found.items():
            keys = np.array(sorted(by_hash), np.uint64)
            low = np.zeros(1 << 22, bool)
            low[keys & np.uint64((1 << 22) - 1)] = True
            self.sketches[size] = keys, low, [by_hash[h] for h in keys.tolist()]
        return self

    def search(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(id of an item, its shingles, those that the text has) of each item that the text contains."""
        words = words_of(text)
        if not words:
            return []
        h, out = word_hashes(words), []
        for size, (keys, low, items) in self.sketches.items():
            own = shingle_hashes(h, size)
            own = own[low[own & np.uint64((1 << 22) - 1)]]
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            candidates = {i for k in np.unique(at[keys[at] == own]).tolist() for i in items[k]}
            if candidates:
                there = shingles(words, size)
                for i in sorted(candidates):
                    wanted = self.items[i][1]
                    shared = len(wanted & there)
                    if shared >= THRESHOLD * len(wanted) - 1e-9:
                        out.append((self.ids[i], len(wanted), shared))
        return out


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Block]:
    """The items, read partition by partition, in closed blocks. Items are numbered within a block by their place; equal and
    null ids count as one item each."""
    block, ids = Block(), benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator()
    for row in ids:
        words = words_of(row["t"])
        if not words:
            continue
        size = min(SHINGLE, len(words))
        own = shingles(words, size)
        if block.n and block.n + len(own) > BLOCK_SHINGLES:
            yield block.close()
            block = Block()
        block.items[len(block.ids)] = size, own
        block.ids.append(row["i"])
        block.n += len(own)
    if block.n:
        yield block.close()


def contained(shared: Broadcast) -> Callable[[Column], Column]:
    """A column function: the items of a broadcast block that a text contains."""

    @F.pandas_udf(MATCH)
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item": i, "n_shingles": n, "n_shared": s} for i, n, s in shared.value.search(x)] for x in texts], dtype=object)

    return search


def by_block(spark: SparkSession, benchmark: DataFrame, rows_of: Callable[[Callable], DataFrame]) -> Iterator[DataFrame]:
    """``rows_of(search)`` for each block. The rows of all blocks but the last are stored before the next block is made."""
    ahead = blocks(benchmark)
    block = next(ahead, None)
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        rows, block = rows_of(contained(shared)), next(ahead, None)
        if block is not None:
            rows = stored(rows, "searched")
            shared.destroy()
        yield rows


RESULT = ("item_id", "n_shingles", "n_shared", "containment")


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document and item that it contains: carried columns, ``item_id, n_shingles, n_shared, containment``. Carried columns of these
    names must be renamed before."""
    if clash := {c.lower() for c in carried} & set(RESULT):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    name = free_name(docs, "found_item")
    parts = list(by_block(docs.sparkSession, benchmark, lambda search: docs.select(*carried, F.explode(search(F.col(text))).alias(name))))
    out = reduce(DataFrame.unionByName, parts) if parts else docs.limit(0).select(*carried, F.explode(F.lit(None).cast(MATCH)).alias(name))
    found = F.col(name)
    shares = (found["item"], found["n_shingles"], found["n_shared"], found["n_shared"] / found["n_shingles"])
    return out.select(*carried, *[c.alias(n) for c, n in zip(shares, RESULT, strict=True)])


def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with their own columns."""
    columns, flag, left = docs.columns, free_name(docs, "found_items"), [docs]
    for rest in by_block(docs.sparkSession, benchmark, lambda search: left[-1].withColumn(flag, search(F.col(text))).where(F.size(flag) == 0).select(*columns)):
        left.append(rest)
    return left[-1]


def op6_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS did, doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D!-/:-@\[-`{-~]+') AS ws FROM documents),
b AS (SELECT iid, item_id, ws, least(5, len(ws)) AS k FROM
  (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D!-/:-@\[-`{-~]+') AS ws FROM benchmark) WHERE len(ws) > 0),
bs AS (SELECT DISTINCT iid, k, array_to_string(ws[i:i + k - 1], ' ') AS s
  FROM (SELECT iid, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
n AS (SELECT iid, count(*) AS n_shingles FROM bs GROUP BY iid),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT did, k, array_to_string(ws[i:i + k - 1], ' ') AS s
  FROM (SELECT did, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
m AS (SELECT did, iid, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY did, iid)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN n USING (iid) JOIN d USING (did) JOIN b USING (iid) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""
