"""Near copies at a Jaccard similarity of ``SHINGLE``-word shingles of THRESHOLD or more: the corpus pipeline's use of the SimHash operator.

Texts of one word sequence are collapsed first. Candidates come from two searches, and count only if their exact similarity is at
least ``threshold``:

* the vantage-point tree of :mod:`tidemark.llm.simhash_vp` over fingerprints of the same shingles, at its radius of two bits;
* MinHash bands. Two texts at similarity 0.8 differ in about ten of 64 fingerprint bits. At a radius that covers this the triangle
  bound prunes nothing, since distances of unrelated texts spread over four bits only, so the tree alone finds about half of the
  near copies. BANDS bands of ROWS MinHash values miss a pair at 0.8 with a chance of (1 - 0.8^ROWS)^BANDS, 7e-5.

Candidates are compared in two rounds. First each text with the first one of its fingerprint or of a linked fingerprint, and each
member of a band's bucket with the bucket's pivot, the member with the fullest buckets. Then the pairs of a bucket that the
first round left in different components, but for those that their MinHash signatures and their bottom-k sketches (all shingle
hashes of a text with at most SKETCH of them) show to be less similar; a pair is compared in the first band that it shares. Members of
a bucket's largest component are not compared with each other, but, in blocks, with those outside it. Components of all confirmed pairs are the groups.

Defined results: null and empty texts are copies of each other; a text shorter than a shingle is one shingle; null document ids rank
before all, and rows that share an id are ranked by the hash of their texts; repeated rows are copies; a very long text is read whole, in one
task; an empty table gives an empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.components import components
from tidemark.llm.contamination import shingle_hashes, shingles, word_hashes
from tidemark.llm.simhash_vp import keep_firsts, majority, near_links
from tidemark.llm.spans import keyed

SHINGLE, THRESHOLD, BANDS, ROWS, SEED = 5, 0.8, 24, 5, 11
#: Of the BANDS * ROWS signature values, so many agree in a pair that is compared in the second round: 3.8 deviations below 0.8.
LEAST = 79
#: Hashes of a sketch; deviations below the threshold that an estimate from cut sketches may lie; members of a block of a bucket.
SKETCH, SLACK, BLOCK = 512, 4.0, 4096
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MIX = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []


def own_shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return shingles(words, min(size, len(words))) if words else set()


def own_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hash of each shingle of ``words``, which is not empty, repeats included."""
    return shingle_hashes(word_hashes(words), min(size, len(words)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS functions of the upper half of the shingle hashes."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), 256):
        np.minimum(least, (h[at : at + 256, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each band of each row of ``signatures``."""
    x = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(x), 1))
    for k in range(ROWS):
        h = (h ^ x[:, :, k]) * _MIX[k]
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


SIGNED = "key_id long, key_text long, digest binary, fp long, bands array<long>, sig binary"


def signed(docs: DataFrame, text: str, keys: tuple[str, str], size: int) -> DataFrame:
    """A row for each row of ``docs``: its key, a digest of its words, its fingerprint, its bands and a byte of each signature value."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, bands, sigs = [], [], [], []
            for raw in batch.column(2).cast(pa.binary()).to_pylist():
                words = words_of(raw)
                digests.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest())
                if words:
                    h = own_hashes(words, size)
                    s = signature(h)
                    prints.append(majority(h))
                    bands.append(band_keys(s)[0].tolist())
                    sigs.append((s * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes())
                else:
                    prints.append(0)
                    bands.append([])
                    sigs.append(b"")
            columns = [pa.array(digests, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [c.split()[0] for c in SIGNED.split(", ")])

    return docs.select(F.col(keys[0]).alias("key_id"), F.col(keys[1]).alias("key_text"), text).mapInArrow(made, SIGNED)


def texts_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, whole`` for each of ``nodes``, stored."""
    wanted = nodes.distinct().join(classes.select("node", "first.*"), "node")
    return stored(wanted.join(texts, ["key_id", "key_text"]).select("node", "whole").dropDuplicates(["node"]), "texts")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar enough."""
    read = texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), classes, texts)
    side = lambda c: read.select(F.col("node").alias(c), F.col("whole").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                mine, other = own_shingles(words_of(x.as_py().encode()), size), own_shingles(words_of(y.as_py().encode()), size)
                shared = len(mine & other)
                if shared >= threshold * (len(mine) + len(other) - shared) - 1e-9:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return stored(both.mapInArrow(similar, "a long, b long"), "confirmed")


def sketches(nodes: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``node, sketch``: the SKETCH least distinct shingle hashes of each node's text, ascending."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(1).cast(pa.binary()).to_pylist()
            made = [np.unique(own_hashes(words_of(x), size))[:SKETCH].tobytes() for x in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["node", "sketch"])

    return stored(texts_of(nodes, classes, texts).mapInArrow(made, "node long, sketch binary"), "sketches")


def may_reach(one: np.ndarray, others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of ``others`` may be as similar to ``one`` as ``threshold``, by their sketches."""
    values = np.concatenate(others)
    lengths = np.array([len(x) for x in others])
    shared = np.bincount(np.repeat(np.arange(len(others)), lengths)[np.isin(values, one)], minlength=len(others))
    reach = shared >= threshold * (len(one) + lengths - shared) - 1e-9
    for k in np.flatnonzero((lengths == SKETCH) | (len(one) == SKETCH)).tolist():
        least = np.union1d(one, others[k])[:SKETCH]  # the sketch of both texts together
        both = np.isin(least, one, assume_unique=True) & np.isin(least, others[k], assume_unique=True)
        reach[k] = both.mean() >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / len(least))
    return reach


def open_pairs(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The pairs of a group of :func:`in_blocks`, one of them outside the bucket's largest component, that are in different
    components, may be similar enough and share no earlier band."""
    frame = frame.sort_values("node", ignore_index=True)
    node, root, part, outside = (frame[c].to_numpy() for c in ("node", "root", "part", "outside"))
    band, within, across = frame["band"][0], frame["within"][0], frame["one"][0] != frame["two"][0]
    sig = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(len(frame), -1)
    bands = np.array(frame["bands"].tolist(), np.int64)
    sketch = [np.frombuffer(x, np.uint64) for x in frame["sketch"]]
    a, b = [], []
    for i in np.flatnonzero(outside).tolist():
        near = np.flatnonzero((root != root[i]) & ((sig == sig[i]).sum(axis=1) >= LEAST))
        if within:
            near = near[~outside[near] | (near > i)]
            if across:
                near = near[part[near] != part[i]]
        else:
            near = near[~outside[near]]
        if not len(near):
            continue
        near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == band]
        if len(near):
            near = near[may_reach(sketch[i], [sketch[k] for k in near.tolist()], threshold)]
        a.append(np.full(len(near), node[i]))
        b.append(node[near])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def in_blocks(members: DataFrame) -> DataFrame:
    """``members`` (``band, node, root``) dealt to groups ``band, within, one, two`` for comparison. Pairs inside the largest component of a
    bucket need no look, so blocks of the members outside it meet blocks of those inside it: a bucket of which all but a few members are
    settled copies each of those once, whatever its size. Pairs of blocks outside are groups ``within``; a bucket of one block of each is one
    such group."""
    sizes = members.groupBy("band", "root").agg(F.count("*").alias("k"))
    facts = sizes.groupBy("band").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("top"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    facts = facts.select("band", F.col("top.root").alias("most"), blocks(F.col("top.k")).alias("n_in"), blocks(F.col("n") - F.col("top.k")).alias("n_out"))
    dealt = members.select("band", "node", "root").join(stored(facts, "facts"), "band").withColumn("outside", F.col("root") != F.col("most"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("n_out")).otherwise(F.col("n_in"))).cast("int"))
    group = lambda within, one, two: F.struct(within.alias("within"), one.alias("one"), two.alias("two"))
    single, part = (F.col("n_out") == 1) & (F.col("n_in") == 1), F.col("part")
    meets_in = F.transform(F.sequence(F.lit(0), F.col("n_in") - 1), lambda k: group(single, part, F.when(single, part).otherwise(k)))
    meets_out = F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda k: group(F.lit(True), F.least(part, k), F.greatest(part, k)))
    is_met = F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda k: group(single, k, F.when(single, k).otherwise(part)))
    groups = F.when(~F.col("outside"), is_met).when(single, meets_in).otherwise(F.concat(meets_in, meets_out))
    return dealt.select("band", "node", "root", "outside", "part", F.explode(groups).alias("g")).select("band", "node", "root", "outside", "part", "g.*")


def near_copies(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key_id, key_text, first`` for each row: ``first`` is the least (key_id, key_text) of its group. Recall holds for
    thresholds from THRESHOLD on."""
    rows, a, b = keyed(docs, doc_id, text)
    texts = rows.select(F.col(a).alias("key_id"), F.col(b).alias("key_text"), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    all_signed = stored(signed(rows, text, (a, b), size), "signed")
    made = all_signed.groupBy("digest").agg(F.min(F.struct("key_id", "key_text")).alias("first"), *[F.first(c).alias(c) for c in ("fp", "bands", "sig")])
    classes = stored(made.withColumn("node", F.monotonically_increasing_id()), "classes")

    # candidates by fingerprint: each text with the first of its own, and the firsts of linked ones
    prints = stored(classes.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    same_print = classes.select("fp", "node").join(prints, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    rep = lambda c: prints.select(F.col("fp").alias(f"fp_{c}"), F.col("rep").alias(c))
    linked = near_links(prints).toDF("fp_a", "fp_b").join(rep("a"), "fp_a").join(rep("b"), "fp_b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    # candidates by band: each member with the pivot of its bucket
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = stored(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stored(banded.join(buckets, "band"), "members")
    weights = stored(members.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    weighted = members.select("band", "node").join(weights, "node")
    pivots = stored(weighted.groupBy("band").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot")), "pivots")
    starred = members.join(pivots, "band").where("node <> pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b"))
    compared = stored(starred.unionByName(same_print).unionByName(linked).distinct(), "pairs")
    links = confirmed(compared, classes, texts, size, threshold)

    roots = components(links)
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, "rooted")
    split = stored(rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band"), "split")
    left = stored(rooted.join(split, "band"), "left")
    facts = classes.select("node", "sig", "bands").join(sketches(left.select("node"), classes, texts, size), "node")
    grouped = in_blocks(left).join(stored(facts, "facts"), "node").groupBy("band", "within", "one", "two")
    more = grouped.applyInPandas(lambda frame: open_pairs(frame, threshold), "a long, b long")
    more = stored(more.join(compared, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        roots = components(links.unionByName(confirmed(more, classes, texts, size, threshold)))

    grouped = classes.select("digest", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = stored(grouped.groupBy("root").agg(F.min("first").alias("least")), "firsts")
    of_class = stored(grouped.join(firsts, "root").select("digest", F.col("least").alias("first")), "groups")
    return all_signed.select("key_id", "key_text", "digest").join(of_class, "digest").drop("digest")


def first_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of every group the least document, once."""
    return keep_firsts(docs, near_copies(docs, doc_id=doc_id, text=text), doc_id, text)
