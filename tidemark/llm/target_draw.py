"""Importance resampling towards a target: documents are drawn by how much likelier their word runs are in the benchmark than in the corpus.

Each document's features (runs of one to ``RUNS`` words) fall into ``BUCKETS`` buckets. Counts over the whole corpus and the whole target give
each bucket a gain, an array of fixed size that every task gets, and a document's weight is the sum of its features' gains. A Gumbel
draw from the hash of its id is added, and the highest scores win. The cutoff comes from exact counts over the stored scores: an interval of
scores, then of tied ids, is cut at ``CUTS`` thresholds a job until one value is left. Only what was drawn is sorted, in ranges, for the ranks.

Defined results: a null text, an empty one and one without words have no features and weight 0 and are never drawn, since they have
fewer than ``LEAST_WORDS`` words; a null id counts as the empty string for the draw and comes before all others among ties; repeated rows each get a
row and are drawn each, and if the cutoff falls between rows of equal score and id, as many as fit are drawn (those of more features first); a
very long text is read whole, in one task; an empty target gives gains of an empty target; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import shuffle_partitions, stored, table

BUCKETS, RUNS, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Thresholds that one count job tries.
CUTS = 7
#: Bytes of words: digits, letters (capitals become small ones) and whatever isn't ASCII; all others separate.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_buckets(raw: bytes) -> tuple[int, np.ndarray]:
    """How many words a text of UTF-8 has, and the bucket of each of its features. A run's checksum goes on from that of the run one word shorter."""
    words = raw.translate(WORD_BYTES).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0, np.zeros(0, np.int64)
    found = [list(map(crc32, words))]
    after = list(map(b" ".__add__, words))
    for n in range(1, RUNS):
        found.append(list(map(crc32, after[n:], found[-1])))
    sizes = [len(x) for x in found]
    return len(words), np.concatenate([np.fromiter(x, np.int64, n) for x, n in zip(found, sizes, strict=True)]) % BUCKETS


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket: each task adds up its own, Spark adds the tasks' (a row a bucket), and the driver gets BUCKETS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()):
                total += np.bincount(feature_buckets(raw.as_py())[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = texts.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    made = np.zeros(BUCKETS, np.int64)
    for r in found.collect():
        made[r["bucket"]] = r["n"]
    return made


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = int(corpus.sum()), int(target.sum())
    ratio = lambda own, aim: (aim + 1) * (s + BUCKETS) / ((own + 1) * (t + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(own, aim))) for own, aim in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).cast(pa.binary()):
                n, at = feature_buckets(raw.as_py() or b"")
                rows.append((n, len(at), int(gain[at].sum())))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else repeat([], 3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """The draw of an id in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def cutoff(rows: DataFrame, value: str, wanted: int) -> tuple[int, int] | None:
    """The ``wanted``-th greatest ``value`` (counted from 1) and how many are greater, by counts alone. None if there are fewer rows."""
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if not 0 < wanted <= n:
        return None
    above = 0  # rows over ``high``
    while low < high:
        steps = sorted({low + (high - low) * k // (CUTS + 1) for k in range(1, CUTS + 1)} | {low})[1:] or [high]
        counts = rows.agg(*[F.count_if(F.col(value) >= F.lit(x)).alias(f"c{k}") for k, x in enumerate(steps)]).first()
        enough = [k for k, c in enumerate(counts) if c >= wanted]
        at = enough[-1] if enough else -1  # the answer is at steps[at] or over it, and under the step after
        if at + 1 < len(steps):
            high, above = steps[at + 1] - 1, counts[at + 1]
        low = steps[at] if at >= 0 else low
    return low, above


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` numbered from 1 in ``order``: dealt to ranges, numbered in each, and moved on by the sizes of the ranges before (a row for each
    range on the driver)."""
    spark = rows.sparkSession
    made = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    kinds = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done + 1, done + n + 1))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kinds])
            done += n

    made = stored(made.mapInArrow(numbered, kinds), "ranked")
    sizes = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts = spark.createDataFrame([(p, sum(n for _, n in sizes[:k])) for k, (p, _) in enumerate(sizes)], "part int, before long")
    return made.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("place") + F.col("before")).alias(name))


def draw(scored: DataFrame, wanted: int, fits: Column, spread: Callable[[], Column] = lambda: F.rand(SEED)) -> DataFrame:
    """``scored`` (``doc_id, score`` and more) with ``rank``: the ``wanted`` greatest scores of the rows that fit, ties to the smaller id, null first."""
    scored = stored(scored.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("spread", spread()), "scored")
    columns = [c for c in scored.columns if c not in ("fits", "spread")]
    lowest = -(1 << 63)
    found = cutoff(scored.where("fits"), "score", wanted)
    if found is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    score, above = found
    # among the tied, the least ids: those with the greatest complement
    tied = scored.where(F.col("fits") & (F.col("score") == score)).select(F.bitwise_not(F.coalesce("doc_id", F.lit(lowest))).alias("turned"))
    turned, _ = cutoff(tied, "turned", wanted - above)
    chosen = F.col("fits") & ((F.col("score") > score) | ((F.col("score") == score) & (F.bitwise_not(F.coalesce("doc_id", F.lit(lowest))) >= turned)))
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), *[F.desc(c) for c in columns if c not in ("doc_id", "score")], F.asc("spread")]
    drawn = ranked(scored.where(chosen), order, "rank").withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.select(*columns, "rank").unionByName(scored.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document's ``doc_id, n_words, n_features, weight, score, rank``; the rank is null where it isn't drawn."""
    weighed = weights(docs, gains(bucket_counts(docs), bucket_counts(target)))
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
    fits = F.col("n_words") >= least_words
    return draw(scored, percent * scored.where(fits).count() // 100, fits)


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
