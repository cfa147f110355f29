"""Token-id files in Simple-8b.

Documents are dealt out in ascending id order by ranges, encoded, and written as a Parquet table of segments. A segment
holds whole documents and is one row: the documents' ids and lengths, the ids before it in its shard, and the packed
words with the word offset of every block, so any block can be decoded on its own. A failed task is written again by
Spark's commit protocol; no shard depends on another.

A 64-bit word has a 4-bit selector and 60 bits. Selector s from 1 to 14 holds COUNTS[s] ids of BITS[s] bits, the first in the
lowest bits. Selector 0 is the escape: the next word is one value of up to 64 bits. Ids of a block are packed greedily, the
longest run that fits first; the last word of a block is filled with zeros.

Defined results: a null text is empty and has only the end id; null document ids come first; repeated ids are ordered by
text and each keeps a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_path, shuffle_partitions, table
from tidemark.llm.tokens import batched, encoder

END_ID = 2
BLOCK, SEGMENT = 16_384, 262_144
#: Ids in a word, and bits of an id, by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
#: Bits that the values of two bytes need.
SMALL_NEED = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
SEGMENTS = (
    "shard int, segment int, before long, n_ids long, doc_ids array<bigint>, doc_lengths array<int>, "
    "block_words array<int>, words binary"
)


def pack(values: np.ndarray) -> np.ndarray:
    """One block's values (uint64) as Simple-8b words."""
    n = len(values)
    v = np.concatenate([values.astype(np.uint64), np.zeros(60, np.uint64)])
    if v.max() < len(SMALL_NEED):
        need = SMALL_NEED[v]
    else:
        need = np.frexp(v.astype(np.float64))[1].astype(np.uint8)
        need[v >= np.uint64(1 << 53)] = 60  # floats round up there
        need[v >= np.uint64(1 << 60)] = 64  # escaped
    selector, runs = np.zeros(n, np.uint8), 1
    for s in range(len(COUNTS) - 1, 0, -1):
        # the widest need of the next COUNTS[s] values, from two overlapping shorter stretches
        further = int(COUNTS[s]) - runs
        if further:
            need = np.maximum(need[:-further], need[further:])
        runs = int(COUNTS[s])
        fits = need[:n] <= BITS[s]
        if not fits.any():
            break  # longer runs need as many bits at least, and have fewer
        np.putmask(selector, fits, s)
    steps = COUNTS[selector].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.array(starts, np.int64)
    chosen = selector[first].astype(np.int64)
    place = np.cumsum(np.where(chosen == 0, 2, 1)) - np.where(chosen == 0, 2, 1)
    words = np.zeros(int(place[-1]) + (2 if chosen[-1] == 0 else 1) if n else 0, np.uint64)
    for s in np.unique(chosen):
        mine = chosen == s
        if s == 0:
            words[place[mine] + 1] = v[first[mine]]
            continue
        lanes = np.arange(COUNTS[s])
        packed = np.bitwise_or.reduce(v[first[mine][:, None] + lanes] << (lanes * BITS[s]).astype(np.uint64), axis=1)
        words[place[mine]] = packed | np.uint64(int(s) << 60)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of one block's words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():
        at = 0
        for i in np.flatnonzero(selector == 0).tolist():
            if i >= at:  # else it is an escaped value itself
                raw[i + 1] = True
                at = i + 2
    heads = np.flatnonzero(~raw)
    chosen = selector[heads]
    counts = COUNTS[chosen]
    offsets = np.cumsum(counts) - counts
    narrow = BITS[chosen].max(initial=0) <= 30 and not raw.any()
    out = np.zeros(int(counts.sum()), np.uint32 if narrow else np.uint64)
    for s in np.unique(chosen):
        mine = chosen == s
        if s == 0:
            out[offsets[mine]] = words[heads[mine] + 1]
            continue
        lanes = np.arange(COUNTS[s])
        mask = np.uint64((1 << int(BITS[s])) - 1)
        out[offsets[mine][:, None] + lanes] = (words[heads[mine]][:, None] >> (lanes * BITS[s]).astype(np.uint64)) & mask
    return out[:n]


def pack_segment(ids: np.ndarray) -> tuple[bytes, list[int]]:
    blocks = [pack(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1]
    return b"".join(x.astype("<u8").tobytes() for x in blocks), offsets.tolist()


def unpack_segment(words: bytes, offsets: list[int], n: int) -> np.ndarray:
    w = np.frombuffer(words, "<u8")
    ends = [*offsets[1:], len(w)]
    parts = [unpack(w[a:b], min(BLOCK, n - k * BLOCK)) for k, (a, b) in enumerate(zip(offsets, ends, strict=True))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def write_id_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the segments to ``path``, shards in ascending document order."""
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, bytes]] = []
        size = 0
        encode = encoder(tokenizer, drops_space=False)

        def segment() -> pa.RecordBatch:
            nonlocal made, before, held, size
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            words, offsets = pack_segment(ids)
            row = [[shard], [made], [before], [len(ids)], [[d for d, _ in held]], [[len(x) // 4 for _, x in held]], [offsets], [words]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            made, before, held, size = made + 1, before + len(ids), [], 0
            names = [c.split()[0] for c in SEGMENTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batched(texts):
                for key, ids in zip(keys[a:b], encode.ids(texts[a:b]), strict=True):
                    held.append((key, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT:
                        yield segment()
        if held:
            yield segment()

    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, all from the files at ``path``.

    Only the shards' totals (a row each) are brought together to find where each shard starts."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = memoryview(unpack_segment(row["words"], row["block_words"], row["n_ids"]).astype("<u4", copy=False)).cast("B")
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                start = row["shard_start"] + row["before"] + ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    joined = files.join(F.broadcast(starts), "shard")  # as many rows as the writer had partitions
    columns = joined.select("shard_start", "before", "n_ids", "doc_ids", "doc_lengths", "block_words", "words")
    return columns.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "id-files")
    write_id_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_id_files(spark, path)
