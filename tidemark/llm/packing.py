"""Best-fit packing with certified bounds.

Documents become pieces of at most ``capacity`` tokens; only longer ones are cut. Pieces get a stored draw, so that equal ones spread
too, are dealt by it to groups of a bounded size, and each group is packed by best-fit decreasing. Dual-feasible functions give each
group a lower bound on its number of bins: a group that meets it is certified, and packing it again alone is of no use. A group
with a gap to its bound, or to its volume (which pieces of other groups may fill), gives up all bins that are not full, any other only
its emptiest. What was given up is dealt to fewer and larger groups (up to MAX_GROUP pieces) and packed again, until the bound of
the whole table (from the histogram of lengths) is met or a round saves fewer than LEAST_SAVED of the bins that it opened.

Defined results: a null text is empty and has the end id only; a null id is carried; repeated rows are packed each; pieces of equal length are
taken by id, piece and checksum; a very long text is encoded whole, in one task, and makes many pieces; an empty table gives an empty
result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.tokens import batched, encoder

CAPACITY, END_ID = 2048, 0
#: Pieces of a group, as aimed at: in the first round, and at most (each round has four times the pieces of the one before).
GROUP, MAX_GROUP = 32_768, 131_072
#: A round of exchange that saves a smaller share of the bins that it opened is the last; with few bins every saving counts.
LEAST_SAVED = 1e-4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, draw long, sequence_id long, offset long, released boolean, n_bins long, bound long"


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the plain sum, of the functions that count items over capacity - e as
    whole bins and ignore items under e, and of the rounding functions u_k(x) = floor((k + 1) x) / k."""
    x = lengths.astype(np.int64)
    best = -(-int((x * counts).sum()) // capacity)
    for e in np.unique(np.minimum(x, capacity - x))[:capacity]:
        if 0 < e <= capacity // 2:
            whole, middle = x > capacity - e, (x >= e) & (x <= capacity - e)
            best = max(best, int(counts[whole].sum()) - (-int((x * counts)[middle].sum()) // capacity))
    for k in range(1, 12):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0  # u_k leaves such x as they are
        parts = np.where(exact, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((parts * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item. The open bins are kept by room left; a bit set finds the tightest fit."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at, n = capacity, n, n + 1
        bins[i], offsets[i] = at, capacity - room
        if left := room - size:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, drops_space=True)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batched(texts):
                rows = []
                for key, ids in zip(keys[a:b], encode.ids(texts[a:b]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def _packed(rows: DataFrame, n_groups: int, turn: int, capacity: int) -> DataFrame:
    """Deal ``rows`` to groups and pack each group; ``released`` marks what the group would exchange."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        sizes, counts = np.unique(lengths, return_counts=True)
        bound = lower_bound(sizes, counts, capacity)
        gap = len(fill) > bound or len(fill) - lengths.sum() / capacity >= 1
        given = (fill < capacity) if gap else (np.arange(len(fill)) == fill.argmin()) & (fill < capacity)
        frame["sequence_id"] = ((turn << 30) + int(frame["group"][0]) << 24) + bins
        frame["offset"], frame["released"], frame["n_bins"], frame["bound"] = offsets, given[bins], len(fill), bound
        return frame[[c.split()[0] for c in PLACED.split(", ")]]

    key = F.xxhash64("draw", F.lit(turn))
    return rows.withColumn("group", F.pmod(key, F.lit(n_groups)).cast("int")).groupBy("group").applyInPandas(pack, PLACED)


def with_draw(rows: DataFrame) -> DataFrame:
    """``rows``, stored with a number of their own."""
    return stored(rows.withColumn("draw", F.monotonically_increasing_id()), "pieces")


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    names = [*rows.columns, "sequence_id", "offset"]
    rows = with_draw(rows)
    histogram = rows.groupBy("length").count().toPandas()  # a row per length: at most ``capacity``
    if not len(histogram):
        return rows.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).select(*names)
    total = int(histogram["count"].sum())
    bound = lower_bound(histogram["length"].to_numpy(), histogram["count"].to_numpy(), capacity)
    closed: list[DataFrame] = []
    current = stored(_packed(rows, -(-total // group), 0, capacity), "packed")
    n_closed, turn, going = 0, 1, True
    while going:
        bins = current.groupBy("sequence_id").agg(F.first("released").alias("released"), F.count("*").alias("n"))
        n_open, n_done, n_pieces = (int(x or 0) for x in bins.agg(F.sum(F.col("released").cast("long")), F.sum((~F.col("released")).cast("long")), F.sum(F.when(F.col("released"), F.col("n")))).first())
        if n_closed + n_done + n_open <= bound or n_open < 2:
            break
        again = stored(_packed(current.where("released").select(*rows.columns), -(-n_pieces // min(group * 4**turn, max(group, MAX_GROUP))), turn, capacity), "packed")
        saved = n_open - again.select("sequence_id").distinct().count()
        if saved <= 0:
            break
        closed.append(current.where(~F.col("released")).select(*names))
        n_closed += n_done
        current, turn, going = again, turn + 1, saved >= LEAST_SAVED * n_open
    out = current.select(*names)
    for part in closed:
        out = out.unionByName(part)
    return out


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack_pieces(pieces(docs, tokenizer))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
