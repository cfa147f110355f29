"""Line dedup with content-defined chunks.

A rolling hash over the hashes of the last lines chooses the boundaries, so that a passage of lines is cut the same way wherever it
stands. There are chunks of two sizes. Long ones lie end to end: one ends where the hash is divisible by ``DIVISOR``, and lines at the end of a
text that are too few for a chunk belong to the one before them. Short ones overlap: at every line where the hash over it and the next line
with a word chooses it (all but one in ``SHORT_OF``), a chunk begins that ends as soon as it has ``MIN_LINES`` lines with a word and ``MIN_CHARS`` code
points. What chooses a short chunk lies within it, so a repeated passage needs no luck with the lines around it. Chunks whose 128-bit digest
recurs over the corpus are fetched from their documents and compared byte by byte with the earliest one by (document id, place); the lines of equal
ones are removed. A chunk whose digest agrees but whose bytes don't stays. A passage inside a line is not found here.

Chunks are judged on the input, not on what is left: a line goes if any chunk over it has an earlier equal. The earliest occurrence of a line by
(document id, place) is in no such chunk, so every text line of the corpus is kept at least once. Of one line repeated n times in a row, the first stays.

Defined results: null and empty texts stay; repeats of fewer than two lines with a word or ``MIN_CHARS`` code points stay; rows that share an id are ranked
by the hash of their texts, and exact repeats of a row are one document whose result each of them gets; of equal chunks in one document
the first stays; a very long text is cut whole, in one task; an empty table gives an empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import stored, table
from tidemark.llm.spans import cut_lines, keyed, spans_text

#: Lines under the rolling hash; a line ends a long chunk if the hash is divisible by DIVISOR; least and most lines of a chunk.
WINDOW, DIVISOR, MIN_LINES, MAX_LINES = 2, 6, 2, 64
#: A line begins a short chunk unless the hash over it and the next is divisible by SHORT_OF.
SHORT_OF = 8
#: Code points of a chunk, at least, so that a few empty or very short lines that recur by chance stay.
MIN_CHARS = 25
FACTOR, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
CHUNKS = "key_id long, key_text long, line int, n_lines int, start long, stop long, digest binary"


def rolling(lines: list[bytes]) -> list[int]:
    """The hash over the last WINDOW lines, at each line."""
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    power, rolled, out = pow(FACTOR, WINDOW, 1 << 64), 0, []
    for n, h in enumerate(hashes):
        rolled = (rolled * FACTOR + h - (hashes[n - WINDOW] * power if n >= WINDOW else 0)) & MASK
        out.append(rolled >> 32)
    return out


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, number of lines) of each long chunk; they lie end to end."""
    made, first = [], 0
    for n, h in enumerate(rolling(lines)):
        size = n - first + 1
        if size >= MAX_LINES or (size >= MIN_LINES and h % DIVISOR == 0):
            made.append((first, size))
            first = n + 1
    rest = len(lines) - first
    if rest and rest < MIN_LINES and made:
        made[-1] = made[-1][0], made[-1][1] + rest  # too few lines for a chunk of their own
    elif rest:
        made.append((first, rest))
    return made


def enough(raw: bytes) -> bool:
    return len(raw) >= 4 * MIN_CHARS or (len(raw) >= MIN_CHARS and len(raw.decode()) >= MIN_CHARS)


def short_chunks(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first line, number of lines) of each short chunk; they overlap."""
    real = [n for n, x in enumerate(lines) if x.strip()]
    hashes = rolling([lines[n] for n in real])
    for k, first in enumerate(real):
        if k + 1 < len(real) and hashes[k + 1] % SHORT_OF:
            for last in real[k + MIN_LINES - 1 : k + MAX_LINES]:
                if enough(b"\n".join(lines[first : last + 1])):
                    yield first, last - first + 1
                    break


def all_chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """The chunks of both sizes that count."""
    long = {(first, n) for first, n in chunks(lines) if n >= MIN_LINES and sum(1 for x in lines[first : first + n] if x.strip()) >= MIN_LINES and enough(b"\n".join(lines[first : first + n]))}
    return sorted(long.union(short_chunks(lines)))


def chunk_table(docs: DataFrame, text: str, keys: tuple[str, str]) -> DataFrame:
    """Offsets of the chunks count bytes of UTF-8."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                lines = x.split(b"\n")
                starts = [0, *itertools.accumulate(len(line) + 1 for line in lines)]
                for first, n in all_chunks(lines):
                    start, stop = starts[first], starts[first + n] - 1
                    rows.append((i, t, first, n, start, stop, hashlib.md5(x[start:stop], usedforsecurity=False).digest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

    return docs.where(F.col(text).isNotNull()).select(*keys, text).mapInArrow(cut, CHUNKS)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _bytes_of(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(raw, mine):
        return [raw[s["start"] : s["stop"]] for s in mine]

    return pd.Series([cut(x.encode(), mine) for x, mine in zip(texts, spans, strict=True)], dtype=object)


def dedup_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the kept text and ``removed`` (array of start, stop, line, n_lines of each maximal run of removed lines; byte offsets in
    the original), and the names of those two new columns."""
    docs, a, b = keyed(docs, doc_id, text)
    found = stored(chunk_table(docs, text, (a, b)), "chunks")
    rank = F.struct("key_id", "key_text", "line")
    firsts = stored(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")  # a stored side lets adaptive execution split hot digests
    again = found.join(firsts, "digest").withColumn("is_first", rank == F.col("first"))
    wanted = again.groupBy("key_id", "key_text").agg(F.collect_set(F.struct("digest", "start", "stop", "line", "n_lines", "is_first")).alias("spans"))
    texts = docs.select(F.col(a).alias("key_id"), F.col(b).alias("key_text"), F.col(text).alias("whole"))
    read = wanted.join(texts, ["key_id", "key_text"]).dropDuplicates(["key_id", "key_text"])
    read = read.select("key_id", "key_text", F.explode(F.arrays_zip("spans", _bytes_of("whole", "spans").alias("raw"))).alias("c"))
    read = stored(read.select("key_id", "key_text", "c.spans.*", F.col("c.raw").alias("raw")), "candidates")
    kept_ones = read.where("is_first").select("digest", F.col("raw").alias("first_raw"))
    equal = read.where(~F.col("is_first")).join(kept_ones, "digest").where(F.col("raw") == F.col("first_raw"))
    return cut_lines(docs, (a, b), equal, text)


def without_repeated_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the repeated chunks gone from ``text``, columns as they were."""
    columns = docs.columns
    out, kept, _ = dedup_chunks(docs, text=text)
    return out.select(*[F.col(kept).alias(c) if c == text else F.col(c) for c in columns])


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, kept, removed = dedup_chunks(docs)
    lines = F.aggregate(removed, F.lit(0).cast("long"), lambda s, x: s + x["n_lines"])
    return out.select(
        "doc_id",
        F.when(F.col(removed).isNull(), 0).otherwise(F.size(removed)).cast("long").alias("n_removed_runs"),
        F.coalesce(lines, F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce(spans_text(F.col(removed)), F.lit("")).alias("removed_spans"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"),
    )
