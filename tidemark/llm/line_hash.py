"""Substring dedup by hashed lines, sentences of a line, or paragraphs.

Units are normalised (lower case, white space runs made one space, trimmed) and digested with 128 bits. Digests are grouped over the
corpus and the earliest unit by (document id, place) stays. The later ones are repeats. A run of adjacent repeats is removed if
it has at least ``run_chars`` normalised characters; a shorter run stays, since licence lines, phrases of a sentence or two and texts of
a few words recur in documents that are otherwise their own. The length counts characters and not words, so that it means about the same
in scripts without spaces. The place of each removed run in the original text is kept with the result.

Units are the sentences of each line unless told otherwise, because a repeated passage often begins or ends inside a line. A unit reaches
to the start of the next one; a text is the concatenation of its units, and the kept text that of the units that stay.

Defined results: null and empty texts, and texts of white space alone, have no unit and stay as they are; blank lines belong to the unit
before them; rows that share an id are ranked by the hash of their texts, and exact repeats of a row are one document whose result
each of them gets; of equal units in one document the first stays; a very long text is cut whole, in one task; an empty table gives an
empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, stored, table
from tidemark.llm.spans import joined_spans, keyed, spans_text

RUN_CHARS = 150
#: What ends a unit, with the white space after it.
ENDS = {
    "line": re.compile(r"\n[\x20\x09-\x0D]*"),
    "sentence": re.compile(r"[.!?][\x20\x09-\x0D]+|[。！？][\x20\x09-\x0D]*|\n[\x20\x09-\x0D]*"),
    "paragraph": re.compile(r"\n[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*"),
}
UNITS = "key_id long, key_text long, place int, start long, stop long, chars long, digest binary"
CUT = T.StructType(
    [
        T.StructField("kept", T.StringType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "stop", "n_units")]))),
    ]
)


def cut_units(text: str, unit: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, stop, normalised bytes) of each unit that isn't blank; offsets count code points."""
    start = 0
    for stop in [*[m.end() for m in ENDS[unit].finditer(text)], len(text)]:
        words = text[start:stop].lower().encode().split()  # bytes split at ASCII white space alone
        if words:
            yield start, stop, b" ".join(words)
        start = stop


def unit_table(docs: DataFrame, text: str, keys: tuple[str, str], unit: str) -> DataFrame:
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, texts = (c.to_pylist() for c in batch.columns)
            rows = []
            for i, t, x in zip(ids, ties, texts, strict=True):
                for place, (start, stop, normal) in enumerate(cut_units(x, unit)):
                    rows.append((i, t, place, start, stop, len(normal.decode()), hashlib.md5(normal, usedforsecurity=False).digest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], [c.split()[0] for c in UNITS.split(", ")])

    return docs.where(F.col(text).isNotNull()).select(*keys, text).mapInArrow(units, UNITS)


def long_runs(repeats: list, run_chars: int) -> list[tuple[int, int, int]]:
    """(start, stop, number of units) of the runs to remove, from the repeats in the order of their places."""
    runs: list[list[int]] = []  # start, stop, units, characters, place of the last
    for r in repeats:
        if runs and runs[-1][4] + 1 == r["place"]:
            last = runs[-1]
            last[1:] = r["stop"], last[2] + 1, last[3] + r["chars"], r["place"]
        else:
            runs.append([r["start"], r["stop"], 1, r["chars"], r["place"]])
    return [(a, b, n) for a, b, n, chars, _ in runs if chars >= run_chars]


def dedup_units(docs: DataFrame, unit: str = "sentence", run_chars: int = RUN_CHARS, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the kept text and the removed runs (array of start, stop, n_units, offsets in the original text; null for
    none), and the names of those two new columns. ``run_chars`` 0 removes every repeat."""

    @F.pandas_udf(CUT)
    def cut(texts: pd.Series, repeats: pd.Series) -> pd.DataFrame:
        kept, runs = [], []
        for x, mine in zip(texts, repeats, strict=True):
            gone = [] if x is None else long_runs(mine, run_chars)
            edges = [0, *[p for a, b, _ in gone for p in (a, b)], None]
            kept.append("".join([x[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if gone else x)
            runs.append([{"start": a, "stop": b, "n_units": n} for a, b, n in gone])
        return pd.DataFrame({"kept": kept, "runs": runs})

    columns = docs.columns
    docs, a, b = keyed(docs, doc_id, text)
    units = stored(unit_table(docs, text, (a, b), unit), "units")
    rank = F.struct("key_id", "key_text", "place")
    # a stored side lets adaptive execution split digests that very many units share
    firsts = stored(units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    later = units.join(firsts, "digest").where(rank != F.col("first"))
    out, repeats = joined_spans(docs, (a, b), later, ("place", "start", "stop", "chars"))
    made = free_name(out, "cut")
    # a text without a repeat never leaves the JVM
    out = out.withColumn(made, cut(F.when(F.col(repeats).isNotNull(), F.col(text)), repeats))
    kept, removed = free_name(docs, "kept_text"), free_name(docs, "removed_runs")
    taken = F.col(f"{made}.runs")
    out = out.select(*columns, F.coalesce(F.col(f"{made}.kept"), F.col(text)).alias(kept), F.when(F.size(taken) > 0, taken).alias(removed))
    return out, kept, removed


def op9_line_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, kept, removed = dedup_units(docs)
    total = lambda f: F.coalesce(F.aggregate(removed, F.lit(0).cast("long"), f), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        total(lambda s, x: s + x["n_units"]).alias("n_removed"),
        total(lambda s, x: s + x["stop"] - x["start"]).alias("removed_chars"),
        F.coalesce(spans_text(F.col(removed)), F.lit("")).alias("removed_spans"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''),
        '[^\n]*?(?:[.!?][\x20\x09-\x0D]+|[。！？][\x20\x09-\x0D]*|\n[\x20\x09-\x0D]*|\z)') AS us FROM documents),
u AS (SELECT doc_id, unnest(us) AS raw, generate_subscripts(us, 1) AS i FROM d),
n AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) - length(raw) AS start,
        trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM u WHERE raw <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place,
        row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) > 1 AS later FROM n WHERE norm <> ''),
g AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM p WHERE later),
r AS (SELECT doc_id, min(start)::bigint AS a, max(start + length(raw))::bigint AS b, count(*) AS k FROM g
      GROUP BY doc_id, island HAVING sum(length(norm)) >= 150),
t AS (SELECT doc_id, sum(k) AS k, sum(b - a) AS chars, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM r GROUP BY doc_id),
s AS (SELECT n.doc_id, string_agg(raw, '' ORDER BY i) AS kept FROM n LEFT JOIN r ON n.doc_id = r.doc_id AND start >= a AND start < b
      WHERE a IS NULL GROUP BY n.doc_id)
SELECT doc_id, coalesce(k, 0)::bigint AS n_removed, coalesce(chars, 0)::bigint AS removed_chars, coalesce(spans, '') AS removed_spans,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)
"""
