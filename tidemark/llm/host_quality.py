"""Quality rules with host-level verdicts.

Each document is measured on its whole text and judged by two base rules (too few words, too many words in
repeated five-word windows). Failures are summed by host, each host's failure rate is shrunk toward the corpus
with a beta prior fitted to all hosts by moments, and a host whose shrunk rate passes ``max_host_rate`` takes its
documents with it.

Defined results: a null or empty text has no words and fails; a null host gets no host verdict; repeated rows each
count and each get a row; a very long text is measured whole, in one task; hosts of equal rates get equal verdicts; an empty table gives
an empty result; further columns of the input, whatever their names, are left alone.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, stored, table

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT, MAX_HOST_RATE = 10, 5, 20, 0.5
#: Prior strengths (in documents) that the moment fit may take; one that all hosts agree on has no finite fit.
PRIOR_STRENGTH = (1.0, 1000.0)

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
METRICS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes: defaultdict = defaultdict(count().__next__)
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    key, kinds, distinct = ids[:n].copy(), len(codes), len(codes)
    for k in range(1, size):
        if kinds * distinct >= 2**62:  # number the prefixes anew, so that keys stay exact
            _, key = np.unique(key, return_inverse=True)
            kinds = int(key.max()) + 1
        key = key * distinct + ids[k : k + n]
        kinds *= distinct
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    ends = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(key, twice))
    np.add.at(ends, at, 1)
    np.add.at(ends, at + size, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    seen: set[bytes] = set()
    lines = 0
    for line in raw.split(b"\n"):
        if line.strip(SPACE):
            lines += line in seen
            seen.add(line)
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, lines, repeated_words(words)


@F.pandas_udf(METRICS)
def _metrics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in texts], columns=METRICS.names, dtype="int64")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def host_verdicts(judged: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``judged`` has ``host`` and ``failed``; returns ``host, n_docs, n_failed, host_rate, host_rejected``.

    The prior comes from the table of hosts: with N documents on H hosts and a pooled rate m, the spread of the
    hosts' rates has the expectation m(1-m)(r + (1-r)H/N); r is solved for and the prior's strength is 1/r - 1.
    """
    hosts = stored(
        judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts"
    )
    row = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.count("*"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs"))).first()
    docs, failed, n, squares = (float(x or 0) for x in row)
    low, high = PRIOR_STRENGTH
    rate, strength = (failed / docs if docs else 0.0), high
    if 0 < rate < 1 and n < docs:
        spread = (squares / docs - rate * rate) / (rate * (1 - rate))
        share = (spread - n / docs) / (1 - n / docs)
        strength = min(high, max(low, 1 / share - 1)) if share > 0 else high
    shrunk = (F.col("n_failed") + F.lit(rate * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > max_host_rate)


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document with its measures, ``base_failed``, its host's shrunk rate and ``kept``.

    The texts are read once; what is stored for the host pass is a few numbers a document. The join with the hosts'
    verdicts is left to the optimizer: broadcast where their measured size allows, else a sort-merge join whose hot
    hosts adaptive execution splits."""
    m = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), _metrics(F.col(text)).alias("m")), "measures")
    judged = m.select("doc_id", "host", "m.*", base_failed(F.col("m")).alias("base_failed"))
    hosts = host_verdicts(judged.select("host", F.col("base_failed").alias("failed"))).select("host", "host_rate", "host_rejected")
    return judged.join(hosts, "host", "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. Every text is measured once: rows that pass the base rules are stored
    with their host, of the others the host alone, and the hosts' verdicts come from that table."""
    failed = base_failed(_metrics(F.col(text)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = stored(docs.select(F.col(host).alias("host"), failed.alias("failed"), F.when(~failed, whole).alias("whole")), "judged")
    bad = host_verdicts(judged.select("host", "failed")).where("host_rejected").select(F.col("host").alias("bad_host"))
    return judged.where("not failed").join(bad, F.col("host") == F.col("bad_host"), "left_anti").select("whole.*")


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_verdicts(table(spark, sf_dir, "documents")).select(*columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT rid, i, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o || chr(10) ||
          lead(word, 3) OVER o || chr(10) || lead(word, 4) OVER o AS g FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid),
ln AS (SELECT rid, sum(n - 1) AS n FROM (SELECT rid, line, count(*) AS n FROM
         (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid),
m AS (SELECT d.rid, doc_id, source, len(ws) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(ln.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
j AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::int) AS f FROM j WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT sum(n)::double AS docs, count(*)::double AS hosts, sum(f)::double / sum(n) AS rate, sum(f::double * f / n) AS sq FROM h),
s AS (SELECT rate, CASE WHEN rate > 0 AND rate < 1 AND hosts < docs
        THEN ((sq / docs - rate * rate) / (rate * (1 - rate)) - hosts / docs) / (1 - hosts / docs) END AS share FROM t),
p AS (SELECT rate, CASE WHEN share > 0 THEN least(1000.0, greatest(1.0, 1 / share - 1)) ELSE 1000.0 END AS strength FROM s),
v AS (SELECT source, (f + rate * strength) / (n + strength) > 0.5 AS bad FROM h, p)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols,
  n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words, base_failed,
  (NOT base_failed AND NOT coalesce(bad, false)) AS kept
FROM j LEFT JOIN v USING (source)
"""
