"""Keys for documents and removal of spans from their texts, for the operators that cut repeated passages out.

A document is known by its id and a hash of its text. Rows that agree in both are one document with the same result for
each row; rows that share only the id are ranked by the hash. A null id ranks before all others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name

NULL_ID = -(1 << 63)


def keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` with two key columns, and their names."""
    a = free_name(docs, "key_id")
    b = free_name(docs, "key_text")
    keys = {a: F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), b: F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    return docs.withColumns(keys), a, b


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "stop", "line", "n_lines")])


def runs_of(spans: list) -> list[dict[str, int]]:
    """The maximal runs of lines that ``spans``, which may overlap, cover."""
    runs: list[dict[str, int]] = []
    for s in sorted(spans, key=lambda s: s["line"]):
        if runs and s["line"] <= runs[-1]["line"] + runs[-1]["n_lines"]:
            last = runs[-1]
            last["stop"] = max(last["stop"], s["stop"])
            last["n_lines"] = max(last["n_lines"], s["line"] + s["n_lines"] - last["line"])
        else:
            runs.append({c: int(s[c]) for c in RUN.names})
    return runs


@F.pandas_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("runs", T.ArrayType(RUN))]))
def without_lines(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Each text without the lines in ``spans``, and the runs that went; None where there was no text."""
    kept, removed = [], []
    for text, mine in zip(texts, spans, strict=True):
        runs = [] if text is None else runs_of(list(mine))
        if runs:
            lines = text.split("\n")
            edges = [0, *[k for r in runs for k in (r["line"], r["line"] + r["n_lines"])], len(lines)]
            text = "\n".join([x for a, b in zip(edges[::2], edges[1::2], strict=True) for x in lines[a:b]])
        kept.append(text)
        removed.append(runs)
    return pd.DataFrame({"kept": kept, "runs": removed})


def joined_spans(docs: DataFrame, key: tuple[str, str], spans: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, str]:
    """``docs`` (with its key columns, which go) with a sorted array of its ``spans``, null for none, and the name of that column.
    ``spans`` has ``key_id, key_text`` and ``fields``; documents that occur as several equal rows list a span once."""
    name = free_name(docs, "found_spans")
    a, b = free_name(docs, "spans_id"), free_name(docs, "spans_tie")
    listed = F.array_sort(F.collect_set(F.struct(*fields))).alias(name)
    found = spans.groupBy("key_id", "key_text").agg(listed).withColumnsRenamed({"key_id": a, "key_text": b})
    same = (F.col(key[0]) == F.col(a)) & (F.col(key[1]) == F.col(b))
    return docs.join(found, same, "left").drop(*key, a, b), name


def cut_lines(docs: DataFrame, key: tuple[str, str], later: DataFrame, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` (with its key columns, which go) with the removed runs of lines and the kept text, and the names of the two new columns.
    ``later`` has a row per span to remove: ``key_id, key_text, start, stop, line, n_lines``; spans may overlap."""
    columns = [c for c in docs.columns if c not in key]
    out, spans = joined_spans(docs, key, later, ("start", "stop", "line", "n_lines"))
    made, kept, removed = free_name(out, "cut"), free_name(out, "kept_text"), free_name(out, "removed_runs")
    # a text that loses nothing never leaves the JVM
    out = out.withColumn(made, without_lines(F.when(F.col(spans).isNotNull(), F.col(text)), spans))
    runs = F.col(f"{made}.runs")
    out = out.select(*columns, F.when(F.size(runs) > 0, runs).alias(removed), F.coalesce(F.col(f"{made}.kept"), F.col(text)).alias(kept))
    return out, kept, removed


def spans_text(spans: Column) -> Column:
    """An array of (start, stop) as ``start:stop,start:stop``."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
