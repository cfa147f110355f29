"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and packing, one after the other.

Each stage is a function of (spark, docs, sf_dir). ``docs`` is what the stage before kept, as written to Parquet and read again.
All stages but the last return the columns of ``documents``; the last returns the packed pieces.

Defined results, for all stages: an empty table gives an empty result; a null id is kept as it is and ranks before all others; further
columns of ``documents``, whatever their names, go along until the last stage; a very long text is handled whole, by one task at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.contamination import without_items
from tidemark.llm.host_quality import keep_good
from tidemark.llm.line_chunks import without_repeated_chunks
from tidemark.llm.near_copies import first_of_each_group
from tidemark.llm.packing import packed_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or whose host is rejected go: a null or empty text fails, a null host is never rejected. Repeated rows
    each stay or go alike, and each count for their host."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; ``n_chars`` follows the new text. A document of nothing else stays, with an empty text. Null and empty
    texts stay; repeated rows are one document, whose result each of them gets; of equal chunks the one of the least (id, place) stays."""
    return without_repeated_chunks(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more, over any number of steps) the document with the least id
    stays, rows of one id ranked by the hash of their texts. Null and empty texts are copies of each other, and so are repeated rows."""
    return first_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (0.8 or more of its five-word shingles) go, one item being enough. Null and empty texts contain
    none and stay; items without a word are in none; an item without an id counts like any other; repeated rows go or stay alike."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset. A null text is empty and has the end id only; repeated rows are packed each;
    pieces of equal length are taken by id, piece and checksum."""
    return packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the fingerprints, chunks and tokens; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
