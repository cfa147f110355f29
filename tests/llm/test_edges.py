"""Every operator on one table with nulls, empty and very long texts, repeated rows and columns with the names that operators use inside."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_copies import slow_fingerprint

from tidemark.llm import host_quality, id_files, language_id, line_chunks, line_hash, near_copies, packing, reply_trees, simhash_vp, suffix_dedup, tokens
from tidemark.llm.common import shared_path

NAMES = ("key_id", "key_text", "digest", "node", "draw", "shard", "words", "found_spans", "kept_text", "whole", "m", "host", "failed", "first", "leaf", "fp", "raw", "entries", "bucket", "kept_id", "tree", "bad_host")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    pool = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8)))) for _ in range(5000)]
    prose = lambda n: "".join(" ".join(rng.choice(pool, 11)) + rng.choice([". ", ".\n"]) for _ in range(n // 11))
    long = prose(250_000)
    return [(1, prose(60)), (2, long), (2, long), (3, "head. " + long), (4, None), (5, ""), (6, " \n "), (None, prose(40)), (None, prose(40)), (None, None)]


@pytest.fixture
def table(docs, rows):
    return docs(rows).withColumns({n: F.lit(f"my {n}") for n in NAMES})


def counted(values):
    return sorted(values, key=str)


def test_quality(table, rows):
    got = host_quality.quality_verdicts(table).collect()
    assert counted((r["doc_id"], r["n_words"]) for r in got) == counted((i, len((t or "").split())) for i, t in rows)
    kept = host_quality.keep_good(table)
    assert kept.columns == table.columns
    assert counted(r["doc_id"] for r in kept.collect()) == counted(i for i, t in rows if t and len(t.split()) >= 10)


def test_id_files(spark, table, rows):
    path = shared_path(spark, "edges")
    id_files.write_id_files(table, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = id_files.read_id_files(spark, path).collect()
    ids = [np.append(np.frombuffer(x, "<u4"), 2).astype("<u4") for x in tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), False).direct([t or "" for _, t in rows])]
    assert counted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == counted((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_packing(table, rows):
    got = packing.packed_documents(table)
    assert got.columns == [*[c.split()[0] for c in packing.PIECES.split(", ")], "sequence_id", "offset"]
    assert got.where("piece = 0").count() == len(rows) and got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_substrings(table, rows):
    got = counted((r["doc_id"], r["n_bytes"] - r["n_removed"]) for r in suffix_dedup.dedup_substrings(table).collect())
    size = lambda t: len((t or "").encode())
    # the later document of the two long ones keeps what no earlier text of a hundred bytes covers
    assert got == counted((i, 6 if i == 3 else size(t)) for i, t in rows)


def test_fingerprints(table, rows):
    got = counted((r["key_id"], r["fp"] % 2**64) for r in simhash_vp.near_duplicates(table).collect())
    assert got == counted((simhash_vp.NULL_ID if i is None else i, slow_fingerprint(t)) for i, t in rows)
    kept = simhash_vp.first_of_each_group(table)
    assert kept.columns == table.columns and counted(r["doc_id"] for r in kept.collect()) == counted([1, 2, None, None, None])


def test_near_copies(table):
    kept = near_copies.first_of_each_group(table)
    assert kept.columns == table.columns and counted(r["doc_id"] for r in kept.collect()) == counted([1, 2, None, None, None])


def test_languages(table, rows):
    model = language_id.train(["the and of", "der und die"], ["en", "de"], [False, False])
    got = language_id.predict(table.drop("lang"), model, carried=("doc_id", *NAMES)).collect()
    assert counted((r["doc_id"], r["lang_pred"] == "und") for r in got) == counted((i, not (t or "").strip()) for i, t in rows)
    assert all(r["key_id"] == "my key_id" for r in got)


def test_lines(table, rows):
    out, kept, removed = line_hash.dedup_units(table)
    assert out.columns == [*table.columns, kept, removed]
    assert counted((r["doc_id"], r[kept]) for r in out.collect()) == counted((i, "head. " if i == 3 else t) for i, t in rows)
    out = line_chunks.without_repeated_chunks(table)
    assert out.columns == table.columns
    got = counted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] != 3)
    assert got == counted((i, t) for i, t in rows if i != 3)
    (rest,) = [r["text"] for r in out.where("doc_id = 3").collect()]
    assert rest.startswith("head. ") and len(rest) < 2000  # the chunk that begins differently stays


def test_conversations(spark, rows):
    turns = [(None if i is None else i % 3, k % 4, "assistant" if k % 2 else None, t) for k, (i, t) in enumerate(rows)] + [(9, None, "user", "no turn"), (9, None, "user", "no turn"), (9, 0, "assistant", None)]
    made = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(f"my {n}") for n in NAMES})
    messages = reply_trees.flat_messages(made)
    got = reply_trees.read_back(reply_trees.format_paths(messages, reply_trees.ranked_paths(messages))).collect()
    told = {r["tree"]: [(t["role"], t["text"]) for t in r["turns"]] for r in got}
    want = {}
    for c, n, role, text in sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert told == want and len(got) == len(want)
