"""The registered queries without SQL, on the whole documents table, against plain Python."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import DATA
from test_copies import brute_groups, brute_substrings, slow_fingerprint
from test_text_filters import brute_chunks
from tokenizers import Tokenizer

from tidemark.llm import packing, registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


def library_ids(name, texts, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def test_op3(spark, documents):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op3_simple8b_files"](spark, DATA).collect()}
    start = 0
    for (i, _), ids in zip(documents, library_ids("byte_bpe_50k.json", [t for _, t in documents], 2), strict=True):
        assert got.pop(i) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_op4(spark, documents):
    want = brute_substrings(documents)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_suffix_dedup"](spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == want and sum(r[1] > 0 for r in got.values()) > 10


def test_op5(spark, documents):
    rows = QUERIES["op5_best_fit_packing"](spark, DATA).toPandas()
    want = set()
    for (i, _), ids in zip(documents, library_ids("word_bpe_49k.json", [t for _, t in documents], 0), strict=True):
        want |= {(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))}
    assert len(rows) == len(want) and set(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g["length"].cumsum() - g["length"]).tolist() == g["offset"].tolist() and g["length"].sum() <= 2048
    sizes, counts = np.unique(rows["length"], return_counts=True)
    assert rows["sequence_id"].nunique() <= packing.lower_bound(sizes, counts, 2048) + 1


def test_op7(spark, documents):
    prints = [slow_fingerprint(t) for _, t in documents]
    roots = brute_groups(prints)
    want = {i: (f"{p:016x}", documents[r][0]) for (i, _), p, r in zip(documents, prints, roots, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op7_simhash_vp"](spark, DATA).collect()} == want


def test_op10(spark, documents):
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in brute_chunks(documents).items()}
    assert {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op10_line_chunks"](spark, DATA).collect()} == want


def fewest(lengths, capacity):
    """The least number of bins, by trying all placements."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[k]}.values():
            place(k + 1, [*rooms[:j], rooms[j] - lengths[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_bounds_and_packing_against_the_optimum():
    rng = np.random.default_rng(9)
    for capacity, n in itertools.product((20, 101), (1, 5, 8)):
        for _ in range(25):
            lengths = np.sort(rng.integers(1, capacity + 1, n))[::-1]
            least = fewest(lengths.tolist(), capacity)
            sizes, counts = np.unique(lengths, return_counts=True)
            made = int(packing.best_fit_decreasing(lengths, capacity)[0].max()) + 1
            assert packing.lower_bound(sizes, counts, capacity) <= least <= made <= -(-11 * least // 9) + 1


def test_equal_pieces_spread_over_groups(spark):
    rows = spark.createDataFrame([(None, 0, 0, 1, 5)] * 3000, packing.PIECES)
    out = packing.pack_pieces(rows, group=100)
    assert out.columns == [c.split()[0] for c in packing.PIECES.split(", ")] + ["sequence_id", "offset"]
    fill = out.groupBy("sequence_id").count().toPandas()["count"]
    assert fill.sum() == 3000 and len(fill) == 2
