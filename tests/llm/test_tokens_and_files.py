"""Encoding, Simple-8b files and packing: equality with the library, exact round trips, bounds."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import id_files, packing, tokens
from tidemark.llm.common import shared_path

FILES = {False: "byte_bpe_50k.json", True: "word_bpe_49k.json"}
TEXT = st.text(st.one_of(st.sampled_from("aAbé ñ \n\t.,'0Σςİ\x1c\x85 \r\0-中"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def encoders():
    return {d: tokens.Encoder(public_tokenizers.path(f), d) for d, f in FILES.items()}


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_cached_ids_are_the_library_s(encoders, texts):
    for e in encoders.values():
        assert e.ids(texts) == e.direct(texts)


MARKS = ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<")


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.lists(st.one_of(st.sampled_from(MARKS), TEXT), max_size=5).map("".join), max_size=4))
def test_marks_in_texts_are_the_plain_library_s(encoders, texts):
    for drops_space, e in encoders.items():
        library = Tokenizer.from_file(public_tokenizers.path(FILES[drops_space]))
        plain = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert e.ids(texts) == plain


def test_marks_have_ids_of_their_own(encoders):
    text = "say <|endoftext|> now\n<|endoftext|>a<|endoftext|>\n<|startoftext|>."
    for drops_space, e in encoders.items():
        library = Tokenizer.from_file(public_tokenizers.path(FILES[drops_space]))
        got = np.frombuffer(e.ids([text])[0], "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids and got.count(library.token_to_id("<|endoftext|>")) == 3


def test_cache_limits_do_not_matter(encoders, monkeypatch, words):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 20)
    texts = [" ".join(words(50)) + ".\n" + "x" * 90 + ", end" for _ in range(5)] + ["", None, "<|endoftext|> a", "don't 1 2"]
    for e in encoders.values():
        for _ in range(2):
            assert e.ids(texts) == e.direct([t or "" for t in texts])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    assert (id_files.unpack(id_files.pack(v), len(v)) == v).all()


def test_narrow_values_share_words():
    assert len(id_files.pack(np.ones(600, np.uint64))) == 10
    assert len(id_files.pack(np.full(300, 50_000, np.uint64))) == 100


def test_id_files(spark, docs, encoders, monkeypatch, words):
    monkeypatch.setattr(id_files, "SEGMENT", 500)
    rows = [(i, " ".join(words(i * 3 % 140))) for i in range(150, 0, -1)] + [(200, None), (-5, ""), (201, "y " * 30000), (None, "null id")]
    path = shared_path(spark, "test-ids")
    id_files.write_id_files(docs(rows), path, public_tokenizers.path(FILES[False]))
    got = sorted(map(tuple, id_files.read_id_files(spark, path).collect()), key=lambda r: r[1])
    start, want = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = encoders[False].direct([text or ""])[0] + np.array([2], "<u4").tobytes()
        want.append((key, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert got == want
    assert spark.read.parquet(path).count() > 5


def test_no_documents(spark, docs):
    path = shared_path(spark, "test-ids")
    id_files.write_id_files(docs([]), path, public_tokenizers.path(FILES[False]))
    assert id_files.read_id_files(spark, path).count() == 0
    assert packing.packed_documents(docs([])).count() == 0


def test_bounds_never_exceed_a_packing():
    rng = np.random.default_rng(3)
    for _ in range(200):
        capacity = int(rng.integers(8, 200))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 80)))
        bins, offsets = packing.best_fit_decreasing(lengths, capacity)
        sizes, counts = np.unique(lengths, return_counts=True)
        n = int(bins.max()) + 1
        assert packing.lower_bound(sizes, counts, capacity) <= n
        for b in range(n):
            mine = np.argsort(offsets[bins == b])
            assert (np.cumsum(lengths[bins == b][mine]) - lengths[bins == b][mine] == offsets[bins == b][mine]).all()
            assert lengths[bins == b].sum() <= capacity


def test_bound_sees_items_that_do_not_pair():
    assert packing.lower_bound(np.array([60]), np.array([7]), 100) == 7
    assert packing.lower_bound(np.array([34]), np.array([7]), 100) == 4


def test_groups_exchange(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(x), i) for i, x in enumerate(rng.integers(1, 2049, 3000))]
    df = spark.createDataFrame(rows, packing.PIECES)
    out = packing.pack_pieces(df, group=100).toPandas()
    assert len(out) == 3000
    fill = out.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 2048
    one = packing.best_fit_decreasing(np.array([r[3] for r in rows]), 2048)[0].max() + 1
    assert len(fill) <= 1.01 * one  # groups of a hundred alone need four percent more
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g["length"].cumsum() - g["length"]).tolist() == g["offset"].tolist()


def test_pieces(spark, docs, encoders):
    long = "word " * 5000
    out = packing.packed_documents(docs([(1, long), (2, None), (2, None)])).toPandas()
    ids = np.frombuffer(encoders[True].direct([long])[0], "<u4")
    mine = out[out.doc_id == 1].sort_values("piece")
    assert mine["length"].tolist() == [2048, 2048, 905] and mine["start"].tolist() == [0, 2048, 4096]
    whole = np.append(ids, 0).astype("<u4")
    assert mine["ids_crc32"].tolist() == [zlib.crc32(whole[a : a + 2048].tobytes()) for a in (0, 2048, 4096)]
    assert out[out.doc_id == 2]["length"].tolist() == [1, 1]
