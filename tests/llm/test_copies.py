"""SimHash groups and exact substrings against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash_vp, suffix_dedup
from tidemark.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def test_fingerprint(words):
    for n in (0, 1, 2, 3, 4, 50):
        text = " \t".join(words(n)).title()
        assert simhash_vp.fingerprint(text.encode()) == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    x = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"]
    assert x % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def brute_groups(values):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(int(values[i]) ^ int(values[j])).count("1") <= 2:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def near(rng, n, clusters):
    base = [rng.getrandbits(64) for _ in range(clusters)]
    out = {0, 1, 3, 7, 15}
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def test_leaf_links(monkeypatch):
    monkeypatch.setattr(simhash_vp, "BLOCK", 8)
    rng = random.Random(1)
    for n, clusters in ((40, 3), (200, 60), (150, 1)):
        v = near(rng, n, clusters)
        assert simhash_vp.link(v).tolist() == brute_groups(v)


def test_tree_keeps_close_pairs_together():
    v = near(random.Random(2), 600, 150)
    nodes = simhash_vp.build(v[::3], 16)
    leaves = [set() for _ in v]
    for leaf, mine in simhash_vp.route(nodes, v):
        for i in mine:
            leaves[i].add(leaf)
    assert len(set().union(*leaves)) > 4
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 2):
            assert leaves[i] & leaves[j]


def test_links_over_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash_vp, "LEAF", 32)
    v = near(random.Random(3), 500, 90)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash_vp.near_links(df)).collect()}
    got = [roots.get(int(x), int(x)) for x in v.view(np.int64)]
    want = brute_groups(v)
    assert len(set(got)) == len(set(want))
    assert len(set(zip(got, want, strict=True))) == len(set(want))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, docs, words):
    text = " ".join(words(300))
    other = " ".join(words(300))
    rows = [(9, text), (4, text.upper()), (7, text.replace("a", "a", 1)), (3, other), (8, None), (6, ""), (None, " \n"), (4, text.upper())]
    found = simhash_vp.near_duplicates(docs(rows)).collect()
    groups = {(r["key_id"], r["fp"]): r["first"]["key_id"] for r in found}
    ids = {k[0]: v for k, v in groups.items()}
    assert len(found) == 8 and ids[9] == ids[4] == ids[7] == 4 and ids[3] == 3
    assert ids[8] == ids[6] == simhash_vp.NULL_ID
    kept = simhash_vp.first_of_each_group(docs(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "None"]
    assert simhash_vp.near_duplicates(docs([])).count() == 0


def brute_substrings(rows, n=100):
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - n + 1):
            s = raw[p : p + n]
            if s in seen:
                gone[p : p + n] = True
            seen.add(s)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[key] = (len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_substrings_against_brute_force(docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9)))
    pool = [" ".join(word() for _ in range(60)) for _ in range(8)]
    rows = []
    for i in range(70):
        text = ""
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(pool)
            a = rng.randint(0, len(x))
            text += x[a : rng.randint(a, len(x))] + (" ".join(word() for _ in range(rng.randint(1, 40))) if rng.random() < 0.5 else "")
        rows.append((i, text))
    rows += [(200, "a" * 500), (201, "a" * 99), (202, "a" * 100), (203, ""), (204, None), (205, rows[5][1]), (206, "ab" * 400)]
    want = brute_substrings(rows)
    # groups of two: every repeated anchor is dealt to several buckets
    same = lambda windows: (np.zeros(len(windows), np.int64), windows[:, 0].astype(np.int64) % 2)  # noqa: E731  nearly all windows collide
    clash = docs(rows).withColumns({"key_id": F.lit("x"), "entries": F.lit(1), "raw": F.lit(2)})
    for group_max, hashes in ((suffix_dedup.GROUP_MAX, suffix_dedup.window_hashes), (2, suffix_dedup.window_hashes), (2, same)):
        got = {r[0]: tuple(r[1:]) for r in suffix_dedup.dedup_substrings(clash, group_max=group_max, hashes=hashes).collect()}
        assert got == want


def test_entries_in_slices(monkeypatch):
    keys = np.repeat(np.arange(40).reshape(-1, 1), [k % 5 + 1 for k in range(40)], axis=0).repeat(2, axis=1)
    spans = np.arange(2 * len(keys)).astype("<u4").view(suffix_dedup.SPAN)
    whole = suffix_dedup.by_document(keys, spans)
    monkeypatch.setattr(suffix_dedup, "SLICE", 64)
    assert suffix_dedup.by_document(keys, spans).combine_chunks().equals(whole.combine_chunks()) and whole.num_rows == 40
    assert suffix_dedup.by_document(keys[:0], spans[:0]).num_rows == 0


def test_stretches_keep_every_window_s_anchor(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)).encode() for n in (3000, 0, 99, 100, 650, 4000)]

    def windows():
        made, owners = suffix_dedup.text_anchors(texts)
        return {(t, int(a["pos"]) - o): (int(a["id"]), int(a["pos"])) for a, t in zip(made, owners.tolist(), strict=True) for o in range(a["lo"], a["hi"] + 1)}

    whole = windows()
    assert len(whole) == sum(max(0, len(t) - 99) for t in texts)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    assert windows() == whole


def test_equal_rows_and_empty_table(docs, words):
    text = " ".join(words(60))
    got = sorted(map(tuple, suffix_dedup.dedup_substrings(docs([(1, text), (1, text), (None, text), (2, text + " tail")])).collect()), key=repr)
    assert [r[2] for r in got if r[0] is None] == [0]
    assert [r[2] for r in got if r[0] == 1] == [len(text)] * 2
    assert suffix_dedup.dedup_substrings(docs([])).count() == 0


def test_the_earliest_document_as_equal_rows(docs, words):
    first, other = " ".join(words(60)), " ".join(words(60))
    rows = [(1, first), (1, first), (1, first), (2, "head " + first[:150] + " tail"), (3, other), (3, other), (4, other), (None, other[:120]), (None, other[:120])]
    want = brute_substrings({(-1 if i is None else i, t) for i, t in rows})
    for group_max in (suffix_dedup.GROUP_MAX, 2):
        got = suffix_dedup.dedup_substrings(docs(rows), group_max=group_max).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r[1:]) == want[-1 if r[0] is None else r[0]]
    assert want[1][1] == 0 and want[2][1] > 0


def test_blind_trie_sorts():
    rng = random.Random(5)
    texts = list({bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)})
    trie = suffix_dedup.BlindTrie(texts[0])
    for t in texts:
        trie.add(t)
    assert trie.ordered() == sorted(texts)


def test_deep_shallow_sorts_groups():
    rng = np.random.default_rng(4)
    rows = np.repeat(rng.integers(97, 99, (60, 100)).astype(np.uint8), 4, axis=0)
    rows[::3, 90:] = 100
    group = rng.integers(0, 3, len(rows))
    order, common = suffix_dedup.deep_shallow(rows, group)
    keys = [(group[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for (g, a), (h, b), c in zip(keys, keys[1:], common[1:], strict=False):
        assert c == (-1 if g != h else next((k for k in range(100) if a[k] != b[k]), 100))
