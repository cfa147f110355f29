"""The near-copy stage against exact similarity, with planted near copies."""

import os
import random

import corpus_pipeline

from tidemark.llm import common, near_copies


def similarity(x, y):
    x, y = (near_copies.own_shingles(t.lower().encode().split(), 5) for t in (x, y))
    return len(x & y) / len(x | y)


def brute_firsts(rows):
    group = dict.fromkeys(sorted(i for i, _ in rows))
    own = {i: near_copies.own_shingles((t or "").lower().encode().split(), 5) for i, t in rows}
    near = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    for i in group:
        stack = [i] if group[i] is None else []
        while stack:
            x = stack.pop()
            group[x] = i
            stack += [j for j in group if group[j] is None and near(own[x], own[j])]
    return {i for i, g in group.items() if i == g}


def test_planted_near_copies(spark, docs, words):
    rng, rows, planted = random.Random(4), [], []
    for n, changed in ((100, 1), (100, 2), (300, 1), (300, 5), (300, 6), (1000, 5), (1000, 20), (60, 3), (200, 12)):
        base = words(n)
        rows.append((len(rows), " ".join(base)))
        for _ in range(4):
            copy = list(base)
            for k in rng.sample(range(5, n - 5), changed):
                copy[k] = "changed" + str(rng.random())
            planted.append(similarity(" ".join(copy), " ".join(base)))
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, rows[3][1].upper()), (901, "a b c"), (902, "a  b C"), (903, "a b d")]
    assert min(planted) < 0.8 and sum(0.8 <= p <= 0.99 for p in planted) > 20
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()]
    assert sorted(got) == sorted(brute_firsts(rows))


def test_chains_and_empty_texts(docs, words):
    base, rows = words(80), []
    for i in range(6):  # each is near the one before, not the first
        rows.append((10 - i, " ".join(base)))
        base = [*base[:10 + 10 * i], "new" + str(i), *base[11 + 10 * i:]]
    rows += [(50, None), (51, ""), (None, " \n")]
    got = [r["doc_id"] for r in near_copies.first_of_each_group(docs(rows)).collect()]
    assert sorted(map(str, got)) == ["5", "None"]
    assert near_copies.first_of_each_group(docs([])).count() == 0


def test_large_groups_in_blocks(docs, words, monkeypatch):
    """Copies of one text with few to very many changes, so that many pairs of a bucket are near the threshold."""
    rng, base = random.Random(5), words(140)
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        copy = list(base)
        for k in rng.sample(range(140), rng.randint(1, 14)):
            copy[k] = f"new{i}x{k}"
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(words(30) + base[:100])) for i in range(20)]
    want = brute_firsts(rows)
    assert 20 < len(want) < 120
    for block in (4096, 16, 50):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        assert {r["doc_id"] for r in near_copies.first_of_each_group(docs(rows)).collect()} == want


def test_large_buckets_are_dealt_once(spark, monkeypatch):
    """A bucket of 50,000 members, all but 20 of them in one component, makes about a row for each."""
    node = near_copies.F.col("id")
    members = spark.range(50_000).select(near_copies.F.lit(1).alias("band"), node.alias("node"), near_copies.F.when(node % 2500 == 7, node).otherwise(0).alias("root"))
    dealt = near_copies.in_blocks(members)
    assert 50_000 <= dealt.count() < 51_000
    # whatever the blocks, each pair with a member outside meets once
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    few = spark.createDataFrame([(1, i, i if i % 3 else 0) for i in range(24)] + [(2, i, 5 * (i % 2)) for i in range(7)] + [(3, 1, 1), (3, 2, 2)], "band int, node long, root long")
    met = {}
    for _, g in near_copies.in_blocks(few).toPandas().groupby(["band", "within", "one", "two"]):
        across = g["one"].iloc[0] != g["two"].iloc[0]
        for x in g.itertuples():
            for y in g.itertuples():
                if x.within and x.node < y.node and (x.outside or y.outside) and not (across and x.part == y.part) or not x.within and x.outside and not y.outside:
                    pair = (x.band, *sorted((x.node, y.node)))
                    met[pair] = met.get(pair, 0) + 1
    rows = few.collect()
    most = {1: 0, 2: 0, 3: 2}
    want = {(x.band, x.node, y.node) for x in rows for y in rows if x.band == y.band and x.node < y.node and not x.root == y.root == most[x.band]}
    assert set(met) == want and set(met.values()) == {1}


def test_equal_rows_with_other_columns(docs):
    rows = docs([(1, "a b c"), (1, "a b c"), (2, "A b c")]).withColumn("more", near_copies.F.map_from_arrays(near_copies.F.array(near_copies.F.lit("k")), near_copies.F.array(near_copies.F.monotonically_increasing_id())))
    for parts in (1, 3):
        (got,) = near_copies.first_of_each_group(rows.coalesce(1).orderBy(near_copies.F.rand()).repartition(parts)).collect()
        assert got["doc_id"] == 1
    assert got.asDict().keys() == set(rows.columns)


def test_sketches_lose_no_similar_pair(words):
    rng = random.Random(6)
    for n in (40, 400, 4000):
        base = [w.encode() for w in words(n)]
        for changed in range(1, n // 25 + 2):
            copy = list(base)
            for k in rng.sample(range(n), changed):
                copy[k] = b"changed"
            sketch = [near_copies.np.unique(near_copies.own_hashes(x, 5))[: near_copies.SKETCH] for x in (base, copy)]
            x, y = near_copies.own_shingles(base, 5), near_copies.own_shingles(copy, 5)
            reach = near_copies.may_reach(sketch[0], [sketch[1]], 0.8)[0]
            exact = len(x & y) >= 0.8 * len(x | y)
            assert reach or not exact
            if len(x | y) <= near_copies.SKETCH:
                assert reach == exact


def test_clashing_columns_stay(docs, words):
    rows = docs([(1, " ".join(words(20))), (2, None), (3, None)]).withColumns({"key_id": near_copies.F.lit("x"), "kept_id": near_copies.F.lit(1), "digest": near_copies.F.lit(2)})
    got = near_copies.first_of_each_group(rows)
    assert got.columns == rows.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 2]


def test_stored_tables_go(spark, docs):
    kept = common.stored(docs([(1, "a")]), "kept")
    (path,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
    assert common.clear_stored(spark) >= 1 and not os.path.exists(path.removeprefix("file://"))
    assert common.clear_stored(spark) == 0
