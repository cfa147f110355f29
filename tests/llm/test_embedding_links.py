"""Links of embeddings against all pairs."""

import math

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tidemark.llm import embedding_links, neighbour_graph, registry, vector_clumps


def slow_links(rows, threshold=0.93):
    """``vec_id, n_links, component_id, kept`` of (vec_id, vector, label) rows."""
    fine = [v is not None and lab is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if f else None for f, (_, v, _) in zip(fine, rows, strict=True)]
    least = [-(1 << 63) if i is None else i for i, _, _ in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    spaces = {}
    for k, (_, v, lab) in enumerate(rows):
        if fine[k]:
            spaces.setdefault((lab, len(v)), []).append(k)
    for at in spaces.values():
        u = np.array([unit[k] for k in at])
        for i, j in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1)), strict=True):
            a, b = at[i], at[j]
            n[a] += 1
            n[b] += 1
            root[max(top(a), top(b), key=lambda k: (least[k], k))] = min(top(a), top(b), key=lambda k: (least[k], k))
    ids = [None if least[top(k)] == -(1 << 63) else least[top(k)] for k in range(len(rows))]
    return sorted(((i, m, c, i == c) for (i, _, _), m, c in zip(rows, n, ids, strict=True)), key=str)


def around(rng, n, degrees, dim=24):
    """``n`` vectors that lie about ``degrees`` off one direction."""
    centre = rng.normal(size=dim)
    noise = rng.normal(size=(n, dim))
    noise -= np.outer(noise @ centre, centre) / (centre @ centre)
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return centre / np.linalg.norm(centre) + np.tan(np.radians(degrees)) * noise * rng.uniform(0.5, 1.2, (n, 1))


@pytest.fixture
def mixed():
    rng = np.random.default_rng(6)
    parts = [(around(rng, n, degrees), label) for n, degrees, label in ((150, 5, 1), (80, 9, 1), (60, 13, 1), (40, 16, 2), (2, 14, 2), (2, 10, 1), (30, 2, 2))]
    parts += [(rng.normal(size=(250, 24)), 1), (rng.normal(size=(100, 24)), 2), (around(rng, 12, 8, 7), 1)]
    rows = [(v.tolist(), lab) for x, lab in parts for v in x]
    order = rng.permutation(len(rows))
    return [(int(k), *rows[j]) for k, j in enumerate(order)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)


@pytest.mark.parametrize("small", [False, True])
def test_all_links(spark, monkeypatch, mixed, small):
    if small:
        monkeypatch.setattr(embedding_links, "MEMBERS", 5)
        monkeypatch.setattr(vector_clumps, "BLOCK", 8)
        monkeypatch.setattr(vector_clumps, "DENSE", 4)
        monkeypatch.setattr(neighbour_graph, "BLOCK", 8)
    got = embedding_links.near_embeddings(frame(spark, mixed))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == slow_links(mixed)


def test_edges(spark, mixed):
    rows = mixed[:120]
    some = rows[0][1]
    nan, inf = float("nan"), float("inf")
    rows += [(None, some, rows[0][2]), (rows[0][0], some, rows[0][2]), (500, [2 * c for c in some], rows[0][2]), (501, [-c for c in some], rows[0][2]), (502, some, None)]
    rows += [(503, None, 1), (504, [], 1), (505, [0.0] * 24, 1), (506, [None, *some[1:]], 1), (507, [nan] * 24, 1), (508, [inf, *some[1:]], 1), (509, [1e-300] * 24, 2), (510, [1e300] * 24, 2)]
    rows += [(600 + k, [1.0, 2.0, 3.0], 3) for k in range(70)] + [(700, [-0.0, 1.0], 4), (701, [0.0, 1.0], 4)]
    made = frame(spark, rows).withColumns({c: F.lit(1) for c in ("node", "weight", "leader", "a", "b", "d", "r", "s0", "n_links", "vec", "root")})
    got = sorted(map(tuple, embedding_links.near_embeddings(made).collect()), key=str)
    want = slow_links([(i, None if v is None else [c if c is None or abs(c) != 1e300 else 1.0 for c in v], lab) for i, v, lab in rows])
    assert got == want
    empty = embedding_links.near_embeddings(made.where("false"))
    assert empty.collect() == [] and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(1)
    assert sorted(map(tuple, registry.queries()["op11_nn_descent"](spark, DATA).collect()), key=str) == slow_links(rows)
    near = [(10_000 + i, (np.array(v) + rng.normal(0, 0.03, len(v))).tolist(), lab) for i, v, lab in rows[:150]]  # the table itself has no links
    got = embedding_links.near_embeddings(frame(spark, rows + near))
    want = slow_links(rows + near)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(r[1] for r in want) >= 200


def test_leaders_and_bits():
    near = np.eye(6, dtype=bool)
    near[0, 1:4] = near[1:4, 0] = near[4, 3] = near[3, 4] = True
    assert vector_clumps.led(near)[0].tolist() == [0, 0, 0, 0, 4, 5] and vector_clumps.led(near)[1] == 4
    x = np.random.default_rng(2).normal(size=(2, 4000, 32))
    a, b = x[0], x[0] + 0.3 * x[1]
    s = np.stack([vector_clumps.sketches(a), vector_clumps.sketches(b)], axis=1)
    bits = neighbour_graph.differing(s)[:, 0, 1]
    assert abs((bits * (math.pi / 256) - vector_clumps.angles(*(v / np.linalg.norm(v, axis=1)[:, None] for v in (a, b)))).mean()) < 0.01
