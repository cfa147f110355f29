"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest
from compare import DATA
from pyspark.sql import functions as F

from tidemark.llm import registry, target_draw

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow_features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def slow_draw(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own, aim = [0] * 10000, [0] * 10000
    for counts, texts in ((own, [t for _, t in docs]), (aim, target)):
        for t in texts:
            for f in slow_features(t)[1]:
                counts[bucket(f)] += 1
    s, t = sum(own), sum(aim)
    gain = [math.floor(1000 * math.log((b + 1) * (s + 10000) / ((a + 1) * (t + 10000)))) for a, b in zip(own, aim, strict=True)]
    rows = []
    for i, text in docs:
        words, made = slow_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in made)
        rows.append([i, len(made), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -(1 << 63) if r[0] is None else r[0], -r[1]))
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, (r[:5] for r in rows)), key=str)


def test_features(words):
    for text in ("", "?!", "One", "Éa b,c 1\x7f2 Ab-aB ɐ x", " ".join(words(300))):
        found, made = slow_features(text)
        n, at = target_draw.feature_buckets(text.encode())
        assert n == len(found) and at.tolist() == [zlib.crc32(f.encode()) % 10000 for f in made]


def test_op13(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = registry.queries()["op13_importance_draw"](spark, DATA)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == slow_draw(docs, target)


def test_edges(spark, docs, words):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng.randint(15, 60)))) for i in range(150)] + [(7, None), (None, ""), (None, " ?! "), (None, " ".join(words(40)))]
    rows += [(900, "same words here " * 20)] * 30 + [(901, " ".join(words(60_000)))]
    target = ["same words here", None, "", "same words"]
    made = docs(rows).withColumns({c: F.lit(1) for c in ("score", "rank", "n_words", "fits", "spread", "part", "weight", "bucket")})
    got = target_draw.resampled(made, spark.createDataFrame([(t,) for t in target], "text string")).drop("n_words")
    assert sorted(map(tuple, got.collect()), key=str) == slow_draw(rows, [t for t in target if t])
    empty = target_draw.resampled(docs([]), spark.createDataFrame([], "text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("cuts", [1, 7])
def test_cutoff_and_ties(spark, monkeypatch, cuts):
    monkeypatch.setattr(target_draw, "CUTS", cuts)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice([-5, 0, 2, 900, 10**6])) for _ in range(300)]
    made = spark.createDataFrame(rows, "doc_id long, score long")
    order = sorted(rows, key=lambda r: (-r[1], -1 if r[0] is None else r[0]))
    for wanted in (0, 77, 300):
        drawn = target_draw.draw(made, wanted, F.lit(True)).collect()
        assert len(drawn) == 300
        got = sorted((r["rank"], r["doc_id"], r["score"]) for r in drawn if r["rank"])
        assert got == [(k + 1, *r) for k, r in enumerate(order[:wanted])]
    values = sorted((r[1] for r in rows), reverse=True)
    for wanted in (1, 299):
        assert target_draw.cutoff(made, "score", wanted) == (values[wanted - 1], sum(v > values[wanted - 1] for v in values))
