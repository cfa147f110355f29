"""Host quality, line hashes, line chunks and decontamination on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import contamination, host_quality, line_chunks, line_hash


def brute_repeats(words, size=5):
    at = {}
    for i in range(len(words) - size + 1):
        at.setdefault(tuple(words[i : i + size]), []).append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(size)})


def test_repeated_words():
    rng = random.Random(2)
    for n in (0, 4, 5, 6, 30, 400):
        for kinds in (1, 2, 3, 500):
            words = [str(rng.randrange(kinds)).encode() for _ in range(n)]
            assert host_quality.repeated_words(words) == brute_repeats(words)
    many = [str(i).encode() for i in range(9000)]  # more kinds than five fit into one key
    assert host_quality.repeated_words(many + many[:50]) == 100


def test_bad_host_takes_its_documents(spark, docs, words):
    good, bad = " ".join(words(30)), "short"
    rows = [(i, good + f" {i}" if i % 4 == 0 and i < 100 or i >= 100 else bad, "en", "bad" if i < 100 else f"h{i % 10}", 1) for i in range(400)]
    rows += [(900, None, None, None, None), (901, good, None, None, None), (901, good, None, None, None)]
    got = {r["doc_id"]: r for r in host_quality.quality_verdicts(docs(rows)).collect()}
    assert not got[0]["base_failed"] and not got[0]["kept"]
    assert got[100]["kept"] and got[901]["kept"] and got[900]["base_failed"]
    kept = host_quality.keep_good(docs(rows).withColumn("measures", F.lit(1)))
    assert kept.columns[-1] == "measures"
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(100, 400), 901, 901]


def test_one_failing_document_does_not_condemn_a_host(docs, words):
    rows = [(i, " ".join(words(20)), "en", f"h{i}", 1) for i in range(60)] + [(60, "x", "en", "h60", 1), (61, " ".join(words(20)), "en", "h60", 1)]
    got = {r["doc_id"]: r["kept"] for r in host_quality.quality_verdicts(docs(rows)).collect()}
    assert got[61] and not got[60]


def test_empty_tables(spark, docs):
    none = docs([])
    assert host_quality.quality_verdicts(none).count() == 0 and host_quality.keep_good(none).count() == 0
    assert line_hash.dedup_units(none)[0].count() == 0
    assert line_chunks.without_repeated_chunks(none).count() == 0
    assert contamination.find_items(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def removed_of(out, kept, removed):
    return {r["doc_id"]: (r[kept], [(s["start"], s["stop"]) for s in r[removed] or []]) for r in out.collect()}


def test_lines_keep_the_earliest_with_offsets(docs):
    line = "One two  three four FIVE"
    rows = [(5, f"first\n{line}\nlast"), (3, line.lower()), (7, f"é {line}\n{line} "), (8, None), (9, ""), (10, " \n\n")]
    out, kept, removed = line_hash.dedup_units(docs(rows).withColumn("found_spans", F.lit("mine")).withColumn("cut", F.lit(1)), unit="line", run_chars=0)
    got = removed_of(out, kept, removed)
    assert got[3] == (line.lower(), [])
    assert got[5] == ("first\nlast", [(6, 7 + len(line))])
    assert got[7] == (f"é {line}\n", [(len(line) + 3, 2 * len(line) + 4)])
    assert got[8] == (None, []) and got[9] == ("", []) and got[10] == (" \n\n", [])


def test_paragraphs(docs):
    p = "alpha beta gamma\ndelta epsilon"
    out, kept, _ = line_hash.dedup_units(docs([(1, f"{p}\n\nrest"), (2, f"head\n\n{p}\n")]), unit="paragraph", run_chars=0)
    assert {r["doc_id"]: r[kept] for r in out.collect()} == {1: f"{p}\n\nrest", 2: "head\n\n"}


def brute_runs(rows, run_chars):
    """(kept text, removed spans) by document, one unit at a time."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        units, start = [], 0
        for k in range(1, len(text or "") + 1):
            end = k == len(text) or (text[k - 1] in " \t\n" and text[k] not in " \t\n")
            if end and (k == len(text) or "\n" in text[len(text[:k].rstrip()) : k] or text[:k].rstrip()[-1:] in (".", "!", "?")):
                units.append((start, k))
                start = k
        names = [" ".join(text[a:b].lower().split()) for a, b in units]
        real = [k for k, x in enumerate(names) if x]
        runs = []
        for k in real:
            if names[k] in seen:
                if runs and real.index(runs[-1][-1]) + 1 == real.index(k):
                    runs[-1].append(k)
                else:
                    runs.append([k])
            seen.add(names[k])
        gone = [(units[r[0]][0], units[r[-1]][1]) for r in runs if sum(len(names[k]) for k in r) >= run_chars]
        kept = "".join(c for k, c in enumerate(text or "") if not any(a <= k < b for a, b in gone))
        out[i] = (None if text is None else kept, gone)
    return out


def test_runs_against_brute_force(docs, words):
    rng = random.Random(4)
    pool = [" ".join(words(rng.randint(1, 9))) for _ in range(40)]
    passages = [[rng.choice(pool) + "." for _ in range(rng.randint(1, 6))] for _ in range(8)]
    rows = [(None, "A b. C d.\nE f"), (400, ""), (401, None), (402, pool[0]), (403, pool[0]), (404, ". ".join([" ".join(words(9)) for _ in range(4000)]))]
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [" ".join(words(7)) + rng.choice([".", "!", ""])]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\n\n", "  "]) for x in parts)))
    for run_chars in (0, 60, 150):
        assert removed_of(*line_hash.dedup_units(docs(rows), run_chars=run_chars)) == brute_runs(rows, run_chars)


def test_units_of_equal_rows_and_other_scripts(docs, words):
    text = " ".join(" ".join(words(8)) + "." for _ in range(6))
    han = "".join(chr(0x4E00 + k) + ("。" if k % 20 == 19 else "") for k in range(400))
    got = sorted((r[0], r["kept_text"]) for r in line_hash.dedup_units(docs([(1, text), (1, text), (2, text), (3, han), (4, "x y. " + han)]))[0].collect())
    assert got == [(1, text), (1, text), (2, ""), (3, han), (4, "x y. ")]


def brute_chunks(rows):
    """Texts without every line under a chunk that an earlier place has as well."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines, gone = (text or "").encode().split(b"\n"), set()
        for first, n in line_chunks.all_chunks(lines):
            raw = b"\n".join(lines[first : first + n])
            if raw in seen:
                gone |= set(range(first, first + n))
            seen.add(raw)
        out[i] = b"\n".join([x for k, x in enumerate(lines) if k not in gone]).decode()
    return out


def repeated_pairs(rows):
    """By document, the numbers of the lines in two adjacent ones, of 25 code points, that an earlier place has: no boundaries of chunks in it."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        for k in range(len(lines) - 1):
            raw = "\n".join(lines[k : k + 2])
            if len(raw) >= 25 and all(x.strip() for x in lines[k : k + 2]):
                if raw in seen:
                    out.setdefault(i, set()).update((k, k + 1))
                seen.add(raw)
    return out


def test_recall_of_repeated_lines(docs, words):
    rng = random.Random(17)
    passages = [[" ".join(words(5)) for _ in range(rng.choice((2, 2, 3, 5)))] for _ in range(60)]
    rows = []
    for i in range(400):
        lines = [" ".join(words(6)) for _ in range(rng.randint(1, 6))]
        if i % 2:
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(passages)
        rows.append((i, "\n".join(lines)))
    want = repeated_pairs(rows)
    out, _, removed = line_chunks.dedup_chunks(docs(rows))
    got = {r["doc_id"]: {k for s in r[removed] for k in range(s["line"], s["line"] + s["n_lines"])} for r in out.collect() if r[removed]}
    assert len(want) > 100 and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(got[i] <= want[i] for i in got)  # nothing but repeated lines goes


def test_each_line_is_kept_somewhere(docs, words):
    rng = random.Random(18)
    pool = [" ".join(words(5)) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(90, "\n".join([pool[0]] * 5)), (91, "")]
    out, kept, removed = line_chunks.dedup_chunks(docs(rows))
    got = {r["doc_id"]: r for r in out.collect()}
    assert {x for _, t in rows for x in t.split("\n")} == {x for r in got.values() for x in r[kept].split("\n")} | {""}
    for i, text in rows:
        lines, raw = text.split("\n"), text.encode()
        for s in got[i][removed] or []:
            assert raw[s["start"] : s["stop"]].decode() == "\n".join(lines[s["line"] : s["line"] + s["n_lines"]])


def test_one_line_many_times_and_blank_lines(docs, words):
    a, b = (" ".join(words(8)) for _ in range(2))
    blank = f"\n\n{a}\n\n \n"
    rows = [(1, "\n".join([a] * 6)), (2, blank), (3, blank), (4, f"{b}\n\n{b}")]
    got = {r["doc_id"]: r["kept_text"] for r in line_chunks.dedup_chunks(docs(rows))[0].collect()}
    assert got[1] == a and got[2] == blank and got[3] == blank and got[4] == rows[3][1]


def test_chunks_against_brute_force(docs, words):
    rng = random.Random(9)
    passages = [[" ".join(words(6)) for _ in range(rng.randint(3, 12))] for _ in range(6)]
    rows = []
    for i in range(60):
        lines = [" ".join(words(3)) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            lines += rng.choice(passages) + [" ".join(words(4)) for _ in range(rng.randint(0, 2))]
        rows.append((i, "\n".join(lines)))
    clash = docs(rows).withColumns({"gone_id": F.lit(1), "key_id": F.lit(2), "digest": F.lit("x")})
    out, kept, removed = line_chunks.dedup_chunks(clash)
    assert out.columns[:8] == clash.columns
    got = {r["doc_id"]: r[kept] for r in out.collect()}
    assert got == brute_chunks(rows)
    assert out.where(F.size(removed) > 0).count() > 10


def test_chunk_boundaries_resist_shifts(words):
    passage = [x.encode() for x in words(40)]
    cut = lambda lines: {b"\n".join(lines[a : a + n]) for a, n in line_chunks.chunks(lines)}
    alone, shifted = cut(passage), cut([b"new", b"lines", b"before", *passage])
    assert len(alone & shifted) >= len(alone) - 3


def test_last_lines_go_with_the_chunk_before(docs, words):
    assert all(n >= 2 for lines in range(2, 40) for _, n in line_chunks.chunks([str(k).encode() for k in range(lines)]))
    text = "\n".join(" ".join(words(6)) for _ in range(9))
    han = "\n".join("".join(chr(0x4E00 + 40 * k + j) for j in range(30)) for k in range(5))
    rows = [(1, text), (2, text), (3, han), (4, han), (None, han), (5, "one line"), (6, "one line")]
    out, kept, _ = line_chunks.dedup_chunks(docs(rows))
    assert {r["doc_id"]: r[kept] for r in out.collect()} == {1: text, 2: "", 3: "", 4: "", None: han, 5: "one line", 6: "one line"}


def test_equal_rows_are_one_document(docs, words):
    text = "\n".join(" ".join(words(6)) for _ in range(8))
    out, kept, _ = line_chunks.dedup_chunks(docs([(1, text), (1, text), (2, text)]))
    got = sorted((r["doc_id"], r[kept]) for r in out.collect())
    assert got[0] == got[1] == (1, text) and len(got[2][1]) < len(text)


def test_containment(spark, docs, words):
    long = words(3000)
    item = words(25)
    most = [*item[:20], "changed", *item[21:]]  # 16 of 21 shingles: under the threshold
    near = [*item[:24], "other"]  # 20 of 21
    short = ["only", "three", "words"]
    rows = [(1, " ".join(long[:500] + item + long[500:])), (2, " ".join(long[:9] + most)), (3, " ".join(long + near)), (4, " ".join(long)), (5, "x ONLY, three\nwords."), (6, None), (7, " ".join(item[:12] + long[:50] + item[8:]))]
    bench = spark.createDataFrame([(10, " ".join(item).upper()), (11, "only three words"), (12, ""), (13, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in contamination.find_items(docs(rows), bench).collect()}
    assert got == {(1, 10, 21, 21), (3, 10, 20, 21), (5, 11, 1, 1), (7, 10, 21, 21)} and short
    kept = contamination.without_items(docs(rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 6]


def test_items_without_an_id(spark, docs, words):
    one, two, three = (" ".join(words(20)) for _ in range(3))
    rows = [(1, f"x {one} y"), (2, f"x {two} y"), (3, f"x {three} y"), (4, " ".join(words(20)))]
    bench = spark.createDataFrame([(None, one), (None, two), (7, three)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contamination.find_items(docs(rows), bench).collect()} == {(1, None), (2, None), (3, 7)}
    assert [r["doc_id"] for r in contamination.without_items(docs(rows), bench).collect()] == [4]
    # items of one id match each, so do repeated rows; names that the search uses itself may be there
    bench = spark.createDataFrame([(7, one), (7, two), (7, one)], "item_id long, text string")
    clash = docs([*rows, (None, f"{one} {two}"), rows[0]]).withColumns({"found_item": F.lit(1), "found_items": F.lit(2), "item_id": F.lit(3)})
    got = sorted(((r["doc_id"], r["item_id"]) for r in contamination.find_items(clash, bench).collect()), key=str)
    assert got == sorted([(1, 7)] * 4 + [(2, 7)] + [(None, 7)] * 3, key=str)
    left = contamination.without_items(clash, bench)
    assert left.columns == clash.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4]
    with pytest.raises(ValueError, match="item_id"):
        contamination.find_items(clash, bench, carried=("doc_id", "item_id"))


def test_blocks_split_the_items(spark, docs, words, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_SHINGLES", 20)
    items = [(i, " ".join(words(12))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(contamination.blocks(bench))) > 2
    rows = [(i, f"a b c {t} d e") for i, t in items]
    assert {(r["doc_id"], r["item_id"]) for r in contamination.find_items(docs(rows), bench).collect()} == {(i, i) for i, _ in items}
    assert [r["doc_id"] for r in contamination.without_items(docs([*rows, (50, "clean")]), bench).collect()] == [50]
