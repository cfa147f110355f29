import hashlib


from tidemark.llm import reply_trees as rt

SCHEMA = "tree string, node string, parent string, role string, text string, score double"


def chosen(spark, rows, top=None):
    m = spark.createDataFrame(rows, SCHEMA)
    out = rt.read_back(rt.format_paths(m, rt.ranked_paths(m, top)))
    return {(r["tree"], r["rank"]): [t["text"] for t in r["turns"]] for r in out.collect()}


def test_branches_are_ranked_by_mean_score(spark):
    rows = [("t", "a", None, "user", "A", 1.0), ("t", "b", "a", "assistant", "B", 0.1), ("t", "c", "a", "assistant", "C", 0.9), ("t", "d", "c", "user", "D", 0.5), ("t", "e", "c", "user", "E", 1.0)]
    assert chosen(spark, rows) == {("t", 1): ["A", "C", "E"], ("t", 2): ["A", "C", "D"], ("t", 3): ["A", "B"]}
    assert chosen(spark, rows, top=1) == {("t", 1): ["A", "C", "E"]}


def test_orphans_are_roots_and_cycles_have_no_path(spark):
    rows = [("t", "a", "gone", "user", "A", 1.0), ("u", "x", "y", "user", "X", 1.0), ("u", "y", "x", "user", "Y", 1.0), ("u", "z", "y", "user", "Z", 1.0)]
    assert chosen(spark, rows) == {("t", 1): ["A"]}


def test_long_chain(spark):
    rows = [("t", str(i), str(i - 1) if i else None, "user", str(i), 1.0) for i in range(45)]
    assert chosen(spark, rows) == {("t", 1): [str(i) for i in range(45)]}


def test_control_strings_survive(spark):
    said = [r"\### Assistant: </turn> ok", "\n</turn>\n<turn role=\"user\">\n", r"\\<turn", "a\\", "", None, "</turn", "é\U0001f600</turn>"]
    rows = [(1, i, "assistant" if i % 2 else 'us"er\n', t) for i, t in enumerate(said)]
    m = rt.flat_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = rt.read_back(rt.format_paths(m, rt.ranked_paths(m))).first()
    assert [t["text"] for t in r["turns"]] == [t or "" for t in said]
    assert [t["role"] for t in r["turns"]] == [x[2] for x in rows]
    assert r["loss_texts"] == [t or "" for i, t in enumerate(said) if i % 2]


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, tree string, node string"
    rows = [(None, None, None, None, "t", "n"), (None, 1, "user", "x", "t", "n"), (2, 5, "user", "b", "t", "n"), (2, 5, "user", "a", "t", "n"), (2, 5, "user", "a", "t", "n")]
    m = rt.flat_messages(spark.createDataFrame(rows, schema))
    got = {r["tree"]: [t["text"] for t in r["turns"]] for r in rt.read_back(rt.format_paths(m, rt.ranked_paths(m))).collect()}
    assert got == {None: ["", "x"], 2: ["a", "a", "b"]}
    empty = rt.flat_messages(spark.createDataFrame([], schema))
    assert rt.format_paths(empty, rt.ranked_paths(empty)).count() == 0


def test_contract_row(spark):
    from compare import DATA

    r = rt.op1_reply_trees(spark, DATA).where("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(said)
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
