"""Chat formatting from reply trees, with DataFrame functions only.

A message table (one row per message: tree, node, parent, role, text, score) is resolved by iterative self-joins that
double the distance of each node's pointer toward its root, so a tree of depth d takes log2(d) rounds of joins on
narrow rows. The same pointers then enumerate the path of every chosen leaf. Branches are ranked per tree by the mean
score of their messages, and each chosen path becomes one formatted conversation.

Template: a turn is ``<turn role="ROLE">`` newline TEXT newline ``</turn>`` newline. ROLE is URL-encoded. In TEXT every
``<turn`` and ``</turn`` gets a backslash before it (after any that already stand there), which unescaping takes away
again; a real mark stands at the start of a line and so never follows a backslash.

Defined results: a null role or text is empty; a null parent, or one that the table lacks, makes a root; messages on a
parent cycle have no root and are on no path; ties in rank go to the deeper, then to the smaller node; an empty table
gives an empty result; further columns are ignored; a path is formatted as one row, however long its texts. In a flat conversation table, repeated (conversation, turn) rows are all kept, ordered by role and
text; null turns come first; rows with a null conversation id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

TURN_END = "\n</turn>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)(</?turn)", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)(</?turn)", "$1$2")


def flat_messages(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` as reply trees without branches: each turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order)
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), n)
    return rows.select("conv_id", "role", "text", place.alias("n")).select(
        F.col("conv_id").alias("tree"), name(F.col("n")).alias("node"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def ranked_paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """The root-to-leaf paths of every tree: ``tree, leaf, rank, node, place``, a row per message of a path.

    ``top`` keeps that many best branches of a tree (None: all). ``node`` values are unique over all trees."""
    links = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = links.select(F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    state = stored(
        links.join(known, "parent", "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).alias("depth")),
        "pointers",
    )
    leaves = state.select("tree", "node").join(state.select(F.col("up").alias("node")), "node", "left_anti")
    most, jumps, done = state.count(), [], state.where("up is null")
    open_ = state.where("up is not null")
    while not open_.isEmpty() and 2 ** len(jumps) <= most:
        jumps.append(open_.select("node", "up"))
        above = open_.unionByName(done).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("further"))
        moved = open_.join(above, "up").select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("further")).alias("depth"))
        moved = stored(moved, "pointers")
        done = done.unionByName(moved.where("up is null"))
        open_ = moved.where("up is not null")
    rated = leaves.join(done.drop("tree"), "node")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node"))
    chosen = rated.withColumn("rank", rank)
    if top is not None:
        chosen = chosen.where(F.col("rank") <= top)
    path = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("depth").alias("place"))
    whole = None
    for k, jump in enumerate(jumps):
        # a node stays and brings along the one 2**k above it, so that after all rounds each ancestor is there once; a node
        # less than 2**k below its root has brought all it will and leaves the rounds
        path = stored(path, "paths")
        settled = path.where(F.col("place") <= 2**k)
        whole = settled if whole is None else whole.unionByName(settled)
        here = F.struct("node", "place")
        there = F.struct(F.col("up").alias("node"), (F.col("place") - F.lit(2**k)).alias("place"))
        path = path.where(F.col("place") > 2**k).join(jump, "node").select("tree", "leaf", "rank", F.explode(F.array(here, there)).alias("at"))
        path = path.select("tree", "leaf", "rank", "at.node", "at.place")
    return path if whole is None else whole.unionByName(path)


def format_paths(messages: DataFrame, paths: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``tree, leaf, rank, formatted, loss_spans``: a row per path. ``loss_spans`` is the loss mask, the (start, length)
    of each trained text in the UTF-8 bytes of ``formatted``."""
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit('<turn role="'), F.url_encode(role), F.lit('">\n'))
    turns = messages.select("node", (role == trained_role).alias("trained"), head.alias("head"), text.alias("body"))
    turns = paths.join(turns, "node").withColumn("bytes", F.octet_length("head") + F.octet_length("body") + F.lit(len(TURN_END)))
    before = F.sum("bytes").over(Window.partitionBy("tree", "leaf", "rank").orderBy("place")) - F.col("bytes")
    parts = turns.select(
        "tree",
        "leaf",
        "rank",
        F.struct(
            "place",
            F.concat("head", "body", F.lit(TURN_END)).alias("turn"),
            F.when(F.col("trained"), F.struct((before + F.octet_length("head")).alias("start"), F.octet_length("body").cast("long").alias("length"))).alias("span"),
        ).alias("part"),
    )
    whole = parts.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("tree", "leaf", "rank", F.array_join("parts.turn", "").alias("formatted"), F.array_compact("parts.span").alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """What the formatted text alone says: adds ``turns`` (role and unescaped text of each) and ``loss_texts`` (the
    unescaped text under each span of the mask)."""
    pieces = F.split("formatted", TURN_END, -1)
    inner = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    mark, close = '<turn role="', '">\n'

    def turn(piece: Column) -> Column:
        at = F.locate(close, piece)
        name = F.url_decode(F.substring(piece, F.lit(len(mark) + 1), at - F.lit(len(mark) + 1)))
        return F.struct(name.alias("role"), unescaped(F.substring(piece, at + F.lit(len(close)), F.length(piece))).alias("text"))

    raw = F.col("formatted").cast("binary")
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    return conversations.withColumn("turns", F.transform(inner, turn)).withColumn("loss_texts", masked)


def op1_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turn = lambda n, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
    extra = spark.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = flat_messages(rows)
    read = read_back(format_paths(messages, ranked_paths(messages)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, length(regexp_replace(text, '(</?turn)', '\\\1', 'g')) + length(url_encode(role))
        + length('<turn role="">' || chr(10) || chr(10) || '</turn>' || chr(10)) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::bigint AS formatted_chars
FROM t GROUP BY conv_id
"""
