"""Chat formatting from reply trees, in DataFrame operations alone.

A tree's nodes point to their parents. Root-to-leaf paths are enumerated by
iterative self-joins that double their reach: after k joins every node knows
its ancestor 2^k steps up, so a tree of depth d takes log2(d) joins, on ids
alone. Branches are ranked by the sum of their nodes' scores, and each chosen
path becomes one conversation.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn.
Inside roles and texts a backslash is doubled and one is put into every control
string, so no text can open or close a turn and the original can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import stage

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Openings of control strings in common chat templates; a backslash goes after their first character.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for token in CONTROL:
        c = F.replace(c, F.lit(token), F.lit(token[0] + "\\" + token[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def reply_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: every turn answers the one before it.

    Turns are ordered by (turn, role, text), nulls first, so ties and repeated
    rows have a set order. Extra columns are left out.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return rows.select("tree", at.alias("node"), F.when(at > 1, at - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)``: each leaf's path, ``up`` steps above the leaf.

    Nodes whose parent is missing are roots. Nodes on a cycle belong to no
    root-to-leaf path and are left out.
    """
    ids = stage(nodes.select("tree", "node", "parent").where(F.col("node").isNotNull()).distinct(), "chat-nodes")
    parents = ids.select(F.col("tree").alias("t"), F.col("node").alias("p")).distinct()
    same = F.col("tree").eqNullSafe(F.col("t"))
    jump = ids.join(parents, same & (F.col("parent") == F.col("p")), "left_semi")
    inner = jump.select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = ids.join(inner, same & (F.col("node") == F.col("p")), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")).distinct()
    jumps, reach, total = [], jump.select("tree", "node", F.col("parent").alias("above")), ids.count()
    while True:
        reach = stage(reach.distinct(), "chat-jump")
        if reach.isEmpty() or 1 << len(jumps) > total:  # the latter: only cycles are left
            break
        jumps.append(reach)
        further = reach.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("above").alias("far"))
        reach = reach.join(further, same & (F.col("above") == F.col("p"))).select("tree", "node", F.col("far").alias("above"))
    paths = leaves
    for k in reversed(range(len(jumps))):
        step = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("p"), "above")
        higher = paths.join(step, same & (F.col("node") == F.col("p"))).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = stage(paths.unionByName(higher), "chat-paths")
    return paths


def format_branches(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """One row per chosen branch: ``tree, leaf, branch_score, formatted, loss_spans, n_turns``.

    ``nodes`` has ``tree, node, parent, role, text, score``. Branches are
    ranked by the sum of their scores (null: 0), ties by the smallest leaf;
    ``per_tree`` of each tree are formatted (None: all). Null roles and texts
    are empty. ``loss_spans`` are (start, length) in code points of
    ``formatted``: the escaped text of each assistant turn. A branch becomes
    one row, so it has to fit one, as its formatted text does. Rows that
    repeat a (tree, node) are one node: the smallest (role, text, score).
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = stage(nodes.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min(F.struct("role", "text", "score", "parent")).alias("n")).select("tree", "node", "n.parent", "n.role", "n.text", "n.score"), "chat-turns")
    paths = leaf_paths(nodes)
    on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p"))
    if per_tree is not None:  # ranked on ids and scores, before any text is moved
        points = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"), "score")
        scores = paths.join(points, on).groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
        best = scores.withColumn("rank", rank).where(F.col("rank") <= per_tree).select(F.col("tree").alias("u"), F.col("leaf").alias("l"))
        paths = paths.join(best, F.col("tree").eqNullSafe(F.col("u")) & (F.col("leaf") == F.col("l")), "left_semi")
    held = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"), "role", "text", "score")
    full = paths.join(held, on).drop("t", "p")
    turns = full.groupBy("tree", "leaf").agg(
        F.sum("score").alias("branch_score"),
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text")))).alias("turns"),
    )
    pieces = turns.withColumn("pieces", F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))))
    lens = len(START) + len(SEP)
    spans = F.expr(
        f"""aggregate(turns, struct(0 AS at, cast(array() AS array<struct<start:int,length:int>>) AS spans),
        (a, t) -> struct(a.at + {lens + len(END)} + length(t.role) + length(t.text) AS at,
          CASE WHEN t.role = 'assistant' THEN array_append(a.spans, struct(a.at + {lens} + length(t.role) AS start, length(t.text) AS length)) ELSE a.spans END AS spans)).spans"""
    )
    return pieces.select("tree", "leaf", "branch_score", F.array_join("pieces", "").alias("formatted"), spans.alias("loss_spans"), F.size("turns").cast("long").alias("n_turns"))


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p):
        body = F.substring_index(F.substring_index(p, END, 1), SEP, -1)
        return F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
    return F.array_join(cut, "")


def digest(conversations: DataFrame) -> DataFrame:
    """The formatted conversations, and conversation -1, read back and digested.

    Null roles and texts are empty, long texts are formatted whole. Turns that
    tie, and repeated rows, are turns in the order of role and text. Rows
    without a conversation are one conversation without an id. An empty table
    gives conversation -1 alone; extra columns are left out.
    """
    spark = conversations.sparkSession
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    out = format_branches(reply_tree(rows)).withColumn("read", read_turns(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
