"""Prefix trie of conversations by fixed-length block hashing.

A node of the trie is a distinct sequence of first turns. Conversations are
grouped by the digests of successive blocks of ``BLOCK`` turns first: a group
is one block's text after one prefix, however many conversations share it.
Where a prefix is followed by one block alone, the turn boundaries inside it
split nothing, and its turns are a chain of nodes with the group's counts. Only
where sibling blocks diverge are they refined to turn boundaries, one row for
each turn of each distinct block. Texts are hashed where they are read and
never shuffled.

Prefix digests are exclusive-ors of (turn, place) hashes, 128 bits wide, so
they are summed in sections of ``SECTION`` turns and a very long conversation
is never gathered. What is summed over subtrees follows chains: a conversation
owns the nodes of which it is the smallest member, which are the rest of its
own path from some depth on, and hands their total once to each node above.
That makes at most as many rows as there are turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import join_hot, small_side, stage

#: Turns to a block, and to a section of prefix sums.
BLOCK, SECTION = 4, 256
#: Member ids that are joined to one text at a time.
IDS = 4096
#: Turns of the first conversation of each hundred that others may start with: h is less than this.
HEADS = 6


def node_key(a: Column | str, b: Column | str) -> Column:
    return F.struct(F.col(a).alias("p1") if isinstance(a, str) else a.alias("p1"), F.col(b).alias("p2") if isinstance(b, str) else b.alias("p2"))


def root_key() -> Column:
    return node_key(F.lit(0).cast("long"), F.lit(0).cast("long"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv, d, role, body, chars)``: each turn with its number from 1, its text as a digest and a length in code points.

    Turns are ordered by ``turn``, nulls first, ties by role and by the text's
    MD5; null roles and texts are empty. Rows without a conversation take no
    part, rows that repeat another are turns of their own, extra columns are
    left out. Ranges of the sort order are numbered apart and joined by their
    offsets, so a conversation with a large share of all turns spans many tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.unhex(F.md5(text)).alias("body"), F.length(text).cast("long").alias("chars")
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["turn", "role", "body"]
    ranged = stage(rows.repartitionByRange(parts, "conv", *order).withColumn("slot", F.spark_partition_id()), "trie-turns")
    offsets = ranged.groupBy("conv", "slot").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("conv").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.withColumn("before", before).where("before > 0").select(F.col("conv").alias("k"), F.col("slot").alias("s"), "before")
    local = ranged.withColumn("at", F.row_number().over(Window.partitionBy("conv", "slot").orderBy(*order)))
    joined = local.join(F.broadcast(offsets), (F.col("conv") == F.col("k")) & (F.col("slot") == F.col("s")), "left")  # a range continues one conversation at most
    return joined.select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).cast("long").alias("d"), "role", "body", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations that share openings: the first h turns are those of the first conversation of their hundred.

    h is the crc32 of the id modulo ``HEADS``. What the opening lacks moves the
    conversation's own later turns forward. ``turns`` should be staged.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS))
    turns = turns.withColumns({"base": F.col("conv") - F.col("conv") % 100, "h": h})
    got = F.max(F.when((F.col("conv") == F.col("base")) & (F.col("d") < HEADS), F.col("d")))
    bases = stage(turns.groupBy("base").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(got, F.lit(0)).alias("got")), "trie-bases")
    own = join_hot(turns.where(F.col("d") > F.col("h")), bases, "base", "rows").withColumn("d", F.col("d") - F.col("h") + F.least("h", "got"))
    opening = turns.where((F.col("conv") == F.col("base")) & (F.col("d") < HEADS)).select(F.col("base").alias("b"), "d", "role", "body", "chars")
    convs = turns.select("conv", "base", "h").distinct()  # a hundred of them share a base at most
    heads = convs.join(opening, (F.col("base") == F.col("b")) & (F.col("d") <= F.col("h")))
    columns = ["conv", F.col("d").cast("long").alias("d"), "role", "body", "chars"]
    return own.select(*columns).unionByName(heads.select(*columns))


def running(df: DataFrame, key: str, at: str, cells: dict[str, str], agg) -> DataFrame:
    """``df`` with the aggregate of each of ``cells`` (new name -> column) over the rows of its ``key`` up to its own, by ``at``.

    Sections are summed apart, and only one row a section is ordered by key, so no task orders all rows of one.
    """
    names = list(cells)
    df = df.withColumn("section", F.floor(F.col(at) / SECTION))
    inside = Window.partitionBy(key, "section").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, "section").agg(*[agg(c).alias(n) for n, c in cells.items()])
    carried = totals.select(F.col(key).alias("k"), F.col("section").alias("s"), *[agg(n).over(earlier).alias(f"{n}_before") for n in names]).where(f"{names[0]}_before IS NOT NULL")
    carried = small_side(stage(carried, "trie-sections"), 16 + 8 * len(names))
    local = df.select("*", *[agg(c).over(inside).alias(n) for n, c in cells.items()])
    return local.join(carried, (F.col(key) == F.col("k")) & (F.col("section") == F.col("s")), "left").drop("k", "s", "section")


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, pos, chars, node, parent)``: the node that each turn ends, and the one before it."""
    hashed = turns.select("conv", F.col("d").alias("pos"), "chars", F.xxhash64("d", "role", "body").alias("x1"), F.xxhash64(F.lit(7), "d", "role", "body").alias("x2"))
    summed = running(hashed, "conv", "pos", {"y1": "x1", "y2": "x2"}, F.bit_xor)
    full = summed.withColumns({n: F.col(n).bitwiseXOR(F.coalesce(f"{n}_before", F.lit(0))) for n in ("y1", "y2")})
    return full.select("conv", "pos", "chars", node_key("y1", "y2").alias("node"), node_key(F.col("y1").bitwiseXOR(F.col("x1")), F.col("y2").bitwiseXOR(F.col("x2"))).alias("parent"))


def find_nodes(path: DataFrame, convs: DataFrame) -> DataFrame:
    """``(node, parent, depth, chars, n, low)`` of every node; n members, low the smallest.

    ``path`` is staged. Blocks first, then turns inside blocks that have siblings.
    """
    turn = F.struct("pos", "node", "parent", "chars")
    blocks = path.groupBy("conv", F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = blocks.select("conv", F.col("turns")[0]["parent"].alias("parent"), F.element_at("turns", -1)["node"].alias("end"), "turns")
    groups = stage(blocks.groupBy("parent", "end").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("low"), F.min("turns").alias("turns")), "trie-blocks")
    siblings = stage(groups.groupBy("parent").agg(F.count(F.lit(1)).alias("siblings")), "trie-siblings")
    told = join_hot(groups.withColumnRenamed("parent", "above"), siblings.withColumnRenamed("parent", "above"), "above", "siblings")
    rows = told.select("siblings", "n", "low", F.explode("turns").alias("t")).select("siblings", "t.node", "t.parent", F.col("t.pos").alias("depth"), "t.chars", "n", "low")
    chains = rows.where("siblings = 1").drop("siblings")
    refined = rows.where("siblings > 1").groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.sum("n").alias("n"), F.min("low").alias("low"))
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("low")).where("n > 0")
    root = root.select(root_key().alias("node"), F.lit(None).cast(path.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n", "low")
    return chains.unionByName(refined).unionByName(root)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of ``(node, conv)``: SHA-256 of the ids, ascending and joined by commas.

    Ids are joined to texts of at most ``IDS``, which stream through the digest
    in order, so a node where a third of all conversations end needs no memory.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy(F.col("node.p1").alias("p1"), F.col("node.p2").alias("p2"), F.floor(F.col("conv") / IDS).alias("chunk")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, hashlib.sha256()
        for b in batches:
            done = []
            for p1, p2, ids in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (p1, p2) == now:
                    held.update(f",{ids}".encode())
                else:
                    if now is not None:
                        done.append((*now, held.hexdigest()))
                    now, held = (p1, p2), hashlib.sha256(ids.encode())
            yield table(done)
        yield table([(*now, held.hexdigest())] if now is not None else [])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["p1", "p2", "ends_sha256"])

    ordered = chunks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "chunk").select("p1", "p2", "ids")
    return ordered.mapInArrow(run, "p1 long, p2 long, ends_sha256 string").select(node_key("p1", "p2").alias("node"), "ends_sha256")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns (conv, d, role, body, chars)``; ``convs (conv)`` are all conversations, turnless ones too.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes of the subtree, its top
    included), ``saved_tokens`` (over the subtree, members but one times the
    last text's code points) and ``ends_sha256`` (of members that end there).
    d counts from 1 without gaps; ``convs`` are unique. No conversation, no
    rows; else there is a root.
    """
    path = stage(prefixes(turns), "trie-path")
    nodes = stage(find_nodes(path, convs), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("c"))
    nodes = nodes.join(children, F.col("node") == F.col("p"), "left").withColumns({"n_children": F.coalesce("c", F.lit(0)), "saved": (F.col("n") - 1) * F.col("chars")}).drop("p", "c")
    nodes = stage(nodes, "trie-children")
    chains = nodes.groupBy("low").agg(F.min("depth").alias("top"), F.max("depth").alias("end"), F.sum("saved").alias("total"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    chains = stage(chains, "trie-chains")
    handed = chains.where("top > 0").select(F.col("low").alias("conv"), "end", "top", "total", "leaves")
    above = join_hot(path.select("conv", "pos", "node"), handed, "conv", "end").where(F.col("pos") < F.col("top"))
    sums = [F.sum("total").alias("total_below"), F.sum("leaves").alias("leaves_below")]
    at_root = handed.agg(*sums).where("total_below IS NOT NULL").select(root_key().alias("node"), "total_below", "leaves_below")
    below = above.groupBy("node").agg(*sums).unionByName(at_root).withColumnRenamed("node", "v")
    last = path.groupBy("conv").agg(F.max(F.struct("pos", "node")).alias("last")).select(F.col("conv").alias("c"), "last.node")
    ends = convs.join(last, F.col("conv") == F.col("c"), "left").select(F.coalesce("node", root_key()).alias("node"), "conv")
    ends = ends_digests(ends).withColumnRenamed("node", "e")
    summed = running(nodes, "low", "depth", {"so_far": "saved"}, F.sum)
    own = summed.withColumn("so_far", F.col("so_far") + F.coalesce("so_far_before", F.lit(0)) - F.col("saved")).drop("so_far_before")
    owner = chains.select("low", F.col("end").alias("rows"), "total", F.col("leaves").alias("own_leaves"))
    own = join_hot(stage(own, "trie-own"), stage(owner.withColumn("rows", F.col("rows") + 1), "trie-owners"), "low", "rows")
    full = own.join(below, F.col("node") == F.col("v"), "left").join(ends, F.col("node") == F.col("e"), "left")
    full = stage(full.select(
        "parent", F.col("low").alias("conv_id"), "depth", F.col("n").alias("n_convs"), "n_children",
        (F.col("own_leaves") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"),
        (F.col("total") - F.col("so_far") + F.coalesce("total_below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    ), "trie-full")
    names = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("low").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    told = join_hot(full.where("depth > 0"), names, "parent", "rows").unionByName(full.where("depth = 0"), allowMissingColumns=True)
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of ``conversations (conv_id, turn, role, text)`` as they are; see ``numbered_turns`` for nulls and ties."""
    turns = stage(numbered_turns(conversations), "trie-numbered")
    return prefix_trie(turns, turns.select("conv").distinct())


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of the ``rebuilt`` conversations: nulls and ties as in ``numbered_turns``, an empty table gives no rows, conversations left without turns end at the root."""
    turns = stage(numbered_turns(conversations), "trie-numbered")
    return prefix_trie(stage(rebuilt(turns), "trie-rebuilt"), turns.select("conv").distinct())
