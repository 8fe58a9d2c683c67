"""The prefix trie against a brute-force version: blocks, sections, ties, turnless conversations, ids cut in parts."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import prefix_trie, staging

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """conv -> turns ``(role, text)`` in order."""
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(t[2], t[4]) for t in sorted(v)] for c, v in held.items()}


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(c - c % 100, [])[:h] + own[h:]
    return out


def trie(seqs):
    members = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda x: [y for y in members if len(y) == len(x) + 1 and y[:-1] == x]
        ends = ",".join(map(str, sorted(c for c in convs if len(seqs[c]) == len(node))))
        rows.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids(node)), sum(not kids(x) for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, ids, most=14):
    """Conversations of few distinct turns, so that they share openings, whole texts, and ends inside others."""
    r = random.Random(seed)
    rows = []
    for c in ids:
        for k in range(r.randrange(1, most)):
            rows.append((c, k, ["user", "assistant"][k % 2], r.choice(["a", "a", "a", "bé", "c" * 5])))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_as_brute_force(spark, seed):
    rows = made(seed, range(40))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(prefix_trie.trie_of(df)) == trie(sequences(rows))
    rows = made(seed, [*range(95, 125), 200, 205, 317, 399, 12_345])  # openings that are absent, or shorter than asked
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(prefix_trie.digest(df)) == trie(rebuilt(sequences(rows)))


def test_one_very_long_conversation_spans_ranges_and_sections(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SECTION", 5)
    monkeypatch.setattr(staging, "HOT_ROWS", 5)
    rows = [(7, k, "user", f"t{k % 3}") for k in range(90)] + [(c, k, "user", f"t{k % 3}") for c in (3, 8, 9) for k in range(20 * (c % 5))] + [(5, 0, "user", "t0"), (5, 1, "user", "else")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(prefix_trie.trie_of(df)) == trie(sequences(rows))


def test_copies_by_the_hundred(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    monkeypatch.setattr(staging, "HOT_ROWS", 5)
    rows = [(c, k, "user", "same") for c in range(120) for k in range(3)] + [(c, 3, "user", f"own {c % 4}") for c in range(0, 120, 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(prefix_trie.trie_of(df)) == trie(sequences(rows))
    assert got(prefix_trie.digest(df)) == trie(rebuilt(sequences(rows)))


def test_many_siblings(spark, monkeypatch):
    """The root is a hot parent: of blocks, of nodes, and of what chains hand up."""
    monkeypatch.setattr(staging, "HOT_ROWS", 3)
    rows = [(c, k, "user", f"{c % 37} {k}") for c in range(60) for k in range(1 + c % 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(prefix_trie.trie_of(df)) == trie(sequences(rows))


def test_blocks_without_siblings_are_not_refined(spark):
    """Turn boundaries inside a block that follows its prefix alone are a chain; the others are counted anew."""
    rows = [(c, k, "user", "x" if k < 8 else f"{c}") for c in range(5) for k in range(9)]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    nodes = prefix_trie.find_nodes(staging.stage(prefix_trie.prefixes(turns), "path"), turns.select("conv").distinct())
    assert sorted((r["depth"], r["n"]) for r in nodes.collect()) == [(d, 5) for d in range(9)] + [(9, 1)] * 5


def test_odd_rows(spark):
    rows = made(11, range(12)) + [(None, 0, "user", "lost"), (0, None, None, None), (0, None, "", ""), (3, 1, "user", "tie b"), (3, 1, "user", "tie a"), (3, 1, "user", "tie a"), (4, 2, None, "x" * 100_000), (205, 0, "user", "z"), (-7, 0, "user", "minus")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("mine").alias(c) for c in ("conv", "d", "node", "parent", "low", "n", "section", "pos")]).repartition(3)
    assert got(prefix_trie.trie_of(df)) == trie(sequences(rows))
    want = [r for r in rows if r[0] != -7]
    assert got(prefix_trie.digest(df.where("conv_id IS NULL OR conv_id >= 0"))) == trie(rebuilt(sequences(want)))
    assert prefix_trie.digest(df.limit(0)).count() == 0 and prefix_trie.digest(df.where("conv_id IS NULL")).count() == 0
    turnless = [r for r in range(100, 200) if zlib.crc32(str(r).encode()) % 6 >= 1][:3]  # their hundred's first is absent
    rows = [(c, 0, "user", "a") for c in turnless]
    root = got(prefix_trie.digest(spark.createDataFrame(rows, SCHEMA)))
    assert root == trie(rebuilt(sequences(rows))) and len(root) == 1
