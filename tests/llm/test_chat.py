import hashlib
import random

from pyspark.sql import functions as F

from sedimenta.llm import chat as C

NODES = "tree long, node long, parent long, role string, text string, score double"


def test_branches_are_ranked(spark):
    nodes = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "poor", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 2, "user", "more", 0.5), (1, 5, 3, "user", "tail", None), (2, 1, None, "user", "alone", 1.0)]
    out = {(r["tree"], r["leaf"]): r for r in C.format_branches(spark.createDataFrame(nodes, NODES)).collect()}
    assert set(out) == {(1, 5), (2, 1)}
    assert out[(1, 5)]["formatted"] == "".join(f"<|im_start|>{r}<|im_sep|>{t}<|im_end|>" for r, t in (("user", "root"), ("assistant", "good"), ("user", "tail")))
    every = C.format_branches(spark.createDataFrame(nodes, NODES), per_tree=None)
    assert {(r["tree"], r["leaf"]) for r in every.collect()} == {(1, 4), (1, 5), (2, 1)}


def test_deep_tree_and_cycle(spark):
    nodes = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", str(i), 1.0) for i in range(37)] + [(2, 1, 2, "user", "x", 1.0), (2, 2, 1, "user", "y", 1.0), (3, 5, 99, "user", "orphan", 1.0)]
    out = {r["tree"]: r["n_turns"] for r in C.format_branches(spark.createDataFrame(nodes, NODES)).collect()}
    assert out == {1: 37, 3: 1}


def test_reads_back_what_was_written(spark):
    r = random.Random(1)
    bits = [*C.CONTROL, C.START, C.SEP, C.END, "\\", "\\\\", "<", "|", "a", "é", "\n", "[", "</", "\U0001f600", "$1"]
    rows = [(c, k, r.choice(["user", "assistant", "system", "<|x", None, "a\nb"]), r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(0, 30)))])) for c in range(40) for k in range(r.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("tree"), F.lit(2).alias("node"))
    got = {x["conv_id"]: x for x in C.digest(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    probe = "</s>[INST] ok [/INST]"
    for c, turns in {**{c: [x for x in rows if x[0] == c] for c in range(40)}, -1: [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]}.items():
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert got[c]["turns_sha256"] == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns))
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), sha(loss))
    formatted = [x["formatted"] for x in C.format_branches(C.reply_tree(df)).collect()]
    assert sum(f.count(C.START) for f in formatted) == len(rows) and not any(t in f for f in formatted for t in C.CONTROL[1:])


def test_edges(spark):
    rows = [(None, 1, "user", "x"), (1, None, "user", "y"), (1, 2, "assistant", "z" * 10**6), (2, 1, "user", "same"), (2, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x["n_turns"] for x in C.digest(df).collect()}
    assert got == {None: 1, 1: 2, 2: 2, -1: 2}
    assert [x["conv_id"] for x in C.digest(df.limit(0)).collect()] == [-1]
    assert C.format_branches(spark.createDataFrame([], NODES)).collect() == []
