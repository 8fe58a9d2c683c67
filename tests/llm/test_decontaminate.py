import random

import brute
from pyspark.sql import functions as F

from sedimenta.llm import decontaminate as D

ITEMS = "item_id long, text string"


def data(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Été", "naïve", "Don't", "a-b"]
    say = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", " -- "]) for _ in range(n))
    items = [(i, say(r.choice([1, 3, 9, 10, 14, 30]))) for i in range(12)] + [(50, None), (51, " .,"), (52, say(4))]
    docs = []
    for i in range(60):
        text = say(r.randint(0, 80))
        for _ in range(r.choice([0, 0, 1, 3])):
            part = r.choice(items)[1] or ""
            at = r.randint(0, len(part))
            text += " " + part[at:].upper() + " " + say(3)
        docs.append((i, text))
    return [*docs, (60, None), (61, "")], items


def found(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in df.collect()}


def test_equals_brute_force_in_one_block_or_many(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, brute.DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = brute.leaks(docs, items)
    assert sum(n > 0 for _, n, _ in want.values()) > 20
    assert found(D.find_contamination(d, b)) == want
    assert found(D.find_contamination(d, b, block_words=20)) == want
    spans = lambda df: {r["doc_id"]: r["spans"] for r in df.collect()}
    assert spans(D.find_contamination(d, b, block_words=20)) == spans(D.find_contamination(d, b))
    assert {r["spans"] for n in (20, 10**6) for r in D.find_contamination(d, b, block_words=n, spans=False).collect()} <= {None}


def test_spans_point_into_the_original(spark):
    item = "one two three four five six seven eight nine ten"
    text = "Ünïcode first: ONE, two; three (four) five\nsix seven -- eight nine Ten! after"
    r = D.find_contamination(spark.createDataFrame([(1, text)], brute.DOCS), spark.createDataFrame([(7, item)], ITEMS)).first()
    (s,) = r["spans"]
    assert text[s["start"] : s["end"]] == "ONE, two; three (four) five\nsix seven -- eight nine Ten" and r["n_hit"] == 10


def test_edges(spark):
    b = spark.createDataFrame([(1, "only these three"), (1, "only these three"), (None, "no name here")], ITEMS).withColumn("n_hit", F.lit(1))
    d = spark.createDataFrame([(1, "x only these three"), (1, "x only these three"), (None, "no name here"), (2, "fine " * 50_000)], brute.DOCS).select("*", F.lit(1).alias("items"), F.lit(2).alias("n_words"))
    got = sorted((str(r["doc_id"]), r["n_hit"], r["items"]) for r in D.find_contamination(d, b).collect())
    assert got == [("1", 3, ["1"]), ("1", 3, ["1"]), ("2", 0, []), ("None", 3, ["null"])]
    assert D.find_contamination(d.limit(0), b).collect() == []
    assert all(r["n_hit"] == 0 for r in D.find_contamination(d, b.limit(0)).collect())
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None"]


def test_long_items_and_words_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE_WORDS", 12)
    r = random.Random(8)
    giant = "x" * 5000
    item = [f"q{i}" for i in range(90)] + [giant, "after"]
    docs = [(i, " ".join(item[i : i + 10])) for i in range(len(item) - 9)] + [(200, " ".join(item)), (201, " ".join([giant[1:], *item[:9]])), (202, " ".join(item[85:91] + ["no"]))]
    d, b = spark.createDataFrame(docs, brute.DOCS), spark.createDataFrame([(1, " ".join(item)), (2, giant)], ITEMS)
    assert found(D.find_contamination(d, b)) == found(D.find_contamination(d, b, block_words=24)) == brute.leaks(docs, [(1, " ".join(item)), (2, giant)])
    pieces = D.benchmark_pieces(b, 10).collect()
    assert len(pieces) > 20 and all(len(p["words"]) <= 12 and max(map(len, p["words"])) <= 64 for p in pieces) and r


def test_many_hits_in_a_long_text_are_mapped_in_one_pass():
    n = 40_000
    text = "é one two. " * n
    spans = D.spans_of(text, [[3 * k + 1, 3 * k + 3] for k in range(n)])
    assert len(spans) == n and all(text[s["start"] : s["end"]] == "one two" for s in (spans[0], spans[n // 2], spans[-1]))


def test_rows_go_by_their_own_text(spark):
    b = spark.createDataFrame([(1, "only these three")], ITEMS)
    d = spark.createDataFrame([(1, "x only these three"), (1, "clean"), (2, None), (2, "")], brute.DOCS)
    d = d.select("*", *(F.lit(1).alias(c) for c in ("row", "doc", "bad", "text_key", "__bad")))
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(map(str, (r["text"] for r in kept.collect()))) == ["", "None", "clean"]
