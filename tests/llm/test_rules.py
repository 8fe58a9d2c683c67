import itertools
import random

import brute
from pyspark.sql import functions as F

from sedimenta.llm import rules as R


def data(seed=6):
    r = random.Random(seed)
    out = []
    for i in range(80):
        words = [r.choice(["a", "bb", "ccc", "d#", "$$$", "é", "x" * 30]) + (str(r.randint(0, 40)) if r.random() < 0.7 else "") for _ in range(r.choice([0, 3, 12, 60, 200]))]
        if r.random() < 0.4:
            words += words[:7] * r.randint(1, 4)
        out.append((i, "".join(w + r.choice([" ", " ", "\n", "\t", " ", "\n\n"]) for w in words)))
    return [*out, (80, None), (81, ""), (82, "same line\nsame line\n \n \nother")]


def test_statistics_equal_brute_force(spark):
    docs = data()
    got = {r["doc_id"]: r for r in R.digest(spark.createDataFrame(docs, brute.DOCS).repartition(3)).collect()}
    for d, t in docs:
        t = t or ""
        w, lines = brute.WORD.findall(t), [x for x in t.split("\n") if brute.WORD.search(x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), brute.repeat_words(t))
        assert r["base_failed"] == (len(w) < 10 or 100 * r["n_repeat_words"] > 20 * len(w)) and not (r["kept"] and r["base_failed"])


def test_many_distinct_words_take_ranked_codes():
    words = [f"w{i}" for i in range(7000)]
    text = " ".join(words + words[100:120])
    assert R.Stats(text).n_repeat_words == 40 == brute.repeat_words(" ".join(words[90:130] + words[100:120]))


def test_order_changes_no_verdict_and_the_cheap_rejecter_goes_first(spark):
    docs = data()
    for order in itertools.permutations(R.RULES):
        assert [R.first_failure(R.Stats(t), list(order)) is None for _, t in docs[:20]] == [R.first_failure(R.Stats(t), list(R.RULES)) is None for _, t in docs[:20]]
    never = R.Rule("never", lambda s: s.n_repeat_words < 0)
    often = R.Rule("often", lambda s: s.n_words < 20)
    df = spark.createDataFrame(docs, brute.DOCS)
    assert [r.name for r in R.order_rules(df, (never, often))] == ["often", "never"]


def test_edges(spark):
    df = spark.createDataFrame([(None, "w " * 3), (1, None), (1, "plain words that go on for a little while and then a bit more " + "q" * 100)], brute.DOCS).withColumn("kept", F.lit(7))
    assert R.digest(df).count() == 3 and R.digest(df.limit(0)).collect() == []
    kept = R.keep_clean(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1]
