import random
from collections import Counter

import brute
from pyspark.sql import functions as F

import corpus_pipeline as P
from sedimenta.llm import line_dedup as L
from sedimenta.llm import mixing as M
from sedimenta.llm import staging


def docs_with_lines(seed=2):
    r = random.Random(seed)
    pool = [f"Shared Line {i} with words to make it forty characters" for i in range(12)] + ["short"] * 3 + ["", "é" * 40, " " * 50]
    docs = []
    for i in range(60):
        lines = [r.choice(pool) if r.random() < 0.6 else f"own line {r.randint(0, 10**6)} of some document, long enough" for _ in range(r.choice([1, 3, 9, 150]))]
        lines = [r.choice([x, f"  {x}\t", x.upper() if x.isascii() else x]) for x in lines]
        docs.append((i, "\n".join(lines)))
    return [*docs, (60, None), (61, ""), (62, "\n\n")]


def test_lines_equal_brute_force(spark):
    docs = docs_with_lines()
    df = spark.createDataFrame(docs, brute.DOCS).repartition(5)
    want = brute.deduped_lines(docs)
    assert sum(n for _, n in want.values()) > 50
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()}
    assert {d: t or "" for d, t in got.items()} == {d: "\n".join(k) for d, (k, _) in want.items()}
    told = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in L.digest(df).collect()}
    assert told == {d: (len(k) + n, n) for d, (k, n) in want.items()}


def test_line_edges(spark):
    line = "a line of more than forty characters, for certain"
    rows = [(i, line) for i in range(5)] + [(4, line), (None, line), (9, None)]
    df = spark.createDataFrame(rows, brute.DOCS).select("*", F.lit(1).alias("h1"), F.lit(2).alias("words"), F.lit(3).alias("doc"), F.lit(4).alias("pos"))
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    assert Counter(r["text"] for r in out.collect()) == Counter({"": 4, line: 3, None: 1})
    assert L.dedup_lines(df.limit(0)).collect() == [] and L.digest(df.limit(0)).collect() == []


def test_ids_that_repeat_with_other_texts(spark):
    line = "a line of more than forty characters, for certain"
    other = "other text first line that is long enough, really so"
    rows = [(i, f"{line}\nown {i}") for i in range(1, 7)] + [(1, f"{other}\nsecond"), (6, f"x\n{line}")]
    df = spark.createDataFrame(rows, brute.DOCS)
    assert Counter(L.dedup_lines(df).collect()) == Counter([(i, f"own {i}") for i in range(1, 6)] + [(1, f"{other}\nsecond"), (6, f"{line}\nown 6"), (6, f"x\n{line}")])


def test_bitmaps_are_runs(spark):
    lines = [f"line {i} of more than forty characters, for certain" for i in range(300)]
    rows = [(i, "\n".join([*lines[:200], f"own {i}", *lines[200:]])) for i in range(6)]
    got = L.keep_bitmaps(spark.createDataFrame(rows, brute.DOCS)).collect()
    assert sorted(r["doc_key"] for r in got) == [0, 1, 2, 3, 4] and {tuple(r["runs"]) for r in got} == {((0, 200), (201, 100))}


def test_hot_lines_are_joined_where_they_are(spark, monkeypatch):
    docs = docs_with_lines(5)
    df = spark.createDataFrame(docs, brute.DOCS).repartition(5)
    want = {d: "\n".join(k) for d, (k, _) in brute.deduped_lines(docs).items()}
    monkeypatch.setattr(staging, "HOT_ROWS", 0)
    for hot in (1, 8, 1000):  # none is hot, some are, all are
        monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(staging, "HOT", hot)
        assert {r["doc_id"]: r["text"] or "" for r in L.dedup_lines(df).collect()} == want


def test_occurrences_stream_in_their_ranges(spark, monkeypatch):
    """One shuffle by range feeds the marks of first occurrences; no aggregate by line and document follows."""
    plans = []
    monkeypatch.setattr(L, "stage", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or staging.stage(df, label))
    L.keep_bitmaps(spark.createDataFrame(docs_with_lines(), brute.DOCS)).collect()
    plan = dict(plans)["line-occurrences"]
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and plan.count("Sort ") == 1 and "Aggregate" not in plan and "Window" in plan


def test_mixing_equals_brute_force(spark):
    docs = [(i, "t", ["a", "a", "b", "c", None][i % 5]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    n = Counter(s for _, _, s in docs)
    got = Counter(r["doc_id"] for r in M.mix_sources(df).collect())
    assert got == Counter({d: c for d, _, s in docs if (c := brute.poisson_copies(d, 300 * 0.25 / n[s]))})
    weighed = M.mix_sources(df, {"b": 3, "c": 1}, total=400)
    got = Counter(r["doc_id"] for r in weighed.collect())
    assert got == Counter({d: c for d, _, s in docs if s in ("b", "c") and (c := brute.poisson_copies(d, 400 * {"b": 0.75, "c": 0.25}[s] / n[s]))})
    keys = [r["shuffle_key"] for r in weighed.coalesce(1).collect()]
    assert len(set(keys)) == len(keys)


def test_mixing_edges(spark, monkeypatch):
    df = spark.createDataFrame([(None, None, "a"), (1, "", "a"), (1, "", "a"), (2, "x" * 10**6, "b")], "doc_id long, text string, source string").select("*", F.lit(5).alias("rate"), F.lit(6).alias("k"))
    out = M.mix_sources(df)
    assert out.columns == [*df.columns, "copy", "shuffle_key"]
    same = Counter(tuple(r)[:3] for r in out.collect())
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert Counter(tuple(r)[:3] for r in M.mix_sources(df).collect()) == same
    assert M.mix_sources(df.limit(0)).collect() == [] and M.mix_sources(df, {"zz": 1}).collect() == [] and M.mix_sources(df, {}).collect() == []


def test_mixing_takes_high_rates(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(400)], "doc_id long, source string")
    got = Counter(r["source"] for r in M.mix_sources(df, max_rate=400.0).collect())
    assert 140 < got["a"] < 260 and 140 < got["b"] < 260
    bounded = M.mix_sources(df, max_rate=16.0)
    assert Counter(r["source"] for r in bounded.collect())["b"] == brute.poisson_copies(0, 16.0)
    told = {r["source"]: r["missed"] for r in M.source_rates(df, max_rate=16.0).collect()}
    assert told["a"] == 0 and abs(told["b"] - (200 - 16)) < 1e-9
    assert {r["missed"] for r in M.source_rates(df).collect()} == {0.0}


def test_weights_are_met_at_high_rates(spark):
    """A source of 100 documents that has to give 40 copies of each."""
    df = spark.createDataFrame([(i, "rare" if i < 100 else "much") for i in range(6000)], "doc_id long, source string")
    got = Counter(r["source"] for r in M.mix_sources(df, {"rare": 2, "much": 1}, total=6000).collect())
    assert abs(got["rare"] - 4000) < 260 and abs(got["much"] - 2000) < 190


def test_rare_sources_reach_their_weight(spark):
    docs = [(i, "t", "en", f"s{i % 19}" if i else "rare", 1) for i in range(20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for out in (M.query(df), P.mixing_stage(spark, df, "")):
        got = Counter({r["source"]: r["count"] for r in out.groupBy("source").count().collect()})
        rare = sum(brute.poisson_copies(0, 16.0, f"17/{k}" if k else 17) for k in range(62)) + brute.poisson_copies(0, 1000.0 - 62 * 16, "17/62")
        assert got["rare"] == rare and 850 < rare < 1150  # 1000 of 20,000 in the mean
        assert 19_300 < sum(got.values()) < 20_700
        assert all(got[f"s{k}"] == sum(brute.poisson_copies(d, 1000 / sum(1 for x in docs if x[3] == s)) for d, _, _, s, _ in docs if s == f"s{k}") for k in (0, 7))


def test_many_copies_are_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 7)
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(400)], "doc_id long, source string")
    copies = sorted(r["copy"] for r in M.mix_sources(df, max_rate=None).where("source = 'b'").collect())
    assert copies == list(range(len(copies))) and 140 < len(copies) < 260


def test_sql_draws_in_slices_too(spark):
    import duckdb

    from sedimenta.llm import oracles

    rows = [(i, "t", "en", f"s{i % 9}" if i else "rare", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = Counter(tuple(r) for r in con.execute(f"SELECT doc_id, copy, shuffle_key FROM ({oracles.OP8})").fetchall())
    assert Counter(tuple(r) for r in M.query(df).select("doc_id", "copy", "shuffle_key").collect()) == want and len(want) > 1500


def test_any_columns_of_a_mixture_can_be_read(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "en", "ab"[k % 2], 2) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", F.lit("x").alias("own_name"), F.lit("y").alias("OWN__n"), F.lit("z").alias("full"))
    whole = M.mix_sources(docs)
    assert whole.columns == [*docs.columns, "copy", "shuffle_key"]
    want = [r.asDict() for r in whole.collect()]
    for k in range(1, len(docs.columns) + 1):
        part = docs.columns[:k]
        got = M.mix_sources(docs).select(*part).collect()
        assert sorted(map(tuple, got)) == sorted(tuple(r[c] for c in part) for r in want), part
