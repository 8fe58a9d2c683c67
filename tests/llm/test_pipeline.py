import brute
from pyspark.sql import functions as F

import corpus_pipeline as P
from sedimenta.llm import quality

DIR = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    scores = quality.digest(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    good = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    rows = [(d, "\n".join(k)) for d, (k, _) in brute.deduped_lines(rows).items()]
    groups = brute.components(rows, 5)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    found = brute.leaks(rows, items)
    rows = [(d, t) for d, t in rows if not found[d][1]]
    n = {}
    for d, _ in rows:
        n[source[d]] = n.get(source[d], 0) + 1
    want = sorted((d, k, t) for d, t in rows for k in range(brute.poisson_copies(d, len(rows) / len(n) / n[source[d]])))
    got = P.run(spark, DIR)
    assert sorted((r["doc_id"], r["copy"], r["text"]) for r in got.collect()) == want and len(want) > 20
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, None, "en", None, None)], docs.schema)
    for table in (docs.unionByName(odd), docs.limit(0)):
        for name, fn in P.STAGES[:-1]:
            out = fn(spark, table.withColumn("extra", F.lit(1)), DIR)
            assert out.columns == [*docs.columns, "extra"], name
            out.collect()
    assert [name for name, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mixing"]
