import bisect
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimenta.functions.scalars import row_hash
from sedimenta.operators import audit, bronze, cdc, contract, layout, quality
from sedimenta.plans import silver
from sedimenta.plans.change_batches import make_change_batches
from sedimenta.sources import storage
from sedimenta.sources.tables import Table, drop_all


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")



def test_latest_nulls_last_and_ties(spark):
    df = spark.createDataFrame([("a", None, 9), ("a", 1, 1), ("a", 1, 2), ("b", None, None), (None, 1, 1)], "k string, x int, y int")
    assert rows(cdc.latest_per_key(df, ["k"], ["x", "y"])) == sorted([("a", 1, 2), ("b", None, None), (None, 1, 1)], key=str)


def test_gate_messages_in_order(spark):
    df = spark.createDataFrame([("s1", "t", "Movie", 2000), (None, None, "Documentary", None), ("s2", "t", None, 1899)], "show_id string, title string, content_type string, release_year int")
    ok, bad = quality.quality_gate(df, silver.title_rules(F.lit("2024-01-01").cast("date")), now())
    assert [r["show_id"] for r in ok.collect()] == ["s1"]
    texts = sorted(r["_quality_errors"] for r in bad.collect())
    assert texts[1] == "show_id is null or empty; title is null or empty; content_type is not Movie or TV Show; release_year is missing or outside accepted range"
    assert texts[0] == "content_type is not Movie or TV Show; release_year is missing or outside accepted range"


def test_report_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "x int")
    assert quality.quality_report(df, {"bad": F.col("x").isNull()}).first()["bad"] is None


def test_scd1(spark):
    target = spark.createDataFrame([("a", "1", "h1", "b1", 1), ("b", "1", "h1", "b1", 1), ("c", "1", "h1", "b1", 1)], "k string, v string, _record_hash string, _batch_id string, created int")
    source = spark.createDataFrame([("a", "2", "h2", "b2", 2, "en"), ("b", "1", "h1", "b2", 2, "en"), ("d", "1", "h3", "b2", 2, "en")], "k string, v string, _record_hash string, _batch_id string, created int, lang string")
    got = rows(cdc.scd1_merge(target, source, ["k"], keep=("created",)))
    assert got == [("a", "2", "h2", "b2", 1, "en"), ("b", "1", "h1", "b1", 1, None), ("c", "1", "h1", "b1", 1, None), ("d", "1", "h3", "b2", 2, "en")]
    assert rows(cdc.scd1_merge(target, source.limit(0), ["k"], keep=("created",)).select("k")) == [("a",), ("b",), ("c",)]
    assert cdc.scd1_merge(target.limit(0), source, ["k"], keep=("created",)).count() == 3
    with pytest.raises(ValueError):
        cdc.scd1_merge(target, source.union(source), ["k"])


def test_scd2_waves_equal_one_pass(spark):
    r, log = random.Random(5), []
    table = Table(spark, storage.scratch(spark, "t"), "h")
    for wave in range(1, 5):
        batch = [(f"k{i}", str(r.randint(0, 2))) for i in range(12) if r.random() < 0.6]
        log += [(k, v, wave) for k, v in batch]
        source = spark.createDataFrame(batch, "k string, v string").withColumn("_record_hash", row_hash(["k", "v"]))
        table.create_like(source.select("*", F.lit(0).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), F.lit(True).alias("is_current")))
        table.overwrite(cdc.scd2_merge(table.read(), source, ["k"], run_ts=F.lit(wave)))
    want = []
    for k in {x[0] for x in log}:
        points = []
        for _, v, w in sorted((x for x in log if x[0] == k), key=lambda x: x[2]):
            if not points or points[-1][0] != v:
                points.append((v, w))
        for i, (v, w) in enumerate(points):
            end = points[i + 1][1] if i + 1 < len(points) else None
            want.append((k, v, w, end, end is None))
    assert rows(table.read().select("k", "v", "valid_from", "valid_to", "is_current")) == sorted(want, key=str)
    assert quality.duplicate_keys(table.read(), ["k"], F.col("is_current")).isEmpty()


def test_merge_rewrites_touched_buckets_only(spark):
    table = Table(spark, storage.scratch(spark, "t"), "b", ("k",), 16)
    rows_of = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v string").withColumn("_record_hash", row_hash(["k", "v"])).withColumn("created", F.lit(v))
    step = lambda t, s: cdc.scd1_merge(t, s, ["k"], keep=("created",))
    table.overwrite(rows_of(range(200), "a"))
    before = table.manifest()
    table.merge(rows_of([3, 500], "b"), step)
    after = table.manifest()
    assert 1 <= sum(before.get(b) != after[b] for b in after) <= 2
    got = {r["k"]: (r["v"], r["created"]) for r in table.read().collect()}
    assert len(got) == 201 and got[3] == ("b", "a") and got[500] == ("b", "b") and got[4] == ("a", "a")
    table.merge(rows_of([3], "c").withColumn("lang", F.lit("en")), step)
    assert {r["k"]: r["lang"] for r in table.read().collect()}[3] == "en" and table.read().count() == 201
    with pytest.raises(ValueError):
        table.append(rows_of([1], "x"))


def test_classify(spark):
    history = spark.createDataFrame([("a", "h1", True), ("b", "h1", True), ("c", "h1", False)], "k string, _record_hash string, is_current boolean")
    source = spark.createDataFrame([("a", "h2"), ("b", "h1"), ("c", "h1")], "k string, _record_hash string")
    assert rows(cdc.classify_changes(history, source, ["k"]).select("k", "change")) == [("a", "changed"), ("b", "unchanged"), ("c", "new")]


def test_tables_and_contracts(spark):
    table = Table(spark, storage.scratch(spark, "t"), "x")
    assert not table.exists()
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    table.overwrite(df)
    with pytest.raises(contract.ContractError):
        table.append(df.withColumn("extra", F.lit(1)))
    assert rows(table.read()) == [(1, "a")]
    table.append(spark.createDataFrame([(2, "b", 7)], "id int, name string, extra int"), evolve=True)
    assert rows(table.read()) == [(1, "a", None), (2, "b", 7)]
    with pytest.raises(contract.ContractError):
        table.append(spark.createDataFrame([("2", "b")], "id string, name string"), evolve=True)
    table.overwrite(contract.widen_column(table.read(), "id", "bigint"))
    table.overwrite(contract.drop_column(contract.rename_column(table.read(), "name", "title"), "extra"))
    assert table.read().dtypes == [("id", "bigint"), ("title", "string")] and table.row_count() == 2
    with pytest.raises(contract.ContractError):
        contract.widen_column(table.read(), "title", "int")
    spark.sql(f"SELECT * FROM {table.view('x_view')} LIMIT 10").collect()
    assert spark.sql("SELECT COUNT(*) AS c FROM x_view").first()["c"] == 2
    drop_all([table], False)
    assert table.exists()
    drop_all([table], True)
    assert not table.exists()


def test_contract_object(spark):
    c = contract.Contract(StructType.fromDDL("id int, name string"), required=("id",), approved=("lang",))
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id int, name string")
    c.check(df.withColumn("lang", F.lit("en")))
    with pytest.raises(contract.ContractError):
        c.check(df.withColumn("other", F.lit("en")))
    with pytest.raises(contract.ContractError):
        c.check(df.drop("id"))
    assert c.violations(df).first()["id"] == 1


def test_change_batches_to_silver(spark):
    titles = [(f"s{i}", "Movie", f"T{i}", None, "", "United States" if i % 2 else "X", "July 1, 2020", "2001", "R", "90 min", "Drama", "d") for i in range(1, 161)]
    names = "show_id type title director cast country date_added release_year rating duration listed_in description".split()
    raw = bronze.bronze_columns(spark.createDataFrame(titles, ", ".join(f"{c} string" for c in names)), names)
    first = bronze.stamp_batch(raw, "batch_001_initial", 1, "test", names, now()).withColumn("_source_file", F.lit("f"))
    language = F.when(F.col("country") == "United States", "English").otherwise("Unknown")
    bad = {"show_id": F.lit(None).cast("string"), "type": F.lit("Documentary"), "title": F.lit(""), "release_year": F.lit("not_a_year")}
    b2, b3, b4 = make_change_batches(first, "show_id", [f"s{i}" for i in range(1, 161)], names, ("second", "third", "fourth"), {"rating": F.lit("PG"), "description": F.lit("new")}, bad, {"content_language": language})
    assert (b2.count(), b3.count(), b4.count()) == (103, 50, 1)
    table = Table(spark, storage.scratch(spark, "b"), "bronze").overwrite(first).append(b2).append(b3, evolve=True).append(b4)
    assert table.row_count() == 160 + 154
    updates, quarantine = Table(spark, table.root, "updates"), Table(spark, table.root, "quarantine")
    silver.publish_updates(table.read(), updates, quarantine, now(), F.lit("2024-01-01").cast("date"))
    up = {r["show_id"]: r for r in updates.read().collect()}
    assert len(up) == 160 and up["s1"]["rating"] == "PG" and up["s101"]["content_language"] in ("English", "Unknown") and up["s1"]["duration_value"] == 90
    assert quarantine.read().first()["_quality_errors"].count(";") == 3 and quarantine.row_count() == 1
    assert set(quality.quality_report(updates.read(), silver.title_report(F.lit("2024-01-01").cast("date"))).first()) == {0}


def test_audit(spark):
    df = spark.createDataFrame([("d/a.csv", 1), ("d/a.csv", 3), ("e/a.csv", 2)], "_source_file string, _ingested_at int")
    assert rows(audit.file_audit(df)) == [("d/a.csv", 2, 1, 3), ("e/a.csv", 1, 2, 2)]
    assert rows(audit.file_audit(df, by_name=True)) == [("a.csv", 3, 1, 3)]
    dim = spark.createDataFrame([("x", "X")], "k string, name string")
    assert rows(audit.enrich(spark.createDataFrame([("x",), ("y",), (None,)], "k string"), dim, ["k"])) == sorted([("x", "X"), ("y", None), (None, None)], key=str)


def test_compact(spark):
    path = storage.scratch(spark, "c")
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    layout.compact(df.repartition(9), ["k", "id"], 3).write.parquet(path)
    back = spark.read.parquet(path)
    assert back.count() == 1000 and layout.table_summary(back).first()["num_files"] == 3


def test_file_ranges(spark):
    path = storage.scratch(spark, "r")
    values = [(None, 5), ("a", None), ("a", 9), ("b", 1), ("b", None), ("b", -3), ("c", 2), ("c", 2), (None, None), ("", 0), ("a", None), ("a", None)]
    spark.createDataFrame([(a, b, k % 6) for k, (a, b) in enumerate(values)], "a string, `b.c` int, f int").repartition(5, "f").write.partitionBy("f").parquet(path)
    back = spark.read.parquet(path)
    key = F.struct(F.col("a"), F.col("`b.c`"))
    plain = back.select(F.col("_metadata.file_path").alias("file"), key.alias("key")).groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    assert rows(layout.file_ranges(back, ["a", "b.c"])) == rows(plain) and plain.count() == 6
    numbers = back.select("*", F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.min("f").alias("low"), F.max("f").alias("high"))
    assert rows(layout.file_ranges(back, ["f"]).select("file", "low.last", "high.last")) == rows(numbers)


def test_quantile_ranks_and_z_order(spark):
    values = [None, -5, 0, 3, 3, 7, 8, 9, 100]
    df = spark.createDataFrame([(v, str(v), k) for k, v in enumerate(values)], "a int, b string, c int")
    cuts = [0, 3, 8]
    ranked = df.select("a", layout.quantile_rank(F.col("a"), cuts, bits=2).alias("r")).collect()
    assert all(r["r"] == (bisect.bisect_right(cuts, r["a"]) if r["a"] is not None else 0) for r in ranked)
    assert spark.range(1).select(layout.z_value([F.lit(0b101), F.lit(0b011)], bits=3).alias("z")).first()["z"] == 0b100111
    big = spark.range(4000).select((F.col("id") % 61).alias("a"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 1000).cast("string")).alias("b"), F.lit("mine").alias("own_z"), "id")
    path = storage.scratch(spark, "z")
    layout.cluster(big, ["a", "b"], 16).write.parquet(path)
    back = spark.read.parquet(path)
    assert rows(back) == rows(big)
    assert layout.files_for(back, (F.col("a_low") <= 5) & (F.col("a_high") >= 5), ["a"]).first()["needed"] <= 8
    assert layout.files_for(back, (F.col("b_low") <= "500") & (F.col("b_high") >= "500"), ["b"]).first()["needed"] <= 8
    assert layout.cluster(big.limit(0), ["a"], 3).count() == 0
    with pytest.raises(ValueError):
        layout.cluster(big, [], 3)


def test_small_files_are_packed_and_others_stay(spark):
    table = Table(spark, storage.scratch(spark, "t"), "p").overwrite(spark.range(0, 50_000, 1, 1))
    large = storage.file_sizes(spark, f"{table.path}/{table.commit()['folders'][0]}")
    for k in range(4):
        table.append(spark.range(50_000 + k, 50_010 + k, 1, 2))
    before = rows(table.read())
    size = max(large.values())
    assert layout.compact_small(table, size)["rewritten"] == 8
    assert rows(table.read()) == before
    assert next(iter(large)) in {x.rsplit("/", 1)[1] for x in table.read().inputFiles()}  # the large file stays, in its place
    assert layout.compact_small(table, size) == {"rewritten": 0, "bytes": 0, "written": 0, "kept": 2}  # one small file alone is left
    table.append(spark.range(5).coalesce(1))
    assert layout.compact_small(table, size)["rewritten"] == 2 and table.row_count() == len(before) + 5


def test_places_tell_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit(1).alias("own_at")).repartition(5)
    assert rows(audit.with_position(df.orderBy("k"), "place").select("place", "k")) == sorted(enumerate(sorted(r["k"] for r in df.collect()), 1), key=str)
    assert audit.with_position(df.limit(0).orderBy("k"), "place").count() == 0


def test_places_come_from_one_run_of_the_sort(spark):
    df = spark.range(0, 1_000_000, 1, 4).select((F.col("id") * 7919 % 1_000_000).alias("k"))  # several partitions, and more rows than a sort samples for its ranges
    placed = audit.with_position(df.orderBy("k"), "place")
    assert placed.where("place <> k + 1").isEmpty() and placed.count() == 1_000_000
