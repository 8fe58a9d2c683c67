import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sedimenta.sources import files, storage
from sedimenta.streaming import ingest, messages

SCHEMA = StructType([StructField("a", StringType()), StructField("b", IntegerType())])


def drop(spark, folder, name, data, ddl):
    return files.drop_csv(spark.createDataFrame(data, ddl), folder, name)


def setup(spark):
    folder = storage.scratch(spark, "landing")
    for i in range(5):
        drop(spark, folder, f"f{i}.csv", [(f"x{i}", i), ("line\nbreak", None)], "a string, b int")
    return folder, ingest.Pipeline(storage.scratch(spark, "state"), "p")


def test_rerun_adds_nothing_and_new_files_add_their_rows(spark):
    folder, p = setup(spark)
    q = ingest.ingest_files(spark, folder, p, schema=SCHEMA, max_files=2)
    assert len(ingest.progress(q)) >= 3
    ingest.ingest_files(spark, folder, p, schema=SCHEMA, max_files=2)
    got = ingest.read_ingested(spark, p, SCHEMA)
    assert got.count() == 10 and ingest.batch_stats(spark, p).count() == 3
    drop(spark, folder, "late.csv", [(7, "late")], "b int, a string")  # another order of columns
    ingest.ingest_files(spark, folder, p, schema=SCHEMA)
    assert rows(ingest.read_ingested(spark, p, SCHEMA).where("a = 'late'").select("a", "b")) == [("late", 7)]
    assert got.where("a = 'line\nbreak'").count() == 5


def test_once_ignores_the_limit(spark):
    folder, p = setup(spark)
    ingest.ingest_files(spark, folder, p, schema=SCHEMA, max_files=2, trigger="once")
    assert ingest.batch_stats(spark, p).count() == 1


def test_reload(spark):
    folder, p = setup(spark)
    ingest.ingest_files(spark, folder, p, schema=SCHEMA)
    ingest.reset(spark, p, table=False)
    ingest.ingest_files(spark, folder, p, schema=SCHEMA)
    assert ingest.read_ingested(spark, p, SCHEMA).count() == 20
    ingest.safe_reload(spark, folder, p, schema=SCHEMA)
    assert ingest.read_ingested(spark, p, SCHEMA).count() == 10


def test_evolution_fails_once_then_takes_the_column_in(spark):
    folder, p = setup(spark)
    ingest.ingest_files(spark, folder, p, mode="add_new_columns", rescued=True)
    drop(spark, folder, "wide.csv", [("w", "87.5", 1)], "a string, score string, b int")
    with pytest.raises(ingest.SchemaChanged):
        ingest.ingest_files(spark, folder, p, mode="add_new_columns", rescued=True)
    ingest.ingest_files(spark, folder, p, mode="add_new_columns", rescued=True)
    got = ingest.read_ingested(spark, p, rescued=True)
    assert got.count() == 11
    r = got.where("a = 'w'").first()
    assert (r["score"], r["b"], r["_rescued_data"]) == ("87.5", "1", None)


def test_rescue(spark):
    folder, p = setup(spark)
    drop(spark, folder, "wide.csv", [("w", "87.5", 1)], "a string, score string, b int")
    ingest.ingest_files(spark, folder, p, schema=SCHEMA, rescued=True)
    got = ingest.read_ingested(spark, p, SCHEMA, rescued=True).where("_rescued_data IS NOT NULL")
    assert [json.loads(r["_rescued_data"]) for r in got.collect()] == [{"score": "87.5"}]


def test_first_available(spark):
    folder, _ = setup(spark)
    empty = storage.scratch(spark, "none")
    assert files.read_first_available(spark, [empty, f"{folder}/f0.csv"]).count() == 2
    with pytest.raises(Exception):
        files.read_first_available(spark, [empty])


def test_shows(spark):
    path = storage.scratch(spark, "json")
    spark.createDataFrame([('{"id":1,"name":"n","rating":{"average":8},"genres":["A","B"]}',), ('{"id":2,"rating":{"average":null}}',), ('{"id":3}',)], "value string").coalesce(1).write.text(path)
    got = spark.read.schema(files.SHOW_SCHEMA).json(path)
    assert rows(files.flatten_shows(got).select("tvmaze_id", "rating", "genres")) == [(1, 8.0, "A, B"), (2, None, ""), (3, None, "")]


def test_keep_edits(spark):
    cases = {'{"type":"edit"}': True, '{"type":"edit","meta":{"domain":"x"}}': True, '{"type":"edit","meta":{"domain":"canary"}}': False, '{"type":"log"}': False, "[1]": False, "{": False, '{"type":"edit","meta":null}': False, '{"type":"edit","meta":3}': False, None: False, '"edit"': False}
    df = spark.createDataFrame([(k,) for k in cases], "event_json string")
    assert {r[0] for r in messages.keep_edits(df).collect()} == {k for k, v in cases.items() if v}


def test_messages_restart(spark):
    landed, out = storage.scratch(spark, "m"), storage.scratch(spark, "o")
    row = spark.createDataFrame([(bytearray(b"k"), bytearray(b"{}"), "t", 0, 1)], "key binary, value binary, topic string, partition int, offset bigint").select("*", F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"))
    row.write.parquet(landed)
    for _ in range(2):
        messages.stream_to_table(messages.decode_messages(spark.readStream.schema(messages.MESSAGE_SCHEMA).parquet(landed)), f"{out}/t", f"{out}/c")
    got = messages.read_stream_table(spark, f"{out}/t", "event_json string, kafka_topic string, kafka_offset bigint")
    assert rows(got) == [("{}", "t", 1)]
    assert messages.kafka_options("h:1", "t")["startingOffsets"] == "earliest"


def test_appended_streams_merge_their_schemas(spark):
    landed, out = storage.scratch(spark, "rows"), storage.scratch(spark, "out")
    with pytest.raises(LookupError):
        messages.read_stream_table(spark, f"{out}/t")
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(landed)
    messages.stream_to_table(spark.readStream.schema("a int, b string").parquet(landed), f"{out}/t", f"{out}/c")
    spark.createDataFrame([(2, 3.5)], "a int, c double").write.mode("append").parquet(landed)
    messages.stream_to_table(spark.readStream.schema("a int, c double").parquet(landed), f"{out}/t", f"{out}/c")
    got = messages.read_stream_table(spark, f"{out}/t")
    assert got.columns == ["a", "b", "c"] and rows(got) == [(1, "x", None), (2, None, 3.5)]
    assert rows(messages.read_stream_table(spark, f"{out}/t", "a int")) == [(1,), (2,)]
    spark.createDataFrame([(3, 1)], "a int, b int").write.mode("append").parquet(landed)
    with pytest.raises(Exception, match="changed types"):
        messages.stream_to_table(spark.readStream.schema("a int, b int").parquet(landed), f"{out}/t", f"{out}/c")
    assert messages.read_stream_table(spark, f"{out}/t").count() == 2


def raw(spark, folder, name, text):
    fs, target = storage._fs(spark, f"{folder}/{name}")
    out = fs.create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def test_rows_that_do_not_fit_their_header_are_rescued(spark):
    folder, p = storage.scratch(spark, "landing"), ingest.Pipeline(storage.scratch(spark, "state"), "p")
    raw(spark, folder, "a.csv", 'a,b\nx,1\ny,2,lost\nz\n"w,3\n')
    ingest.ingest_files(spark, folder, p, schema=SCHEMA, rescued=True, multiLine=False)
    got = {r["a"]: (r["b"], r["_rescued_data"] and json.loads(r["_rescued_data"])) for r in ingest.read_ingested(spark, p, SCHEMA, rescued=True).collect()}
    assert got == {"x": (1, None), "y": (2, {"_corrupt_record": "y,2,lost"}), "z": (None, {"_corrupt_record": "z"}), "w,3": (None, {"_corrupt_record": '"w,3'})}


def test_files_that_cannot_be_aligned_are_set_aside_and_stop_nothing(spark):
    folder, p = setup(spark)
    bad = {"twice.csv": "a,b,a\n1,2,3\n", "case.csv": "a,A\n1,2\n", "own.csv": "a,_load_date\n1,2\n", "blank.csv": "a,,b\n1,2,3\n", "lines.csv": 'a,"b\nc"\n1,2\n'}
    for name, text in bad.items():
        raw(spark, folder, name, text)
    raw(spark, folder, "none.csv", "\n\n")
    raw(spark, folder, "odd name %20 [1].csv", "\n\nB,A\n5,five\n")
    for _ in range(2):
        ingest.ingest_files(spark, folder, p, mode="add_new_columns")
    aside = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in ingest.read_quarantine(spark, p).collect()}
    assert aside == {"twice.csv": "the header repeats a", "case.csv": "the header repeats a", "own.csv": "reserved names: _load_date", "blank.csv": "a column has no name", "lines.csv": "the header spans lines"}
    assert sorted(c.lower() for c in ingest.logged_columns(spark, p)) == ["a", "b"] and ingest.read_ingested(spark, p).count() == 11
    assert ingest.batch_stats(spark, p).agg(F.sum("num_quarantined")).first()[0] == 5
    other = ingest.Pipeline(storage.scratch(spark, "state"), "only")
    assert ingest.read_quarantine(spark, other).count() == ingest.batch_stats(spark, other).count() == ingest.read_progress(spark, other).count() == 0


def test_headers_come_from_the_beginnings_of_files(spark, monkeypatch):
    folder = storage.scratch(spark, "landing")
    raw(spark, folder, "long.csv", "\r\n" + ",".join(f"c{i}" for i in range(40_000)) + "\r\nrest\n")
    raw(spark, folder, "bom.csv", "﻿a,b\n1,2\n")
    raw(spark, folder, "empty.csv", "")
    paths = [f"{folder}/{x}" for x in ("long.csv", "bom.csv", "empty.csv")]
    groups, bad = ingest.headers(spark, paths)
    assert sorted(map(len, groups)) == [2, 40_000] and bad == [] and ("a", "b") in groups
    monkeypatch.setattr(ingest, "OPENED", ())  # where only Spark can open the store
    assert ingest.headers(spark, [x for x in paths])[0].keys() == groups.keys()


def test_a_batch_scans_its_files_once(spark, monkeypatch):
    folder, p = setup(spark)
    scans = []
    real = ingest.aligned
    monkeypatch.setattr(ingest, "aligned", lambda rows, *a: scans.append(rows) or real(rows, *a))
    assert "FileScan" not in ingest.first_lines(spark, [f"{folder}/f0.csv"])._jdf.queryExecution().toString()
    ingest.ingest_files(spark, folder, p, schema=SCHEMA)
    assert len(scans) == 1


def test_large_batches_go_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ingest, "CHUNK", 2)
    folder, p = setup(spark)
    ingest.ingest_files(spark, folder, p, schema=SCHEMA, trigger="once")
    assert ingest.read_ingested(spark, p, SCHEMA).count() == 10
    assert rows(ingest.batch_stats(spark, p)) == [(0, 10, 5, 0)]


def test_progress_outlives_the_session(spark):
    folder, p = setup(spark)
    session = spark.newSession()
    with ingest.logged_progress(session, p):
        ingest.ingest_files(session, folder, p, schema=SCHEMA, max_files=2)
    ingest.ingest_files(session, folder, p, schema=SCHEMA, max_files=2)  # not logged
    seen = ingest.read_progress(spark, p).where("num_input_rows > 0")
    assert rows(seen.select("batch_id", "num_input_rows")) == [(0, 2), (1, 2), (2, 1)] and seen.where("duration_ms > 0").count() == 3
    assert seen.select("run_id").distinct().count() == 1


def test_events_are_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "event_json string")
    optimized = messages.keep_edits(df)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.lower().count("parse_json") + optimized.count("parseJson") == 1
