"""Publications: nothing is seen by half, nothing doubled, and merges read and write what they must."""

import contextlib
import io
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sedimenta.functions.scalars import row_hash
from sedimenta.operators import cdc
from sedimenta.sources import storage
from sedimenta.sources.tables import ConcurrentWrite, Table


def table_of(spark, **how):
    return Table(spark, storage.scratch(spark, "t"), "x", **how)


def keyed(spark, keys, value):
    return spark.createDataFrame([(k, value) for k in keys], "k long, v string").withColumn("_record_hash", row_hash(["k", "v"]))


def upsert(target, source):
    return cdc.scd1_merge(target, source, ["k"], checked=True)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def history(spark, **how):
    table = table_of(spark, keys=("k",), buckets=4, current="is_current", **how)
    first = keyed(spark, range(100), "a")
    table.create_like(first.select("*", F.lit(0).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), F.lit(True).alias("is_current")))
    return table, lambda t: lambda target, source: cdc.scd2_step(target, source, ["k"], run_ts=F.lit(t), checked=True)


def test_a_merge_of_history_reads_and_writes_no_closed_row(spark):
    table, step = history(spark)
    for t, (keys, v) in enumerate([(range(100), "a"), (range(60), "b"), (range(30), "c")], 1):
        before = table.commit()
        table.merge(keyed(spark, keys, v), step(t))
        after = table.commit()
        assert after["folders"][: len(before["folders"])] == before["folders"]  # closed versions are appended to
        assert after["counts"]["rows"] == {1: 100, 2: 160, 3: 130}[t]  # current rows, and those closed now
    assert rows(table.read().groupBy("is_current").count()) == [(False, 90), (True, 100)] and table.current_rows().count() == 100
    assert len(table.commit()["folders"]) == 2
    text = plan(table.merged(keyed(spark, range(5), "d"), step(4)))
    assert "_closed=true" not in text and len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 2 and "REBALANCE" not in text and "Union" not in text


def test_history_with_an_index_and_pieces(spark):
    plain, step = history(spark)
    indexed, _ = history(spark, index_bits=16)
    for t, (keys, v) in enumerate([(range(100), "a"), (range(200, 260), "a"), (range(10), "b"), ([3, 205, 400], "c"), (range(300), "d")], 1):
        for table in (plain, indexed):
            table.merge(keyed(spark, keys, v), step(t))
    assert rows(plain.read()) == rows(indexed.read()) and plain.read().count() == 300 + 160 + 10 + 2 + 1 - 0


def test_only_pieces_that_may_hold_a_key_are_read(spark):
    table = table_of(spark, keys=("k",), buckets=4, index_bits=16)
    table.overwrite(keyed(spark, range(0, 400, 2), "a"))
    table.merge(keyed(spark, range(1, 400, 2), "b"), upsert)  # all new: nothing is read
    assert table.commit()["merge"]["read"] == [] and {len(x) for x in table.manifest().values()} == {2}
    odd = {x for x in table.commit()["merge"]["written"]}
    table.merge(keyed(spark, [1, 3, 5, 7, 9, 11, 13, 15], "c"), upsert)
    assert set(table.commit()["merge"]["read"]) <= odd and table.commit()["merge"]["read"]
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 400 and got[15] == "c" and got[17] == "b" and got[16] == "a"
    for n in range(12):
        table.merge(keyed(spark, [1000 + n], "n"), upsert)
    assert max(map(len, table.manifest().values())) <= 9 and table.row_count() == 412
    with pytest.raises(ValueError):
        table.merge(keyed(spark, [1, 1], "x"), upsert)
    assert table.row_count() == 412


@pytest.mark.parametrize("current", [None, "is_current"])
def test_pieces_whose_index_is_full_are_read_only_if_they_hold_a_key(spark, current):
    table = table_of(spark, keys=("k", "v"), buckets=2, index_bits=6, current=current)  # 64 bits, all set by the keys of each piece
    of = lambda keys: keyed(spark, keys, "a").withColumn("is_current", F.lit(True))
    step = lambda target, source: cdc.scd1_merge(target, source, ["k", "v"], checked=True)
    table.overwrite(of([*range(0, 400, 2), None]))
    table.merge(of(range(1, 400, 2)), step)  # all new
    assert table.commit()["merge"]["read"] == [] and {len(x) for x in table.manifest().values()} == {2}
    odd = set(table.commit()["merge"]["written"])
    table.merge(of(range(1, 200, 2)), step)
    assert set(table.commit()["merge"]["read"]) == odd and table.row_count() == 401
    assert table.read().groupBy("k").count().where("count > 1").isEmpty()


def test_null_keys_and_empty_sources(spark):
    table = table_of(spark, keys=("k",), buckets=3, index_bits=10)
    table.overwrite(keyed(spark, [1, None], "a"))
    table.merge(keyed(spark, [2], "b").limit(0), upsert)
    assert table.row_count() == 2
    table.merge(keyed(spark, [None, 5], "b"), upsert)  # a null key matches nothing, as in any join
    assert rows(table.read().select("k", "v")) == sorted([(1, "a"), (None, "a"), (None, "b"), (5, "b")], key=str)


def test_an_append_that_dies_shows_nothing_and_one_tried_again_doubles_nothing(spark, monkeypatch):
    table = table_of(spark).overwrite(spark.createDataFrame([(1, "a")], "id int, name string"))
    wider = spark.createDataFrame([(2, "b", 7)], "id int, name string, extra int")
    with monkeypatch.context() as m:
        m.setattr(storage, "publish_text", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            table.append(wider, evolve=True, writer=("loader", 1))
    assert rows(table.read()) == [(1, "a")] and table.schema().names == ["id", "name"]
    for _ in range(3):
        table.append(wider, evolve=True, writer=("loader", 1))
    assert rows(table.read()) == [(1, "a", None), (2, "b", 7)]
    table.append(spark.createDataFrame([(3, "c")], "id int, name string"), writer=("loader", 2)).append(spark.createDataFrame([(4, "d")], "id int, name string"), writer=("other", 1))
    assert table.row_count() == 4 and table.commit()["writers"] == {"loader": 2, "other": 1}


def test_two_writers(spark, monkeypatch):
    table = table_of(spark).overwrite(spark.createDataFrame([(1,)], "id int"))
    real, meanwhile = Table._write, []

    def slow(self, df, counters=None):
        out = real(self, df, counters)
        if not meanwhile:
            meanwhile.append(1)
            self.append(spark.createDataFrame([(2,)], "id int"))
        return out

    monkeypatch.setattr(Table, "_write", slow)
    table.append(spark.createDataFrame([(3,)], "id int"))  # appends follow one another
    assert rows(table.read()) == [(1,), (2,), (3,)]
    merged = table_of(spark, keys=("k",), buckets=2).overwrite(keyed(spark, [1, 2], "a"))

    def other(self, df, counters=None):
        out = real(self, df, counters)
        monkeypatch.setattr(Table, "_write", real)
        merged.merge(keyed(spark, [1], "other"), upsert)
        return out

    monkeypatch.setattr(Table, "_write", other)
    with pytest.raises(ConcurrentWrite):
        merged.merge(keyed(spark, [1], "mine"), upsert)
    assert {r["v"] for r in merged.read().collect()} == {"a", "other"}


def test_counters_come_with_the_write(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, name string")
    table = table_of(spark).overwrite(df, counters={"bad": F.count_if(F.col("name").isNull())})
    assert table.counts() == {"rows": 2, "bad": 1}
    assert table.overwrite(df.limit(0), counters={"bad": F.count_if(F.col("name").isNull())}).counts() == {"rows": 0, "bad": 0}


def test_merge_sources_leave_no_copy(spark):
    table = table_of(spark, keys=("k",), buckets=2).overwrite(keyed(spark, [1, 2], "a"))
    base = storage.scratch(spark, "x").rsplit("/", 1)[0]
    before = storage.children(spark, base)
    table.merge(keyed(spark, [1], "b"), upsert)
    assert [x for x in storage.children(spark, base) if x.startswith("merge-source") and x not in before] == []


def test_null_hashes_mean_the_same_everywhere(spark):
    ddl = "k string, v string, _record_hash string"
    old = spark.createDataFrame([("a", "old", None), ("b", "old", "h"), ("c", "old", None)], ddl)
    new = spark.createDataFrame([("a", "new", None), ("b", "new", None), ("c", "new", "h"), ("d", "new", None)], ddl)
    stamped = old.select("*", F.lit(0).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), F.lit(True).alias("is_current"))
    told = {r["k"]: r["change"] for r in cdc.classify_changes(stamped, new, ["k"]).collect()}
    assert told == {"a": "unchanged", "b": "changed", "c": "changed", "d": "new"}
    assert rows(cdc.scd1_merge(old, new, ["k"]).select("k", "v")) == [("a", "old"), ("b", "new"), ("c", "new"), ("d", "new")]
    got = cdc.scd2_merge(stamped, new, ["k"], run_ts=F.lit(1))
    assert rows(got.where("is_current").select("k", "v")) == [("a", "old"), ("b", "new"), ("c", "new"), ("d", "new")] and got.count() == 6


def test_columns_named_like_our_own_stay(spark):
    df = spark.createDataFrame([("a", 1, "x", "y"), ("a", 2, "z", "w")], "k string, at int, __row string, own_row string")
    assert rows(cdc.latest_per_key(df, ["k"], ["at"])) == [("a", 2, "z", "w")]
    current = spark.createDataFrame([("a", "h", True, "q")], "k string, _record_hash string, is_current boolean, own_hash string")
    source = spark.createDataFrame([("a", "h", "p", "r")], "k string, _record_hash string, own_held string, __hash string")
    assert rows(cdc.classify_changes(current, source, ["k"])) == [("a", "h", "p", "r", "unchanged")]
