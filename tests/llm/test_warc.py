import gzip
import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import warc as W

PAGES = "page_id long, url string, html string"


def test_round_trip_with_revisits(spark):
    big, other = "é<p>" * 400, "q" * 1000
    pages = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u\r\nX-Page-Id: 9", other), (None, "n", big)]
    df = spark.createDataFrame(pages, PAGES).select("*", F.lit(1).alias("sha"), F.lit(2).alias("refers_to"), F.lit(3).alias("size")).repartition(3)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.digest(df).collect()), key=str)
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = [(p, len((h or "").encode()), sha(h), "revisit" if p in (1, 3) else "response", 5 if p in (1, 3) else None) for p, _, h in pages]
    assert got == sorted(want, key=str)
    assert W.digest(df.limit(0)).collect() == []


def test_archives_roll_over(spark):
    df = spark.createDataFrame([(i, "u", f"{random.Random(i).random()}" * 100, None) for i in range(30)], f"{PAGES}, refers_to long").coalesce(1)
    manifest = W.write_archives(df, archive_bytes=2000)
    assert manifest.count() > 3
    got = W.read_archives(manifest).where("kind = 'record'")
    assert sorted(r[0] for r in got.select(F.col("headers")["x-page-id"].cast("long")).collect()) == list(range(30))


def archive(n, zipped):
    raw = [W.record(f"payload {i} ".encode() * 30, f"http://x/{i}", i, None, "2020-01-01T00:00:00Z") for i in range(n)]
    return [gzip.compress(r, mtime=0) if zipped else r for r in raw]


def read(data):
    out = list(W.records(io.BytesIO(data)))
    return [int(x.headers["x-page-id"]) for x in out if x.kind == "record"], [(x.start, x.stop) for x in out if x.kind == "gap"]


def test_salvage():
    r = random.Random(1)
    for zipped in (True, False):
        parts = archive(12, zipped)
        whole = b"".join(parts)
        assert read(whole) == (list(range(12)), [])
        starts = [sum(map(len, parts[:i])) for i in range(13)]
        for bad in (0, 5, 11):
            for how in ("flip", "cut", "junk"):
                p = bytearray(parts[bad])
                at = r.randrange(len(p) // 3, 2 * len(p) // 3) if zipped else r.randrange(len(p) - 250, len(p) - 30)  # in the block, which has a digest
                if how == "flip":
                    p[at] ^= 0x55
                elif how == "cut":
                    del p[at : at + 9]
                else:
                    p[at:at] = b"\x1f\x8b\x08 junk WARC/1.0\r\n junk"
                ids, gaps = read(b"".join([*parts[:bad], bytes(p), *parts[bad + 1 :]]))
                assert ids == [i for i in range(12) if i != bad], (zipped, bad, how)
                assert gaps == [(starts[bad], starts[bad] + len(p))], (zipped, bad, how)
        ids, gaps = read(whole[:-10])
        assert ids == list(range(11)) and gaps == [(starts[11], len(whole) - 10)]
    assert read(b"") == ([], []) and read(b"nothing here") == ([], [(0, 12)])


def test_chunks_smaller_than_records(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 7)
    for zipped in (True, False):
        parts = archive(4, zipped)
        parts[1] = parts[1][:50]
        assert read(b"".join(parts))[0] == [0, 2, 3]


def test_too_large_is_quarantined():
    parts = archive(3, True)
    assert [x.kind for x in W.records(io.BytesIO(b"".join(parts)), most=100)] == ["gap"]


def test_salvage_inside_a_shared_member():
    raw = [bytearray(x) for x in archive(5, False)]
    raw[2][raw[2].index(b"payload 2") + 40] ^= 1
    out = list(W.records(io.BytesIO(gzip.compress(b"".join(raw), mtime=0) + archive(1, True)[0])))
    assert [int(x.headers["x-page-id"]) for x in out if x.kind == "record"] == [0, 1, 3, 4, 0]
    (gap,) = [x for x in out if x.kind == "gap"]
    assert gap.inner == (len(raw[0]) + len(raw[1]), sum(map(len, raw[:3]))) and gap.start == 0


def test_salvage_of_a_damaged_shared_member():
    r = random.Random(5)
    raw = [W.record(r.randbytes(3000), f"http://x/{i}", i, None, "2020-01-01T00:00:00Z") for i in range(6)]
    data = bytearray(gzip.compress(b"".join(raw), mtime=0))
    size, tail = len(data), archive(2, True)
    data[len(data) * 2 // 3] ^= 0xFF
    out = list(W.records(io.BytesIO(bytes(data) + b"".join(tail))))
    ids = [int(x.headers["x-page-id"]) for x in out if x.kind == "record"]
    assert ids[:3] == [0, 1, 2] and ids[-2:] == [0, 1] and 3 <= len(ids) - 2 < 6
    assert all(x.reason for x in out[:3]) and [(x.start, x.stop) for x in out if x.kind == "gap"] == [(0, size)]
    cut = list(W.records(io.BytesIO(bytes(data[: len(data) // 2]))))
    assert [int(x.headers["x-page-id"]) for x in cut if x.kind == "record"][:2] == [0, 1] and cut[-1].kind == "gap"


def test_large_members_and_records(monkeypatch):
    big = W.record(b"x" * (3 << 20), "u", 7, None, "d")
    whole = gzip.compress(b"".join([*archive(3, False), big, *archive(2, False)]))
    for hold in (W.HOLD, 1000, 0):
        out = list(W.records(io.BytesIO(whole), hold=hold))
        assert [(x.kind, int(x.headers["x-page-id"])) for x in out] == [("record", i) for i in (0, 1, 2, 7, 0, 1)]
    long_head = b"WARC/1.1\r\nX-Long: " + b"h" * (2 << 20) + b"\r\nX-Page-Id: 3\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert read(long_head) == ([3], []) and read(gzip.compress(long_head)) == ([3], [])


def test_one_task_to_an_archive_and_a_log_of_gaps(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "u", f"{random.Random(i).random()}" * 100, None) for i in range(40)], f"{PAGES}, refers_to long").coalesce(1)
    with monkeypatch.context() as m:  # a folder without a scheme is on the file system that Spark would take
        m.setattr(W, "new_path", lambda spark, label: f"{tmp_path}/archives")
        manifest = W.write_archives(df, archive_bytes=2000)
    paths = [r["path"] for r in manifest.collect()]
    assert len(paths) > 3 and all(p.startswith("file:///") for p in paths)
    got = W.read_archives(manifest, expect_col="n_records")
    tasks = {r[0] for r in got.select(F.spark_partition_id()).collect()}
    assert len(tasks) == len(paths) and got.count() == 40
    first = paths[0].removeprefix("file://")
    data = bytearray(open(first, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(first, "wb").write(data)
    with pytest.raises(Exception, match="gaps"):
        W.read_archives(manifest, expect_col="n_records").collect()
    records, gaps = W.salvage(manifest, log=f"{tmp_path}/log")
    logged = spark.read.parquet(f"{tmp_path}/log").collect()
    assert records.count() == 39 and gaps.count() == len(logged) == 1 and logged[0]["path"] == paths[0] and logged[0]["reason"]


def test_record_ids_are_unique(spark):
    """Page ids that repeat, are null, or tie with equal payloads."""
    rows = [(1, "u", "a" * 2000), (1, "u", "b" * 2000), (1, "u", "a" * 2000), (None, "u", "c"), (None, "u", "c"), (2, "u", "a" * 2000), (3, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    ids = []
    for r in W.write_archives(W.with_revisits(df)).collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            ids += re.findall(rb"WARC-Record-ID: (\S+)", gzip.decompress(f.read()))
    assert len(ids) == len(rows) == len(set(ids))
    told = W.digest(df)
    assert told.count() == len(rows) and told.where("record_type = 'revisit'").select("page_id", "refers_to").distinct().collect() == [(1, 2)]
