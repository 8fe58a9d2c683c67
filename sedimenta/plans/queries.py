"""The registered queries, over the driver's tables.

Orders act as a change log of customers: key ``o_custkey``, one wave for each
year of ``o_orderdate``. Order status ``P`` plays the bad value in gates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, bronze, cdc, contract, layout, quality
from ..sources import files, storage
from ..sources.tables import Table, drop_all
from ..streaming import ingest, messages
from . import silver
from .change_batches import make_change_batches


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_filter(spark, d):
    o = t(spark, d, "orders")
    return o.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 150000.0) & F.col("o_orderpriority").isNotNull()).select("o_orderkey", "o_custkey", "o_totalprice")


def count_by_type(spark, d):
    return audit.count_by(t(spark, d, "part"), "p_type").withColumnRenamed("count", "n")


def enrich_left(spark, d):
    names = spark.createDataFrame([("F", "finished"), ("O", "open")], "o_orderstatus string, status_name string")
    return audit.enrich(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), names, ["o_orderstatus"])


def _shows(spark, d):
    p = t(spark, d, "part")
    rating = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
    record = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("status"), F.struct(rating.alias("average")).alias("rating"), F.split("p_type", " ").alias("genres"))
    return p.select(F.to_json(record).alias("j")).select(F.from_json("j", files.SHOW_SCHEMA).alias("r")).select("r.*")


def flatten_nested(spark, d):
    return files.flatten_shows(_shows(spark, d))


def top_k(spark, d):
    p = t(spark, d, "part")
    return audit.top_rated(p, "p_retailprice", "p_partkey").limit(20).select("p_partkey", "p_name", "p_retailprice")


def _padded():
    k = F.col("p_partkey") % 4
    return F.when(k == 0, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).when(k == 1, F.lit("   ")).when(k == 2, F.lit(None)).otherwise(F.col("p_name"))


def clean_strings(spark, d):
    return t(spark, d, "part").select("p_partkey", _padded().alias("raw")).select("p_partkey", S.clean_string("raw").alias("name"))


def parse_dates(spark, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(F.lit(" "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" "))).when(k == 1, F.lit("")).when(k == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return t(spark, d, "orders").select("o_orderkey", S.parse_long_date(text).alias("added"))


def parse_duration(spark, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(n, F.lit(" min"))).when(k == 1, F.concat(n, F.lit(" Seasons"))).when(k == 2, F.concat(F.lit(" "), n, F.lit(" min"))).when(k == 3, n)
    raw, value, unit = S.parse_duration("duration")
    return t(spark, d, "part").select("p_partkey", text.alias("duration")).select("p_partkey", raw.alias("raw"), value.alias("value"), unit.alias("unit"))


def base_name_audit(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    path = storage.scratch(spark, "split")
    e.write.partitionBy("event_type").option("header", True).csv(path)
    read = files.read_csv(spark, path, "event_id long, at long", multiLine=False).select("event_id", "at", files.source_file().alias("_source_file"))
    per = audit.file_audit(read, ts="at")
    kind = F.regexp_extract("file", "event_type=([^/]+)/", 1)
    named = S.base_name("file").startswith("part-")
    return per.groupBy(kind.alias("event_type")).agg(F.sum("rows").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.bool_and(named).alias("named"))


def row_hash(spark, d):
    c = t(spark, d, "customer")
    segment = F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", S.row_hash(["c_custkey", "c_name", "c_nationkey", segment]).alias("hash"))


def ensure_columns(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return c.unionByName(bronze.ensure_columns(s, {"segment": "string"}))


def change_batches(spark, d):
    c = t(spark, d, "customer")
    raw = ["show_id", "title", "segment"]
    first = c.select(F.col("c_custkey").cast("string").alias("show_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))
    first = bronze.stamp_batch(first, "batch_001_initial", 1, "customers", raw, F.lit("2024-01-01 00:00:00").cast("timestamp")).drop("_ingested_at")
    language = F.when(F.col("segment") == "BUILDING", "English").otherwise("Unknown")
    names = ("batch_002_updates_duplicates", "batch_003_new_column", "batch_004_bad_quality_row")  # fixed values: the batches' names
    batches = make_change_batches(first, "show_id", [str(k) for k in range(1, 152)], raw, names, {"segment": F.lit("PG")}, {"show_id": F.lit(None).cast("string"), "title": F.lit("")}, {"content_language": language})
    out = first
    for b in batches:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def _cleaned(spark, d):
    o = t(spark, d, "orders")
    status = F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.col("o_orderstatus"))
    return o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("o_custkey"), S.clean_string(status).alias("status"), S.clean_string("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("year"), "o_orderdate",
    ).withColumn("_record_hash", S.row_hash(["o_custkey", "status", "priority", "year"]))


def _rules():
    as_of = F.lit("1999-06-30").cast("date")
    return [
        ("o_custkey is null", F.col("o_custkey").isNotNull()),
        ("status is not F or O", S.allowed("status", ["F", "O"])),
        ("year is outside accepted range", S.year_in_range("year", 1996, as_of)),
    ]


def gate_valid(spark, d):
    return quality.quality_gate(_cleaned(spark, d), _rules())[0].select("o_orderkey", "o_custkey", "status", "year")


def gate_quarantine(spark, d):
    return quality.quality_gate(_cleaned(spark, d), _rules())[1].select("o_orderkey", "_quality_errors")


def latest_per_key(spark, d):
    o = t(spark, d, "orders").withColumn("at", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")))
    return cdc.latest_per_key(o, ["o_custkey"], ["at", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def prepare_updates(spark, d):
    prepared, _ = silver.prepare_updates(_cleaned(spark, d), _rules(), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return prepared.select("o_custkey", "o_orderkey", "status", "priority", "year", "_record_hash")


def _waves(spark, d) -> list[tuple[int, DataFrame]]:
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("st"))
    latest = cdc.latest_per_key(o, ["o_custkey", "y"], ["o_orderdate", "o_orderkey"]).withColumn("_record_hash", S.row_hash(["o_custkey", "st"]))
    path = storage.scratch(spark, "waves")
    latest.select("o_custkey", "st", "_record_hash", "y").write.partitionBy("y").parquet(path)
    years = sorted(int(x.split("=")[1]) for x in storage.children(spark, path) if x.startswith("y="))  # a handful of waves
    return [(y, spark.read.schema("o_custkey bigint, st string, _record_hash string").parquet(f"{path}/y={y}")) for y in years]


def _start_of(year: int):
    return F.make_timestamp_ntz(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def _history(spark, waves) -> Table | None:
    table = Table(spark, storage.scratch(spark, "scd2"), "history", ("o_custkey",), 4, current="is_current")
    for y, wave in waves:
        if not table.exists():
            table.create_like(wave.select("*", _start_of(y).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current")))
        table.merge(wave, lambda target, source, y=y: cdc.scd2_step(target, source, ["o_custkey"], run_ts=_start_of(y), checked=True), stable=True)
    return table


def classify_changes(spark, d):
    waves = _waves(spark, d)
    _, last = waves[-1]
    current = _history(spark, waves[:-1]).current_rows()
    return cdc.classify_changes(current, last, ["o_custkey"]).select("o_custkey", "st", "change")


def scd1_state(spark, d):
    table = Table(spark, storage.scratch(spark, "scd1"), "curated", ("o_custkey",), 4)
    for y, wave in _waves(spark, d):
        wave = wave.withColumn("created", F.lit(y))
        table.create_like(wave)
        table.merge(wave, lambda target, source: cdc.scd1_merge(target, source, ["o_custkey"], keep=("created",), checked=True), stable=True)
    return table.read().select("o_custkey", "st", "created")


def scd2_history(spark, d):
    return _history(spark, _waves(spark, d)).read().select("o_custkey", "st", F.year("valid_from").alias("from_year"), F.year("valid_to").alias("to_year"), "is_current")


def duplicate_keys(spark, d):
    return quality.duplicate_keys(t(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "O").select("o_custkey", F.col("count").alias("n"))


def quality_report(spark, d):
    c = _cleaned(spark, d)
    as_of = F.lit("1999-06-30").cast("date")
    return quality.quality_report(c, {"invalid_key": F.col("o_custkey").isNull(), "invalid_status": ~S.allowed("status", ["F", "O"]), "invalid_year": ~S.year_in_range("year", 1996, as_of), "invalid_priority": F.col("priority").isNull()})


def _region_table(spark, d) -> tuple[Table, DataFrame]:
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return Table(spark, storage.scratch(spark, "contract"), "customers").overwrite(c), t(spark, d, "supplier")


def contract_reject(spark, d):
    table, s = _region_table(spark, d)
    rows = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.lit("x").alias("surprise"))
    try:
        table.append(rows)
    except contract.ContractError:
        pass
    return table.read()


def contract_evolve(spark, d):
    table, s = _region_table(spark, d)
    rows = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.lit("supplier").alias("kind"))
    return table.append(rows, evolve=True).read()


def widen_rename_drop(spark, d):
    table, _ = _region_table(spark, d)
    table.overwrite(contract.widen_column(table.read(), "c_nationkey", "bigint"))
    table.overwrite(contract.rename_column(table.read(), "c_nationkey", "nation"))
    table.overwrite(contract.drop_column(table.read(), "c_name"))
    return table.read()


EVENT_COLUMNS = ["event_id", "user_id", "event_type"]


def _event_files(spark, d, parts: int = 6) -> tuple[str, DataFrame]:
    folder = storage.scratch(spark, "landing")
    e = t(spark, d, "events").select(*[F.col(c).cast("string").alias(c) for c in EVENT_COLUMNS])
    files.split_to_files(e, folder, parts)
    return folder, e


def _ingest_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL("event_id long, user_id long, event_type string")


def ingest_stream(spark, d):
    folder, _ = _event_files(spark, d)
    p, schema = ingest.Pipeline(storage.scratch(spark, "ingest"), "fixed"), _ingest_schema()
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_files(spark, folder, p, schema=schema, max_files=4, multiLine=False)
    return ingest.read_ingested(spark, p, schema).select(*EVENT_COLUMNS)


def ingest_evolve(spark, d):
    folder, e = _event_files(spark, d)
    p = ingest.Pipeline(storage.scratch(spark, "ingest"), "evolve")
    ingest.ingest_files(spark, folder, p, mode="add_new_columns", multiLine=False)
    wider = e.where("event_type = 'error'").select("event_type", F.lit("high").alias("severity"), "event_id", "user_id")
    wider.write.mode("append").option("header", True).csv(folder)
    try:
        ingest.ingest_files(spark, folder, p, mode="add_new_columns", multiLine=False)
    except ingest.SchemaChanged:
        ingest.ingest_files(spark, folder, p, mode="add_new_columns", multiLine=False)
    return ingest.read_ingested(spark, p).select(*EVENT_COLUMNS, "severity")


def ingest_rescue(spark, d):
    folder, e = _event_files(spark, d)
    e.where("event_type = 'error'").select("event_id", F.lit("high").alias("severity"), "user_id", "event_type").write.mode("append").option("header", True).csv(folder)
    p, schema = ingest.Pipeline(storage.scratch(spark, "ingest"), "rescue"), _ingest_schema()
    ingest.ingest_files(spark, folder, p, schema=schema, rescued=True, multiLine=False)
    return ingest.read_ingested(spark, p, schema, rescued=True).select(*EVENT_COLUMNS, "_rescued_data")


def trigger_batches(spark, d):
    folder, _ = _event_files(spark, d)
    out = None
    for trigger in ("available_now", "once"):
        p = ingest.Pipeline(storage.scratch(spark, "ingest"), trigger)
        ingest.ingest_files(spark, folder, p, schema=_ingest_schema(), max_files=2, trigger=trigger, multiLine=False)
        stats = ingest.batch_stats(spark, p).agg(F.count(F.lit(1)).alias("batches"), F.sum("num_files").alias("files"), F.sum("num_input_rows").alias("rows")).select(F.lit(trigger).alias("trigger"), "*")
        out = stats if out is None else out.unionByName(stats)
    return out


def _reload(spark, d, safe: bool):
    folder, _ = _event_files(spark, d)
    p, schema = ingest.Pipeline(storage.scratch(spark, "ingest"), "reload"), _ingest_schema()
    ingest.ingest_files(spark, folder, p, schema=schema, multiLine=False)
    if safe:
        ingest.safe_reload(spark, folder, p, schema=schema, multiLine=False)
    else:
        ingest.reset(spark, p, table=False)
        ingest.ingest_files(spark, folder, p, schema=schema, multiLine=False)
    return ingest.read_ingested(spark, p, schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def unsafe_reload(spark, d):
    return _reload(spark, d, False)


def safe_reload(spark, d):
    return _reload(spark, d, True)


def _messages(spark, d):
    e = t(spark, d, "events")
    domain = F.when(F.col("user_id") % 10 == 0, "canary").otherwise("site")
    kind = F.when(F.col("event_type") == "purchase", "edit").otherwise(F.col("event_type"))
    body = F.to_json(F.struct(kind.alias("type"), F.struct(domain.alias("domain")).alias("meta"), F.col("event_id").alias("id")))
    text = F.when(F.col("event_id") % 17 == 0, F.lit('{"type": "edit", ')).when(F.col("event_id") % 19 == 0, F.lit('["edit"]')).otherwise(body)
    return e.select(F.col("user_id").cast("string").cast("binary").alias("key"), text.cast("binary").alias("value"), F.lit("changes").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"))


def decode_messages(spark, d):
    """Messages replayed from files through the stream, twice; the second run re-reads nothing."""
    landed, out = storage.scratch(spark, "messages"), storage.scratch(spark, "bronze")
    _messages(spark, d).write.parquet(landed)
    for _ in range(2):
        stream = spark.readStream.schema(messages.MESSAGE_SCHEMA).parquet(landed)
        messages.stream_to_table(messages.decode_messages(stream, stamped=False), f"{out}/table", f"{out}/checkpoint")
    rows = messages.read_stream_table(spark, f"{out}/table")
    return rows.select("event_json", "kafka_topic", "kafka_partition", "kafka_offset", F.unix_micros("kafka_enqueued_at").alias("enqueued_us"))


def stream_schema_merge(spark, d):
    """A stream whose second run has one column more and one less than the first."""
    landed, out = storage.scratch(spark, "messages"), storage.scratch(spark, "bronze")
    for k in range(2):
        _messages(spark, d).where(F.col("offset") % 2 == k).write.mode("append").parquet(landed)
        rows = messages.decode_messages(spark.readStream.schema(messages.MESSAGE_SCHEMA).parquet(landed), stamped=False).select("kafka_offset", "kafka_topic", "kafka_partition")
        rows = rows.withColumn("shard", F.col("kafka_partition") + 10).drop("kafka_topic") if k else rows
        messages.stream_to_table(rows, f"{out}/table", f"{out}/checkpoint")
    return messages.read_stream_table(spark, f"{out}/table")


def keep_edits(spark, d):
    return messages.keep_edits(messages.decode_messages(_messages(spark, d), stamped=False)).select("kafka_offset")


def _compacted(spark, d) -> Table:
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    table = Table(spark, storage.scratch(spark, "layout"), "orders").overwrite(o.repartition(12))
    return table.overwrite(table.read(), arrange=lambda df: layout.compact(df, ["o_orderstatus", "o_orderkey"], 3))


def compact_rows(spark, d):
    return _compacted(spark, d).read()


def table_detail(spark, d):
    return layout.table_summary(_compacted(spark, d).read()).select("num_files", "rows", (F.col("size_in_bytes") > 0).alias("has_bytes"))


def append_rows(spark, d):
    table, s = _region_table(spark, d)
    return table.append(s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"))).read()


def contract_violations(spark, d):
    table, _ = _region_table(spark, d)
    rows = table.read().select(F.col("c_custkey"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    agreed = contract.Contract(table.schema(), required=("c_custkey", "c_name", "c_nationkey"))
    agreed.check(rows)
    return agreed.violations(rows)


def csv_inferred(spark, d):
    path = storage.scratch(spark, "inferred")
    files.split_to_files(t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, 3)
    return files.read_csv(spark, path, infer=True, multiLine=False)


def dropped_csv(spark, d):
    """One small file of a chosen name, found as the first path that can be read."""
    folder = storage.scratch(spark, "dropped")
    files.drop_csv(t(spark, d, "nation").select("n_nationkey", "n_name"), folder, "nations.csv")
    return files.read_first_available(spark, [f"{folder}/absent.csv", f"{folder}/nations.csv"], schema="n_nationkey int, n_name string")


def lineage(spark, d):
    path, at = storage.scratch(spark, "lineage"), F.lit("2024-05-06 07:08:09").cast("timestamp")
    files.split_to_files(t(spark, d, "customer").select("c_custkey"), path, 2)
    read = files.add_lineage(files.read_csv(spark, path, "c_custkey long", multiLine=False), at)
    return read.select("c_custkey", S.base_name("_source_file").startswith("part-").alias("named"), F.unix_micros("_ingested_at").alias("ingested_us"), "_load_date")


def audit_by_name(spark, d):
    path = storage.scratch(spark, "audit")
    e = t(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    files.split_to_files(e, path, 5)
    read = files.read_csv(spark, path, "event_id long, at long", multiLine=False).select("*", files.source_file().alias("_source_file"))
    per = audit.file_audit(read, ts="at", by_name=True)
    return per.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def row_counts(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    table = Table(spark, storage.scratch(spark, "counts"), "counted").overwrite(o)
    by_sql = spark.sql(f"SELECT 'sql' AS way, count(*) AS rows FROM {table.view()}")
    by_frame = audit.row_count(o).select(F.lit("frame").alias("way"), "rows")
    more = audit.count_delta(o.where("o_orderstatus = 'F'"), o)
    return by_sql.unionByName(by_frame).unionByName(spark.createDataFrame([("table", table.row_count()), ("delta", more)], "way string, rows long"))


def sql_limit(spark, d):
    table = Table(spark, storage.scratch(spark, "sql"), "ranked").overwrite(t(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    return spark.sql(f"SELECT o_orderkey, o_totalprice FROM {table.view()} ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")


def _rescue_types(spark, d):
    folder = storage.scratch(spark, "landing")
    e = t(spark, d, "events").select(*[F.col(c).cast("string").alias(c) for c in EVENT_COLUMNS])
    odd = F.when(F.col("event_id").cast("long") % 7 == 0, F.concat(F.lit("zz"), F.col("user_id"))).otherwise(F.col("user_id"))
    files.split_to_files(e.withColumn("user_id", odd), folder, 4)
    p, schema = ingest.Pipeline(storage.scratch(spark, "ingest"), "types"), _ingest_schema()
    ingest.ingest_files(spark, folder, p, schema=schema, rescued=True, multiLine=False)
    return ingest.read_ingested(spark, p, schema, rescued=True)


def ingest_rescue_types(spark, d):
    return _rescue_types(spark, d).select(*EVENT_COLUMNS, "_rescued_data")


def rescued_rows(spark, d):
    return quality.rescued_rows(_rescue_types(spark, d)).select("event_id", "_rescued_data")


def _titles(spark, d) -> DataFrame:
    """Parts as title batches: padded names, some bad types and years, and a second batch of every third key."""
    p, k = t(spark, d, "part"), F.col("p_partkey")
    kind = F.when(k % 10 == 0, "Clip").when(k % 2 == 0, "Movie").otherwise("TV Show")
    first = p.select(
        k.cast("string").alias("show_id"), kind.alias("type"), _padded().alias("title"), F.lit("May 4, 2020").alias("date_added"), (F.lit(1890) + F.col("p_size") * 4).cast("string").alias("release_year"),
        F.concat(F.col("p_size").cast("string"), F.lit(" min")).alias("duration"), F.lit("b1").alias("_batch_id"), F.lit(1).cast("bigint").alias("_ingestion_sequence"), F.lit("2024-01-01").cast("timestamp").alias("_ingested_at"),
    )
    later = first.where(F.col("show_id").cast("long") % 3 == 0).withColumns({"duration": F.lit("2 Seasons"), "_batch_id": F.lit("b2"), "_ingestion_sequence": F.lit(2).cast("bigint")})
    return first.unionByName(later)


def _published(spark, d) -> tuple[Table, Table]:
    root = storage.scratch(spark, "silver")
    updates, quarantine = Table(spark, root, "updates"), Table(spark, root, "quarantine")
    silver.publish_updates(_titles(spark, d), updates, quarantine, F.lit("2024-02-01").cast("timestamp"), F.lit("2024-02-01").cast("date"))
    return updates, quarantine


def publish_silver(spark, d):
    return _published(spark, d)[0].read().select("show_id", "content_type", "title", "date_added", "release_year", "duration_value", "duration_unit", "_batch_id")


def publish_quarantine(spark, d):
    return _published(spark, d)[1].read().select("show_id", "_batch_id", "_quality_errors")


def title_quality(spark, d):
    return quality.quality_report(silver.clean_titles(_titles(spark, d)), silver.title_report(F.lit("2024-02-01").cast("date")))


def compact_ranges(spark, d):
    """Files of a compacted table, and how many of them start before the one before them ends."""
    per = layout.file_ranges(_compacted(spark, d).read(), ["o_orderstatus", "o_orderkey"])
    held = F.sort_array(F.collect_list(F.struct("low", "high")))  # a row for each of three files
    return per.agg(held.alias("r")).select(F.size("r").cast("long").alias("num_files"), F.expr("size(filter(sequence(1, size(r) - 1), i -> r[i].low <= r[i - 1].high))").cast("long").alias("overlaps"))


def _drop_lines(lines: DataFrame, header: str, folder: str) -> None:
    """Appends files of raw lines below a header, as a careless producer would write them."""
    text = lines.toDF(header).write.mode("append").options(header=True, sep="\x01", quote="\x00", escapeQuotes=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    text.csv(folder)


def ingest_malformed(spark, d):
    """Rows with a cell too many, and rows with a quote that is never closed."""
    folder, e = storage.scratch(spark, "landing"), t(spark, d, "events").select(*[F.col(c).cast("string").alias(c) for c in EVENT_COLUMNS])
    k = F.col("event_id").cast("long")
    line = F.when(k % 7 == 0, F.concat_ws(",", *EVENT_COLUMNS, F.lit("lost"))).when(k % 11 == 0, F.concat("event_id", F.lit(',"'), "user_id", F.lit(","), "event_type")).otherwise(F.concat_ws(",", *EVENT_COLUMNS))
    _drop_lines(e.select(line).repartition(3), ",".join(EVENT_COLUMNS), folder)
    p, schema = ingest.Pipeline(storage.scratch(spark, "ingest"), "malformed"), _ingest_schema()
    ingest.ingest_files(spark, folder, p, schema=schema, rescued=True, multiLine=False)
    return ingest.read_ingested(spark, p, schema, rescued=True).select(*EVENT_COLUMNS, "_rescued_data")


def ingest_poison(spark, d):
    """Good files, files that cannot be aligned, then more good files: all good rows, and why the others were set aside."""
    folder, e = _event_files(spark, d, 3)
    p = ingest.Pipeline(storage.scratch(spark, "ingest"), "poison")
    line = e.where("event_type = 'error'").select(F.concat_ws(",", *EVENT_COLUMNS)).coalesce(1)
    for header in ("event_id,user_id,event_id", "event_id,user_id,USER_ID", "event_id,_source_file,event_type", "event_id,,event_type"):
        _drop_lines(line, header, folder)
    ingest.ingest_files(spark, folder, p, mode="add_new_columns", multiLine=False)
    _drop_lines(line, "EVENT_ID,user_id,Event_Type", folder)  # another case, the same columns
    ingest.ingest_files(spark, folder, p, mode="add_new_columns", multiLine=False)
    rows = ingest.read_ingested(spark, p).select(*EVENT_COLUMNS, F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(ingest.read_quarantine(spark, p).select("reason"), allowMissingColumns=True)


def progress_log(spark, d):
    """Batches and their files as the listener kept them, and rows as the writes counted them, of two runs in two sessions."""
    folder, e = _event_files(spark, d)
    p = ingest.Pipeline(storage.scratch(spark, "ingest"), "logged")
    for k in range(2):
        session = spark.newSession()
        if k:
            e.where("event_type = 'error'").coalesce(1).write.mode("append").option("header", True).csv(folder)
        with ingest.logged_progress(session, p):
            ingest.ingest_files(session, folder, p, schema=_ingest_schema(), max_files=2, multiLine=False)
    seen = ingest.read_progress(spark, p).where("num_input_rows > 0").select("batch_id", F.col("num_input_rows").alias("files"), (F.col("duration_ms") > 0).alias("timed"))
    both = seen.join(ingest.batch_stats(spark, p), "batch_id")
    run = F.when(F.col("batch_id") < 3, 1).otherwise(2).alias("run")
    return both.groupBy(run).agg(F.count(F.lit(1)).alias("batches"), F.sum("files").alias("files"), F.sum("num_input_rows").alias("rows"), F.bool_and("timed").alias("timed"))


def history_parts(spark, d):
    """The two parts of a history, by the folders they are read from."""
    table = _history(spark, _waves(spark, d))
    part = lambda df, name: df.groupBy("st").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "st", "n")
    return part(table.current_rows(), "current").unionByName(part(table.files(table.commit()["folders"]), "closed"))


def merge_files(spark, d):
    """Rows of the pieces that a merge reads and leaves, where each quarter of the customers came by a merge of its own."""
    c = t(spark, d, "customer").select("c_custkey", "c_name", F.lit("a").alias("_record_hash"))
    table = Table(spark, storage.scratch(spark, "pieces"), "customers", ("c_custkey",), 4, index_bits=24).create_like(c)
    step = lambda target, source: cdc.scd1_merge(target, source, ["c_custkey"], checked=True)
    for k in range(4):
        table.merge(c.where(F.col("c_custkey") % 4 == k), step, stable=True)
    table.merge(c.where("c_custkey % 8 = 2").withColumns({"c_name": F.lit("renamed"), "_record_hash": F.lit("b")}), step)
    kept, now = table.files(table.commit()["merge"]["kept"]).agg(F.count(F.lit(1)).alias("rows_left")), table.read()
    total = now.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("c_name") == "renamed").alias("renamed"))
    return total.crossJoin(kept).select("rows_left", (F.col("rows") - F.col("rows_left")).alias("rows_rewritten"), "renamed")  # one row each


def append_once(spark, d):
    """Batches with a new column, each tried twice by its writer."""
    table, s = _region_table(spark, d)
    rows = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.lit("supplier").alias("kind"))
    for batch in range(2):
        for _ in range(2):
            table.append(rows.where(F.col("c_custkey") % 2 == batch), evolve=True, writer=("loader", batch))
    return table.read()


def write_counters(spark, d):
    """The counters of ``title_quality``, taken by the write itself."""
    report = silver.title_report(F.lit("2024-02-01").cast("date"))
    counters = {name: F.count_if(bad) for name, bad in report.items()}
    table = Table(spark, storage.scratch(spark, "counted"), "titles").overwrite(silver.clean_titles(_titles(spark, d)), counters=counters)
    counts = table.counts()
    return spark.createDataFrame([tuple(counts[k] for k in ("rows", *report))], ", ".join(f"{k} long" for k in ("rows", *report)))


def bronze_strings(spark, d):
    return bronze.bronze_columns(t(spark, d, "part"), ["p_partkey", "p_name", "p_size"])


def reset_tables(spark, d):
    """Tables dropped if the flag is set: one is, the other is not."""
    root = storage.scratch(spark, "reset")
    gone, kept = Table(spark, root, "gone").overwrite(t(spark, d, "supplier")), Table(spark, root, "kept").overwrite(t(spark, d, "nation"))
    drop_all([gone], True)
    drop_all([kept], False)
    return spark.createDataFrame([(x.name, x.exists(), x.row_count() if x.exists() else 0) for x in (gone, kept)], "name string, there boolean, rows long")


def ordered_keys(spark, d):
    return audit.with_position(t(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderkey"), "place")


def counts_in_order(spark, d):
    return audit.with_position(audit.count_by(t(spark, d, "part"), "p_type"), "place").withColumnRenamed("count", "n")


def z_ordered_rows(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return Table(spark, storage.scratch(spark, "layout"), "orders").overwrite(o, arrange=lambda df: layout.cluster(df, ["o_custkey", "o_orderdate"], 16)).read()


def z_order_files(spark, d):
    """Whether a Z-order needs fewer of 16 files than a plain sort for a range of the second column, and few for one of either."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    root, both = storage.scratch(spark, "layout"), ["o_custkey", "o_orderdate"]
    low, high = o.agg(F.percentile_approx("o_custkey", 0.4), F.percentile_approx("o_custkey", 0.5)).first()
    cuts = {"o_custkey": (F.lit(low), F.lit(high)), "o_orderdate": (F.lit("1996-01-01").cast(o.schema["o_orderdate"].dataType), F.lit("1996-06-30").cast(o.schema["o_orderdate"].dataType))}
    out = None
    for way, arrange in (("sort", lambda df: layout.compact(df, both, 16)), ("z_order", lambda df: layout.cluster(df, both, 16))):
        df = Table(spark, root, way).overwrite(o, arrange=arrange).read()
        for c, (a, b) in cuts.items():
            one = layout.files_for(df, (F.col(f"{c}_low") <= b) & (F.col(f"{c}_high") >= a), both).select(F.lit(way).alias("way"), F.lit(c).alias("by"), "files", "needed")
            out = one if out is None else out.unionByName(one)
    needed = lambda way, c: F.max(F.when((F.col("way") == way) & (F.col("by") == c), F.col("needed")))
    return out.agg(
        F.sum("files").alias("files"), (needed("sort", "o_orderdate") == 16).alias("sort_reads_all"), (needed("z_order", "o_orderdate") <= 8).alias("z_order_prunes_second"), (needed("z_order", "o_custkey") <= 8).alias("z_order_prunes_first")
    )


def _small_files(spark, d) -> tuple[Table, dict[str, int]]:
    """Orders in one large file, and then by a dozen small appends, the small ones packed."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    table = Table(spark, storage.scratch(spark, "packed"), "orders").overwrite(o.where("o_orderkey % 4 <> 0").coalesce(1))
    large = max(storage.file_sizes(spark, f"{table.path}/{table.commit()['folders'][0]}").values())
    for k in range(3):
        table.append(o.where((F.col("o_orderkey") % 4 == 0) & (F.col("o_custkey") % 3 == k)).repartition(4))
    return table, layout.compact_small(table, large)


def packed_rows(spark, d):
    return _small_files(spark, d)[0].read()


def packed_files(spark, d):
    """Files and rows rewritten and kept."""
    table, told = _small_files(spark, d)
    rows = layout.table_detail(table.read()).agg(F.max("rows").alias("rows_kept"), F.sum("rows").alias("rows"))
    counted = rows.select("rows_kept", (F.col("rows") - F.col("rows_kept")).alias("rows_rewritten"))
    return counted.select(*[F.lit(told[k]).cast("long").alias(f"files_{k}") for k in ("rewritten", "written", "kept")], "rows_kept", "rows_rewritten")


NAMES = (
    "select_filter count_by_type enrich_left flatten_nested top_k clean_strings parse_dates parse_duration base_name_audit row_hash ensure_columns change_batches "
    "gate_valid gate_quarantine latest_per_key prepare_updates classify_changes scd1_state scd2_history duplicate_keys quality_report contract_reject contract_evolve "
    "widen_rename_drop ingest_stream ingest_evolve ingest_rescue trigger_batches unsafe_reload safe_reload decode_messages stream_schema_merge keep_edits compact_rows table_detail "
    "append_rows contract_violations csv_inferred dropped_csv lineage audit_by_name row_counts sql_limit ingest_rescue_types rescued_rows publish_silver publish_quarantine title_quality compact_ranges "
    "ingest_malformed ingest_poison progress_log history_parts merge_files append_once write_counters bronze_strings reset_tables ordered_keys counts_in_order "
    "z_ordered_rows z_order_files packed_rows packed_files"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
