"""Incremental file ingestion: discovered once, addressed by batch, columns matched by name.

A stream of file paths drives the ingestion. Each micro-batch learns the header
of every file from its first line alone, sets files aside that cannot be
aligned, reads the others once, aligns them by column name and writes to
``table/_ckpt=<query id>/_batch=<batch id>``, replacing that folder. A batch
that runs again after a failure therefore replaces itself, while a stream that
starts over with a new checkpoint adds everything again, as it should.
"""

from __future__ import annotations

import csv
import io
import json
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import DateType, StringType, StructField, StructType, TimestampType

from ..sources import storage
from ..sources.files import CSV_OPTIONS

PATHS = "path string, modificationTime timestamp, length long, content binary"
LINEAGE = [StructField("_source_file", StringType()), StructField("_ingested_at", TimestampType()), StructField("_load_date", DateType())]
RESCUED, CORRUPT = "_rescued_data", "_corrupt_record"
ADDRESS = ("_ckpt", "_batch", "_chunk")
#: Names that a file's own columns cannot have.
RESERVED = {f.name for f in LINEAGE} | {RESCUED, CORRUPT, *ADDRESS}
#: Files whose paths are held at a time; a larger batch is taken in chunks.
CHUNK = 10_000
#: Bytes read at a time in search of the end of a header, and stores that executors open by themselves.
HEAD_BYTES, OPENED = 1 << 16, ("file", "hdfs", "s3", "s3a", "gs")
QUARANTINE = "path string, header string, reason string"


class SchemaChanged(RuntimeError):
    """New columns were met and recorded; a restart takes them in."""


@dataclass(frozen=True)
class Pipeline:
    """One ingestion's own table, checkpoint, schema log, statistics and quarantine, kept apart by name."""

    root: str
    name: str

    def _at(self, part: str) -> str:
        return f"{self.root.rstrip('/')}/{self.name}/{part}"

    @property
    def table(self) -> str:
        return self._at("table")

    @property
    def checkpoint(self) -> str:
        return self._at("checkpoint")

    @property
    def schema_log(self) -> str:
        return self._at("schema.json")

    @property
    def stats(self) -> str:
        return self._at("stats")

    @property
    def quarantine(self) -> str:
        return self._at("quarantine")

    @property
    def progress(self) -> str:
        return self._at("progress")


def logged_columns(spark: SparkSession, p: Pipeline) -> list[str]:
    return json.loads(storage.read_text(spark, p.schema_log) or "[]")


def literal(path: str) -> str:
    """A path for Spark's readers in which no character is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def first_line(path: str, blank: bytes) -> bytes | None:
    """The first line of a file with other characters than ``blank``; no more is read than it takes to find it."""
    scheme, _, rest = re.sub(r"^file:/+", "file:///", path).partition(":")
    store, name = arrow_fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(rest)}")
    with store.open_input_stream(name) as f:
        held = b""
        while True:
            more = f.read(HEAD_BYTES)
            held += more
            line, end, rest = held.lstrip(blank).partition(b"\n")
            if end or not more:
                return line.rstrip(b"\r") or None


def first_lines(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """``(path, header)`` of each file: its first line that is not blank, null if there is none.

    Spark's CSV reader skips lines of blanks only where records are lines.
    Executors open the files and read their beginnings. Where only Spark can
    open a store, its text reader scans the files instead.
    """
    if {p.partition(":")[0] for p in paths} <= set(OPENED):

        blank = b"\r\n" if multi_line else b"\r\n \t"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lines = [first_line(x, blank) for x in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x and x.decode("utf-8", "replace") for x in lines], pa.string())], ["path", "header"])

        dealt = min(len(paths), 8 * spark.sparkContext.defaultParallelism)
        return spark.createDataFrame([(x,) for x in paths], "path string").repartition(dealt).mapInArrow(run, "path string, header string")
    lines = spark.read.text([literal(x) for x in paths]).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    return lines.where("at = 0 AND value != ''" if multi_line else "at = 0 AND trim(value) != ''").groupBy("path").agg(F.min_by("value", "row").alias("header"))


def header_fault(header: str) -> str | None:
    """Why a file with this header cannot be aligned; None if it can. Names are compared without their case, as Spark does."""
    if header.count('"') % 2:
        return "the header spans lines"
    names = next(csv.reader(io.StringIO(header)))
    folded = [x.strip().lower() for x in names]
    if "" in folded:
        return "a column has no name"
    twice = sorted({x for x in folded if folded.count(x) > 1})
    if twice:
        return f"the header repeats {', '.join(twice)}"
    taken = [x for x in folded if x in RESERVED]
    return f"reserved names: {', '.join(taken)}" if taken else None


def headers(spark: SparkSession, paths: list[str], multi_line: bool = True) -> tuple[dict[tuple[str, ...], list[str]], list[tuple[str, str, str]]]:
    """Files by header, and ``(path, header, reason)`` of those that cannot be aligned; files without a line are left out."""
    groups: dict[tuple[str, ...], list[str]] = {}
    bad: list[tuple[str, str, str]] = []
    rows = first_lines(spark, paths, multi_line).where(F.col("header").isNotNull()).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("files")).collect()  # at most CHUNK paths
    for r in rows:
        text = r["header"].removeprefix("﻿")
        fault = header_fault(text)
        if fault:
            bad += [(path, r["header"], fault) for path in r["files"]]
        else:
            groups.setdefault(tuple(next(csv.reader(io.StringIO(text)))), []).extend(r["files"])
    return groups, bad


def aligned(rows: DataFrame, header: tuple[str, ...], known: list[str], types: dict, run_ts: Column | None, rescued: bool) -> DataFrame:
    """Rows of files with one header in the columns ``known``; with ``rescued``, what does not fit as JSON."""
    ts = F.current_timestamp() if run_ts is None else run_ts
    place = {c.lower(): c for c in header}
    cell = lambda c: F.col(f"`{place[c.lower()]}`")
    cells = [(cell(c).try_cast(types[c]) if c in types else cell(c)).alias(c) if c.lower() in place else F.lit(None).cast(types.get(c, StringType())).alias(c) for c in known]
    cells += [F.col("_metadata.file_path").alias("_source_file"), ts.alias("_ingested_at"), F.to_date(ts).alias("_load_date")]
    if rescued:
        held = {c.lower() for c in known}
        odd = [F.col(f"`{c}`") for c in header if c.lower() not in held]
        odd += [F.when(cell(c).try_cast(types[c]).isNull(), cell(c)).alias(c) for c in known if c in types and c.lower() in place]
        odd.append(F.col(CORRUPT))
        cells.append(F.when(F.coalesce(*odd).isNotNull(), F.to_json(F.struct(*odd))).alias(RESCUED))
    return rows.select(*cells)


def batch_writer(table: str, make):
    """A ``foreachBatch`` function: ``make(df, batch)`` to the batch's own folder."""

    def write(df: DataFrame, batch: int) -> None:
        out = make(df, batch)
        if out is not None:
            out.write.mode("overwrite").parquet(f"{table}/_ckpt={query_id(df)}/_batch={batch}")

    return write


def query_id(df: DataFrame) -> str:
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def chunks(df: DataFrame) -> Iterator[list[str]]:
    """The paths of a batch, at most ``CHUNK`` at a time.

    They are made distinct, as Spark's file source lists files again beside one
    whose name has glob characters.
    """
    held: list[str] = []
    for r in df.select("path").distinct().toLocalIterator():
        held.append(r["path"])
        if len(held) == CHUNK:
            yield held
            held = []
    if held:
        yield held


def ingest_files(spark: SparkSession, source: str, p: Pipeline, mode: str = "fixed", schema: StructType | None = None, max_files: int = 1000, trigger: str = "available_now", rescued: bool = False, glob: str = "*.csv", run_ts: Column | None = None, **options) -> StreamingQuery:
    """Takes in the CSV files of ``source`` that the checkpoint has not seen, and waits.

    ``mode``: ``fixed`` keeps the columns of ``schema``; ``add_new_columns``
    keeps strings, records columns it has not met and raises ``SchemaChanged``
    so that a restart takes them in; ``rescue`` keeps the recorded columns.
    Names match whatever their case. Columns outside the schema are dropped and
    cells that do not fit their type become null, or with ``rescued`` both are
    kept as JSON in ``_rescued_data``, beside the raw line of each row that has
    not as many cells as its header (under ``_corrupt_record``). Files whose
    header repeats a name, lacks one, spans lines or uses a reserved name are
    set aside with the reason (``read_quarantine``) and stop nothing.
    ``trigger``: ``available_now`` drains in batches of ``max_files``, ``once``
    in one batch whatever the limit.
    """
    if mode == "fixed" and schema is None:
        raise ValueError("mode fixed needs a schema")
    changed: list[str] = []
    types = {f.name: f.dataType for f in schema} if schema is not None else {}

    def columns_for(session: SparkSession, groups: dict[tuple[str, ...], list[str]]) -> list[str]:
        if schema is not None:
            return [f.name for f in schema]
        known = logged_columns(session, p)
        held, new = {c.lower() for c in known}, {}
        for c in (c for h in groups for c in h):
            if c.lower() not in held:
                new.setdefault(c.lower(), c)
        if new and (not known or mode == "add_new_columns"):
            storage.write_text(session, p.schema_log, json.dumps(known + list(new.values())))
            if known:
                changed.extend(new.values())
                raise SchemaChanged(f"new columns {list(new.values())}")
            known = list(new.values())
        return known

    def write(df: DataFrame, batch: int) -> None:
        session, address = df.sparkSession, f"_ckpt={query_id(df)}/_batch={batch}"
        for part in (p.table, p.quarantine):
            storage.delete(session, f"{part}/{address}")  # of an attempt that failed
        rows = files = aside = 0
        for k, paths in enumerate(chunks(df)):
            groups, bad = headers(session, paths, str((CSV_OPTIONS | options)["multiLine"]).lower() == "true")
            if bad:
                session.createDataFrame(bad, QUARANTINE).coalesce(1).write.parquet(f"{p.quarantine}/{address}/_chunk={k}")
                aside += len(bad)
            known, out = columns_for(session, groups), None
            for header, names in sorted(groups.items()):
                fields = [*header, CORRUPT] if rescued else header
                reader = session.read.options(**(CSV_OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} | options))
                part = aligned(reader.schema(StructType([StructField(c, StringType()) for c in fields])).csv([literal(x) for x in names]), header, known, types, run_ts, rescued)
                out = part if out is None else out.unionByName(part)
            if out is not None:
                seen = Observation()
                out.observe(seen, F.count(F.lit(1)).alias("rows"), F.size(F.collect_set("_source_file")).alias("files")).write.parquet(f"{p.table}/{address}/_chunk={k}")
                rows, files = rows + seen.get["rows"], files + seen.get["files"]
        told = {"ckpt": query_id(df), "batch_id": batch, "num_input_rows": rows, "num_files": files, "num_quarantined": aside}
        storage.write_text(session, f"{p.stats}/{query_id(df)}-{batch}.json", json.dumps(told))

    stream = spark.readStream.format("binaryFile").schema(PATHS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(source).select("path")
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", p.checkpoint)
    writer = writer.trigger(once=True) if trigger == "once" else writer.trigger(availableNow=True)
    try:
        query = writer.start()
        query.awaitTermination()
        return query
    except Exception as e:
        if changed:
            raise SchemaChanged(f"new columns {changed}; restart to take them in") from e
        raise


def read_ingested(spark: SparkSession, p: Pipeline, schema: StructType | None = None, rescued: bool = False) -> DataFrame:
    """All ingested rows, without the addressing columns. The schema is known, so no footers are merged."""
    fields = list(schema) if schema is not None else [StructField(c, StringType()) for c in logged_columns(spark, p)]
    full = StructType([*fields, *LINEAGE, *([StructField(RESCUED, StringType())] if rescued else []), *[StructField(c, StringType()) for c in ADDRESS]])
    return spark.read.schema(full).parquet(p.table).drop(*ADDRESS)


def read_quarantine(spark: SparkSession, p: Pipeline) -> DataFrame:
    """``(path, header, reason)`` of the files set aside; no rows if there are none."""
    if not storage.exists(spark, p.quarantine):
        return spark.createDataFrame([], QUARANTINE)
    return spark.read.schema(f"{QUARANTINE}, {', '.join(f'{c} string' for c in ADDRESS)}").parquet(p.quarantine).drop(*ADDRESS)


def batch_stats(spark: SparkSession, p: Pipeline) -> DataFrame:
    """``(batch_id, num_input_rows, num_files, num_quarantined)`` of every batch, as counted while it was written; files are those that gave rows."""
    schema = "ckpt string, batch_id long, num_input_rows long, num_files long, num_quarantined long"
    told = spark.read.schema(schema).json(p.stats) if storage.exists(spark, p.stats) else spark.createDataFrame([], schema)
    return told.drop("ckpt")


def progress(query: StreamingQuery) -> list[dict]:
    """Batch id, input rows of the path stream and duration of a query's recent batches."""
    return [{"batch_id": x["batchId"], "num_input_rows": x["sources"][0]["numInputRows"], "duration_ms": x["durationMs"].get("triggerExecution")} for x in query.recentProgress]


def progress_frame(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """``progress`` as a frame."""
    return spark.createDataFrame([tuple(x.values()) for x in progress(query)], "batch_id long, num_input_rows long, duration_ms long")


class ProgressLog(StreamingQueryListener):
    """Writes a small file for each batch of any query of the session, as Spark reports it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.open: set[str] = set()
        self.idle = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self.idle:
            self.open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        x = event.progress
        told = {"query_id": str(x.id), "run_id": str(x.runId), "batch_id": x.batchId, "num_input_rows": x.numInputRows, "duration_ms": x.durationMs.get("triggerExecution"), "at": x.timestamp}
        storage.write_text(self.spark, f"{self.folder}/{x.runId}-{x.batchId}.json", json.dumps(told))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.idle:
            self.open.discard(str(event.runId))
            self.idle.notify_all()


@contextmanager
def logged_progress(spark: SparkSession, p: Pipeline, wait_s: float = 30) -> Iterator[None]:
    """Keeps the progress of all batches that run inside, past the session's end; see ``read_progress``.

    Reports come late, so the end waits for those of queries that have ended.
    """
    log = ProgressLog(spark, p.progress)
    spark.streams.addListener(log)
    try:
        yield
    finally:
        with log.idle:
            log.idle.wait_for(lambda: not log.open, wait_s)
        spark.streams.removeListener(log)


def read_progress(spark: SparkSession, p: Pipeline) -> DataFrame:
    """``(query_id, run_id, batch_id, num_input_rows, duration_ms, at)`` of every batch that a ``logged_progress`` has seen."""
    schema = "query_id string, run_id string, batch_id long, num_input_rows long, duration_ms long, at timestamp"
    return spark.read.schema(schema).json(p.progress) if storage.exists(spark, p.progress) else spark.createDataFrame([], schema)


def reset(spark: SparkSession, p: Pipeline, table: bool = True) -> None:
    """Forgets the checkpoint and, for a safe reload, the table with its statistics and quarantine; the schema log stays."""
    storage.delete(spark, p.checkpoint)
    for part in (p.table, p.stats, p.quarantine) if table else ():
        storage.delete(spark, part)


def safe_reload(spark: SparkSession, source: str, p: Pipeline, **how) -> StreamingQuery:
    reset(spark, p)
    return ingest_files(spark, source, p, **how)
