"""Published tables: Parquet folders that a commit names.

``root/name/_commits/<n>.json`` is a publication of the whole table: its
schema, the folders that hold its rows, and what was counted while they were
written. The live one has the highest number. Rows are written to folders of
their own first, and the commit is then moved to a name that must not exist
yet. So a publication is one step: readers see all of it or nothing, a writer
that dies leaves nothing that is read, and of two writers one is told so. Each
commit is complete, so there is no log to replay.

A table with ``keys`` and ``buckets`` keeps its rows in hash buckets, each a
list of pieces. A merge reads and rewrites only pieces that may hold a key of
its source; with ``index_bits`` a bit index of each piece's keys names likely
ones, and their key columns tell which do.
With ``current``, the name of a boolean column, only current rows are kept in
buckets; closed ones go to folders that are appended to and that no merge reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.contract import check_same, widened_schema
from . import storage

#: A bucket of more pieces is rewritten as one by the next merge that touches it.
MAX_PIECES = 8
#: Bits that the index sets for a key, each from a hash of its own.
PROBES = 3

Step = Callable[[DataFrame, DataFrame], DataFrame]


class ConcurrentWrite(RuntimeError):
    """Another writer has published since this one read the table; nothing of this one is visible."""


@dataclass(frozen=True)
class Table:
    spark: SparkSession
    root: str
    name: str
    keys: tuple[str, ...] = ()
    buckets: int = 0
    current: str | None = None
    index_bits: int = 0

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    def version(self) -> int:
        """The number of the live commit, -1 before the first."""
        return max((int(x[:-5]) for x in storage.children(self.spark, f"{self.path}/_commits") if x.endswith(".json") and x[:-5].isdigit()), default=-1)

    def exists(self) -> bool:
        return self.version() >= 0

    def commit(self, version: int | None = None) -> dict:
        """The live commit: ``schema``, ``folders``, ``buckets``, ``index``, ``writers``, ``counts`` and, after a merge, ``merge``."""
        version = self.version() if version is None else version
        if version < 0:
            raise LookupError(f"table {self.name} does not exist")
        return json.loads(storage.read_text(self.spark, f"{self.path}/_commits/{version:012d}.json"))

    def schema(self) -> StructType:
        return StructType.fromJson(self.commit()["schema"])

    def _files(self, commit: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(commit["schema"])
        paths = [f"{self.path}/{x}" for x in folders]
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        commit = self.commit()
        return self._files(commit, [*commit["folders"], *[x for pieces in commit["buckets"].values() for x in pieces]])

    def current_rows(self) -> DataFrame:
        """The rows in buckets: with ``current``, those that are current. No closed row is read."""
        commit = self.commit()
        return self._files(commit, [x for pieces in commit["buckets"].values() for x in pieces])

    def files(self, folders: list[str] | None = None) -> DataFrame:
        """The rows of some of the live folders, of all by default."""
        commit = self.commit()
        return self.read() if folders is None else self._files(commit, folders)

    def manifest(self) -> dict[str, list[str]]:
        """Bucket -> its pieces, of the buckets that have rows."""
        return self.commit()["buckets"]

    def counts(self) -> dict[str, int]:
        """``rows``, and the other counters asked for, as counted by the write of the live commit."""
        return self.commit()["counts"]

    def _bucket(self) -> Column:
        """The partition that ``repartition(buckets, *keys)`` deals a row to, so a joined task writes one bucket."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, counters: dict[str, Column] | None = None) -> tuple[str, dict]:
        """``df`` in a folder of its own, and what was counted on the way, without a job for it."""
        folder, seen = f"data-{uuid.uuid4().hex}", Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (counters or {}).items()])
        if self.buckets:
            split = ["_closed", "_bucket"] if self.current else ["_bucket"]
            dealt = df.withColumn("_bucket", self._bucket())
            dealt = dealt.withColumn("_closed", ~F.coalesce(F.col(self.current), F.lit(False))) if self.current else dealt
            dealt.write.partitionBy(*split).parquet(f"{self.path}/{folder}")
        else:
            df.write.parquet(f"{self.path}/{folder}")
        return folder, dict(seen.get)

    def _pieces(self, folder: str) -> tuple[list[str], dict[str, str]]:
        """Closed folders, and the piece of each bucket, of a folder just written."""
        parts = {"": folder} if not self.current else {x: f"{folder}/{x}" for x in storage.children(self.spark, f"{self.path}/{folder}") if x.startswith("_closed=")}
        closed = [x for name, x in parts.items() if name == "_closed=true"]
        live = [x for name, x in parts.items() if name != "_closed=true"]
        return closed, {x.split("=")[1]: f"{f}/{x}" for f in live for x in storage.children(self.spark, f"{self.path}/{f}") if x.startswith("_bucket=")}

    def _publish(self, version: int, commit: dict) -> bool:
        return storage.publish_text(self.spark, f"{self.path}/_commits/{version:012d}.json", json.dumps(commit))

    def overwrite(self, df: DataFrame, arrange: Callable[[DataFrame], DataFrame] | None = None, counters: dict[str, Column] | None = None) -> "Table":
        """Publishes ``df`` as the whole table, with its schema; of writers at the same time the last one stays."""
        df = arrange(df) if arrange else df
        dealt = df.repartition(self.buckets, *self.keys) if self.buckets else df
        folder, counts = self._write(dealt, counters)
        commit = {"schema": df.schema.jsonValue(), "folders": [folder], "buckets": {}, "index": {}, "writers": {}, "counts": counts}
        if self.buckets:
            commit["folders"], pieces = self._pieces(folder)
            commit["buckets"] = {b: [x] for b, x in pieces.items()}
            commit["index"] = self._index(df.schema, list(pieces.values()))
        while not self._publish(self.version() + 1, commit):
            pass
        return self

    def create_like(self, df: DataFrame) -> "Table":
        """An empty table with the schema of ``df``, unless the table exists."""
        return self if self.exists() else self.overwrite(df.limit(0))

    def append(self, df: DataFrame, evolve: bool = False, writer: tuple[str, int] | None = None, counters: dict[str, Column] | None = None) -> "Table":
        """Adds rows, and with ``evolve`` columns, in one publication; tables in buckets are merged into instead.

        Unknown columns are rejected unless ``evolve``; rejected rows leave the
        table as it is. ``writer`` names the writer and its batch: a batch not
        later than the last one published of that writer adds nothing, so a
        batch that is tried again is there once. Appends at the same time are
        published one after the other.
        """
        if self.buckets:
            raise ValueError("a table in buckets takes rows by merge")
        written: tuple[str, dict, dict] | None = None
        while True:
            version = self.version()
            commit = self.commit(version)
            if writer and commit["writers"].get(writer[0], -1) >= writer[1]:
                return self
            old = StructType.fromJson(commit["schema"])
            if evolve:
                schema = widened_schema(old, df.schema)
            else:
                check_same(old, df.schema)
                schema = old
            if written is None or written[2] != schema.jsonValue():
                cells = [F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
                written = (*self._write(df.select(*cells), counters), schema.jsonValue())
            folder, counts, named = written
            commit |= {"schema": named, "folders": [*commit["folders"], folder], "counts": counts, "writers": commit["writers"] | (dict([writer]) if writer else {})}
            commit.pop("merge", None)
            if self._publish(version + 1, commit):
                return self

    def merge(self, source: DataFrame, step: Step, stable: bool = False, counters: dict[str, Column] | None = None) -> "Table":
        """Publishes ``step(target, source)`` in place of the pieces that may hold a key of ``source``; all others stay.

        ``target`` is the rows of those pieces. Both frames come dealt out by
        the keys, so a join on them shuffles nothing more, and its tasks write
        a bucket each. ``step`` has to keep rows in their buckets, as merges on
        ``keys`` do; columns that it adds are taken in. A null key has a bucket
        too. A source that repeats a key raises ValueError. A ``stable`` source
        (files that stay as they are) is not copied first.
        """
        version = self.version()
        commit = self.commit(version)
        held = source if stable else storage.staged(source, "merge-source")
        try:
            reading = self._to_read(held, commit)
            merged = self.merged(held, step, commit, reading)
            folder, counts = self._write(merged, counters)
        finally:
            if not stable:
                storage.drop_staged(held)
        closed, pieces = self._pieces(folder)
        buckets = {b: [x for x in old if x not in reading] for b, old in commit["buckets"].items()}
        for b, x in pieces.items():
            buckets.setdefault(b, []).append(x)
        buckets = {b: x for b, x in buckets.items() if x}
        kept = {x for old in buckets.values() for x in old}
        index = {x: f for x, f in commit["index"].items() if x in kept} | self._index(merged.schema, list(pieces.values()))
        report = {"read": sorted(reading), "kept": sorted(kept - set(pieces.values())), "written": sorted(pieces.values())}
        commit |= {"schema": merged.schema.jsonValue(), "folders": commit["folders"] + closed, "buckets": buckets, "index": index, "counts": counts, "merge": report}
        if not self._publish(version + 1, commit):
            raise ConcurrentWrite(f"{self.name} has changed since version {version}")
        return self

    def merged(self, source: DataFrame, step: Step, commit: dict | None = None, reading: set[str] | None = None) -> DataFrame:
        """What a merge would write."""
        commit = commit or self.commit()
        reading = self._to_read(source, commit) if reading is None else reading
        target = self._files(commit, sorted(reading))
        return step(target.repartition(self.buckets, *self.keys), source.repartition(self.buckets, *self.keys))

    def _to_read(self, source: DataFrame, commit: dict) -> set[str]:
        """The pieces that may hold a key of ``source``, with an index those that do; at most all that the commit names. Repeated keys raise.

        Buckets of more than ``MAX_PIECES`` and pieces without an index are read whole.
        """
        per = source.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)], self._bucket().alias("b")).agg(F.count(F.lit(1)).alias("n"))
        touched = {str(r["b"]): r["n"] for r in per.groupBy("b").agg(F.max("n").alias("n")).collect()}  # at most ``buckets`` rows
        if max(touched.values(), default=1) > 1:
            raise ValueError(f"the merge source repeats a key of {list(self.keys)}")
        pieces = {b: x for b, x in commit["buckets"].items() if b in touched}
        whole = {x for held in pieces.values() for x in held if len(held) > MAX_PIECES or x not in commit["index"]}
        asked = {x for held in pieces.values() for x in held} - whole
        if not asked:
            return whole
        index = self.spark.read.parquet(*sorted({f"{self.path}/{commit['index'][x]}" for x in asked})).where(F.col("piece").isin(*sorted(asked)))
        names = [f"k{i}" for i in range(len(self.keys))]
        own = [F.col(k).alias(n) for k, n in zip(self.keys, names)]
        keys = source.select(*own, self._bucket().alias("bucket"), F.array_distinct(self._bits()).alias("bits"))  # two hashes may name one bit
        probes = keys.select(*names, "bucket", F.size("bits").alias("m"), F.explode("bits").alias("bit"))
        probes = probes.select(*names, "bucket", "m", F.shiftright("bit", 6).alias("word"), F.pmod("bit", F.lit(64)).cast("int").alias("at"))
        hits = probes.join(index, ["bucket", "word"]).where(F.expr("getbit(bits, at)") == 1)
        likely = storage.staged(hits.groupBy("piece", "m", *names).agg(F.count(F.lit(1)).alias("n")).where("n = m").select("piece", *names), "merge-hits")
        try:
            return whole | self._that_hold(likely, own, commit)
        finally:
            storage.drop_staged(likely)

    def _that_hold(self, likely: DataFrame, own: list[Column], commit: dict) -> set[str]:
        """The pieces that do hold one of their ``likely`` keys: all the bits of a key can be set by others. Key columns alone are read."""
        maybe = sorted(r["piece"] for r in likely.select("piece").distinct().collect())
        if not maybe:
            return set()
        levels = maybe[0].count("/") + 1  # folders of a piece below the table's
        rows = self._files(commit, maybe)
        path = F.substring_index(rows.metadataColumn("_metadata")["file_path"], "/", -levels - 1)
        held = rows.select(*[c.alias(f"held{i}") for i, c in enumerate(own)], F.substring_index(path, "/", levels).alias("of"))
        same = [F.col(f"k{i}").eqNullSafe(F.col(f"held{i}")) for i in range(len(own))]
        found = likely.join(held, [F.col("piece") == F.col("of"), *same], "left_semi")
        return {r["piece"] for r in found.select("piece").distinct().collect()}

    def _bits(self) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), *self.keys), F.lit(1 << self.index_bits)) for i in range(PROBES)])

    def _index(self, schema: StructType, pieces: list[str]) -> dict[str, str]:
        """Writes the bit index of new pieces, from their key columns alone: ``(piece, bucket, word, bits)``. Piece -> index folder."""
        if not self.index_bits or not pieces:
            return {}
        folder = f"keys-{uuid.uuid4().hex}"
        names = F.create_map(*[F.lit(v) for x in pieces for v in (x.split("=")[-1], x)])  # a piece for each bucket at most
        rows = self._files({"schema": schema.jsonValue()}, pieces).select(self._bucket().alias("bucket"), F.explode(self._bits()).alias("bit"))
        words = rows.groupBy("bucket", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(bit, 64)))")).alias("bits"))
        words.withColumn("piece", names[F.col("bucket").cast("string")]).write.parquet(f"{self.path}/{folder}")
        return dict.fromkeys(pieces, folder)

    def replace_files(self, rewritten: dict[str, list[str]], df: DataFrame) -> "Table":
        """Publishes ``df`` in place of some files, for tables without buckets: folder -> its files that stay.

        The folders left out stay whole. Rows are not checked: ``df`` should hold those of the files that go.
        """
        version = self.version()
        commit = self.commit(version)
        folder, counts = self._write(df)
        kept = [x for f in commit["folders"] for x in rewritten.get(f, [f])]
        commit |= {"folders": [*kept, folder], "counts": counts}
        if not self._publish(version + 1, commit):
            raise ConcurrentWrite(f"{self.name} has changed since version {version}")
        return self

    def view(self, alias: str | None = None) -> str:
        """Registers the live version as a temporary view for SQL."""
        self.read().createOrReplaceTempView(alias or self.name)
        return alias or self.name

    def row_count(self) -> int:
        return self.read().count()

    def drop(self) -> None:
        storage.delete(self.spark, self.path)


def drop_all(tables: list[Table], reset: bool) -> None:
    """Drops the tables if the reset flag is set."""
    for t in tables if reset else ():
        t.drop()
