"""WARC archives: writing with revisit records, and a salvage reader.

Tasks write gzip archives with one member per record straight to the shared
folder, each under a name of its own; only the archives of tasks that
succeeded are in the staged manifest, so retried tasks leave nothing behind
that is read. The reader takes one archive to a task and streams it. When a
check fails (gzip checksum, version line, lengths, digests) it searches for the
next member or version line that passes them all, inside a member too, goes on
from there and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import bounded_batches, join_hot, new_path, small_side, stage

#: An archive is closed when it has reached this size, compressed.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Records of a gzip member are held back up to this many bytes until its checksum is met.
HOLD = 64 << 20
MIN_REVISIT = 1000
#: Fixed value: the profile of revisit records for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")


def _header(lines: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in lines if v is not None).encode("utf-8", "surrogatepass")


def record(payload: bytes, url: str | None, page: int | None, refers_to: int | None, date: str, place: str | None = None) -> bytes:
    """One WARC record; a revisit has the HTTP head alone, with the length of the full payload.

    Its id follows from the page's, and from its ``place`` where the page's does not tell it from others.
    """
    head = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = head if refers_to is not None else head + payload
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}')}>"
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page if place is None else f"{page}:{place}")), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Profile", PROFILE if refers_to is not None else None), ("WARC-Refers-To", name(refers_to) if refers_to is not None else None),
        ("X-Page-Id", page), ("X-Refers-To-Page-Id", refers_to), ("WARC-Payload-Digest", sha(payload)), ("WARC-Block-Digest", sha(block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return b"WARC/1.1\r\n" + _header(lines) + b"\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html, refers_to, repeated``: the largest page id with an equal payload, null for that one itself.

    Payloads are equal if SHA-1 and length are. Null html is empty. Pages
    without an id, or under ``min_bytes``, refer to none. Rows that repeat the
    largest id are responses all. ``repeated`` marks rows that others share
    the page id with, and those without one.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    prints = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("size"))
    prints = stage(prints.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()), "warc-prints")
    prints = prints.select("page_id", F.struct("sha", "size").alias("print"))
    firsts = stage(prints.groupBy("print").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-firsts")
    later = join_hot(prints, firsts, "print", "n").where(F.col("page_id") < F.col("refers_to")).select(F.col("page_id").alias("p"), F.col("print.sha").alias("s"), "refers_to").distinct()
    later = small_side(stage(later, "warc-revisits"), width=96)
    joined = pages.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(later, (F.col("page_id") == F.col("p")) & (F.col("sha") == F.col("s")), "left")
    many = small_side(stage(pages.groupBy(F.col("page_id").alias("m")).count().where("count > 1").select("m"), "warc-repeated"))
    marked = joined.join(many, F.col("page_id") == F.col("m"), "left")
    return marked.select("page_id", "url", "html", "refers_to", (F.col("m").isNotNull() | F.col("page_id").isNull()).alias("repeated"))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would open it by."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def write_archives(pages: DataFrame, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``page_id, url, html, refers_to`` rows; returns the staged manifest ``(path, n_records, n_bytes)``.

    Null html is an empty payload; every row has a record, repeated ones too,
    and if ``repeated`` marks them, an id of its own.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html", "refers_to", "repeated" if "repeated" in pages.columns else F.lit(False).alias("repeated"))
    bounded_batches(spark)
    folder = qualified(spark, new_path(spark, "warc"))
    fields = ["path", "n_records", "n_bytes"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        for b in batches:
            for page, url, html, refers, repeated in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record((html or "").encode("utf-8", "surrogatepass"), url, page, refers, date, f"{name}:{n}" if repeated else None)
                size += out.write(data := gz.compress(raw) + gz.flush()) or len(data)
                n += 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([size])], fields)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([size])], fields)

    return stage(pages.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


class Window:
    """A forward window on a stream: bytes from ``base`` on, filled as asked for."""

    def __init__(self, stream):
        self.stream, self.base, self.buf, self.ended = stream, 0, bytearray(), False

    def fill(self, upto: int) -> bool:
        """Holds the bytes before offset ``upto`` if the stream has them."""
        while self.base + len(self.buf) < upto and not self.ended:
            part = self.stream.read(CHUNK)
            self.ended = not part
            self.buf += part
        return self.base + len(self.buf) >= upto

    def skip(self, to: int) -> None:
        del self.buf[: to - self.base]
        self.base = to

    def rewind(self, to: int) -> None:
        """Back to offset ``to``; the stream has to be one that can seek."""
        self.stream.seek(to)
        self.base, self.buf, self.ended = to, bytearray(), False

    def at_end(self, at: int) -> bool:
        return not self.fill(at + 1)


class Bad(Exception):
    pass


def upto_error(unpack, part: bytes) -> bytes:
    """What ``part`` unpacks to before its error."""
    out = []
    try:
        for i in range(len(part)):
            out.append(unpack.decompress(part[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


class Member:
    """The unpacked bytes of the gzip member at ``at`` as a stream; ``end`` is its end, ``bad`` what was wrong with it."""

    def __init__(self, w: Window, at: int):
        self.w, self.pos, self.end, self.bad = w, at, None, ""
        self.unpack = zlib.decompressobj(31)
        self.rest = b""

    def read(self, n: int) -> bytes:
        out = b""
        while not out and not self.bad and self.end is None:
            part = self.rest
            if not part:
                if not self.w.fill(self.pos + 1):
                    self.bad = "member is cut off"
                    break
                self.w.skip(self.pos)
                part = bytes(self.w.buf[:CHUNK])
                self.pos += len(part)
            before = self.unpack.copy()
            try:
                out = self.unpack.decompress(part, n)
            except zlib.error as e:
                self.bad = f"member is damaged: {str(e)[:60]}"
                return upto_error(before, part)
            self.rest = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.end = self.pos - len(self.unpack.unused_data)
        return out


@dataclass
class Found:
    """A record, or a gap of bytes that no record could be read from.

    Offsets are of the archive; within a member of several records ``inner``
    is the span in its unpacked bytes. A record with a ``reason`` was salvaged
    from a member that failed its own check; its block digest holds.
    """

    kind: str
    start: int
    stop: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""
    inner: tuple[int, int] | None = None
    proven: bool = False


def headers_at(w: Window, at: int) -> tuple[dict[str, str], int]:
    """The headers of the record at ``at`` and where its block starts. Raises Bad if they fail a check."""
    w.fill(at + 12)
    version = VERSION.match(w.buf, at - w.base)
    if not version:
        raise Bad("no version line")
    look = version.end() - 2
    while (end := w.buf.find(b"\r\n\r\n", look)) < 0:
        look = max(look, len(w.buf) - 3)
        if not w.fill(w.base + len(w.buf) + 1):
            raise Bad("headers have no end")
    headers: dict[str, str] = {}
    for line in bytes(w.buf[version.end() : end]).decode("utf-8", "replace").split("\r\n"):
        if line:
            k, colon, v = line.partition(":")
            if not colon:
                raise Bad("header line without a colon")
            headers[k.strip().lower()] = v.strip()
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        raise Bad("no content length")
    return headers, w.base + end + 4


def record_at(w: Window, at: int, most: int | None = None) -> tuple[dict[str, str], bytes, int, bool]:
    """One record of the window: headers, block, its end and whether it has a digest that holds. Raises Bad if a check fails."""
    headers, start = headers_at(w, at)
    stop = start + int(headers["content-length"])
    if most is not None and stop - start > most:
        raise Bad("record is too large")
    w.fill(stop + 4)
    if w.buf[stop - w.base : stop - w.base + 4] != b"\r\n\r\n":
        raise Bad("content length does not meet the record's end")
    block = bytes(w.buf[start - w.base : stop - w.base])
    kind, _, told = headers.get("warc-block-digest", "").partition(":")
    proven = kind.lower() == "sha1"
    if proven and told.upper() != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise Bad("block digest differs")
    return headers, block, stop + 4, proven


def plain_records(w: Window, start: re.Pattern, most: int | None = None, at: int = 0) -> Iterator[Found]:
    """Records and gaps of the window's bytes from ``at``, up to a gzip member if ``start`` finds those too."""
    gap, why = None, ""
    while not w.at_end(at):
        w.skip(at)
        w.fill(at + 3)
        if start is START and w.buf[:3] == MAGIC:
            break
        try:
            headers, block, end, proven = record_at(w, at, most)
        except Bad as e:
            if gap is None:
                gap, why = at, str(e)
            at = next_start(w, at + 1, start)
            continue
        if gap is not None:
            yield Found("gap", gap, at, reason=why)
            gap = None
        yield Found("record", at, end, headers, block, proven=proven)
        at = end
    if gap is not None:
        yield Found("gap", gap, at, reason=why)


def next_start(w: Window, at: int, start: re.Pattern) -> int:
    """The next offset that looks like a version line (or a member, if ``start`` finds those), else the end."""
    while True:
        w.skip(min(at, w.base + len(w.buf)))
        if m := start.search(w.buf, at - w.base):
            return w.base + m.start()
        end = w.base + len(w.buf)
        at = max(at, end - 11)
        if not w.fill(end + 1):
            return w.base + len(w.buf)


def member_records(m: Member, most: int | None, hold: int) -> Iterator[Found]:
    """Records and gaps of a gzip member by their unpacked offsets.

    They wait for the member's checksum until their blocks exceed ``hold``
    bytes. If it fails, records with a block digest of their own are salvaged
    with the reason, and the others and the gaps are part of the member's gap.
    """
    held, size = [], 0
    for x in plain_records(Window(m), VERSION, most):
        held.append(x)
        size += len(x.block)
        if size > hold:
            for x in held:
                x.reason = x.reason or ("" if x.proven else "its member was not yet checked")
            yield from held
            held, size = [], 0
    for x in held:
        if not m.bad:
            yield x
        elif x.proven:
            x.reason = m.bad
            yield x


def records(stream, most: int | None = None, hold: int = HOLD) -> Iterator[Found]:
    """Records and gaps of one archive, plain or compressed, from a stream that can seek.

    A member is unpacked as a stream and searched for version lines like a
    plain archive, so that a bad record costs its neighbours nothing. Memory is
    bounded by the largest record and ``hold``; a record whose length is
    damaged may be read on to the end of its member or archive. Records over
    ``most`` bytes, if that is given, are quarantined. A gap that spans whole
    members has offsets in the archive; one between the records of a member
    has the member's, and its own span as ``inner``.
    """
    w, at, gap, why = Window(stream), 0, None, ""
    while not w.at_end(at):
        w.skip(at)
        w.fill(at + 3)
        last, given = at, False
        if w.buf[:3] == MAGIC:
            m = Member(w, at)
            inside = member_records(m, most, hold)
        else:
            m, inside = None, plain_records(w, START, most, at)
        for x in inside:
            if m is not None:
                if x.kind == "gap" and not given and x.start == 0:
                    continue  # told below, if no record follows
                x.inner, x.start, x.stop = (x.start, x.stop), at, m.end or m.pos
            elif x.kind == "gap":
                gap, why = (x.start, x.reason) if gap is None else (gap, why)
                last = x.stop
                continue
            if gap is not None:
                yield Found("gap", gap, x.start, reason=why)
                gap = None
            given, last = True, x.stop
            yield x
        if m is None:
            at = last
        elif m.bad or not given:
            gap, why = (at, m.bad or "no record in the member") if gap is None else (gap, why)
            if m.bad:
                w.rewind(at)
                at = next_start(w, at + 1, START)
            else:
                at = m.end
        else:
            at = m.end
    if gap is not None:
        yield Found("gap", gap, at, reason=why)


READ = "path string, kind string, start long, stop long, inner_start long, inner_stop long, reason string, headers map<string,string>, payload_sha1 string, payload binary"
READ_ARROW = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("inner_start", pa.int64()), ("inner_stop", pa.int64()),
    ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_sha1", pa.string()), ("payload", pa.binary()),
])


def hex_of(told: str) -> str | None:
    """A ``sha1:`` digest in base 32 as lower-case hex; null for anything else."""
    kind, _, value = told.partition(":")
    try:
        return base64.b32decode(value.upper()).hex() if kind.lower() == "sha1" else None
    except ValueError:
        return None


def row_of(path: str, x: Found) -> dict:
    head, _, payload = x.block.partition(b"\r\n\r\n") if x.block.startswith(b"HTTP/") else (b"", b"", x.block)
    headers = dict(x.headers)
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[f"http:{k.strip().lower()}"] = v.strip()
    inner = x.inner or (None, None)
    return {
        "path": path, "kind": x.kind, "start": x.start, "stop": x.stop, "inner_start": inner[0], "inner_stop": inner[1], "reason": x.reason,
        "headers": list(headers.items()), "payload_sha1": hex_of(headers.get("warc-payload-digest", "")), "payload": payload,
    }


def read_archives(paths: DataFrame, path_col: str = "path", expect_col: str | None = None, most: int | None = None) -> DataFrame:
    """Records and gaps of the archives named in ``paths`` (URIs), one archive to a task.

    ``payload`` is the block after its HTTP head; HTTP headers join the record
    headers under ``http:``. ``payload_sha1`` is what the record's headers say
    of it. Null paths are left out, repeated ones read once; unreadable ones
    fail the job. If ``expect_col`` has the number of records of each archive,
    an archive with gaps or another number fails the job too, so none is lost
    without notice. Extra columns are left out.
    """
    bounded_batches(paths.sparkSession)
    expect = F.col(expect_col).cast("long") if expect_col else F.lit(None).cast("long")
    names = paths.where(F.col(path_col).isNotNull()).groupBy(F.col(path_col).alias("path")).agg(F.max(expect).alias("expect"))
    names = names.repartitionByRange(max(1, names.count()), "path")  # a range to an archive, which are not joined up again

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                rows, size, n, gaps = [], 0, 0, 0
                with fs.open_input_file(name) as stream:
                    for x in records(stream, most):
                        n, gaps = n + (x.kind == "record"), gaps + (x.kind == "gap")
                        rows.append(row_of(path, x))
                        size += len(x.block)
                        if len(rows) >= 256 or size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)
                            rows, size = [], 0
                if wanted is not None and (gaps or n != wanted):
                    raise RuntimeError(f"{path}: {n} records of {wanted} and {gaps} gaps")
                yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)

    return names.mapInArrow(read, READ)


def salvage(paths: DataFrame, path_col: str = "path", log: str | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(records, gaps)`` of damaged archives, each read once; the gaps are logged as a table at ``log``, if given, beside the staged one."""
    got = stage(read_archives(paths, path_col, most=most), "warc-salvaged")
    gaps = got.where("kind = 'gap'").drop("kind", "headers", "payload", "payload_sha1")
    if log is not None:
        gaps.write.mode("append").parquet(log)
    return got.where("kind = 'record'"), gaps


def digest(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` read back from the archives of ``pages``.

    Null html is an empty payload; repeated rows and rows without an id have a
    record each. A record that cannot be read back fails the job.
    """
    got = read_archives(write_archives(with_revisits(pages)), expect_col="n_records")
    h = F.col("headers")
    response = h["warc-type"] == "response"
    return got.select(
        h["x-page-id"].cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(h["http:content-length"].cast("long")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        h["warc-type"].alias("record_type"),
        h["x-refers-to-page-id"].cast("long").alias("refers_to"),
    )
