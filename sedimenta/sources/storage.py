"""Small file operations through Hadoop's file system API, so any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def file_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the data files in a folder, by name; of a file, its own under the empty name."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return {}
    whole = fs.getFileStatus(p)
    if whole.isFile():
        return {"": whole.getLen()}
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"}


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file (a schema, say) under another name, then renames it over the old one in one step.

    Readers find the old text or the new one, and a crash leaves the old one.
    """
    fs, p = _fs(spark, path)
    hadoop, p = spark._jvm.org.apache.hadoop.fs, fs.makeQualified(p)
    temp = hadoop.Path(f"{p.toString()}.{uuid.uuid4().hex[:8]}")
    out = fs.create(temp, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(temp, p, over)


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whose name must not exist yet, in one step; False if it does, and then nothing has changed."""
    fs, p = _fs(spark, path)
    hadoop, p = spark._jvm.org.apache.hadoop.fs, fs.makeQualified(p)
    fs.mkdirs(p.getParent())
    temp = hadoop.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(temp, p, plain)
    except Py4JJavaError as e:
        fs.delete(temp, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to a shared folder and read back, so that its users see the same rows."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Removes the folder that ``staged`` has written for ``df``; its rows must not be read any more."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(df.sparkSession, folder)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, local only where none is set.

    The application's own folder there is removed when its driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/staged-{spark.sparkContext.applicationId}"
    fs, p = _fs(spark, own)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{own}/{label}-{uuid.uuid4().hex[:12]}"
