"""Message streams: reading a bus, decoding, filtering events, writing to Bronze."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.contract import widened_schema
from ..sources import storage
from .ingest import batch_writer

#: Fixed value: the columns that Spark's Kafka source has.
MESSAGE_SCHEMA = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"


def kafka_options(servers: str, topic: str, **more: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "false"} | more


def read_messages(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A stream from the bus; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**options).load()


def decode_messages(df: DataFrame, run_ts: Column | None = None, stamped: bool = True) -> DataFrame:
    """Payload as text and delivery columns as ``kafka_*``; parsing is left to Silver."""
    out = df.select(  # fixed values: the names that readers of the table expect
        F.col("value").cast("string").alias("event_json"), F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_enqueued_at"),
    )
    ts = F.current_timestamp() if run_ts is None else run_ts
    return out.withColumns({"_ingested_at": ts, "_load_date": F.to_date(ts)}) if stamped else out


def keep_edits(df: DataFrame, json_col: str = "event_json") -> DataFrame:
    """Events of type ``edit`` outside the canary domain, unchanged; batch or stream.

    Malformed JSON, values other than objects, and a ``meta`` that is not an
    object are dropped; a missing ``meta`` passes.
    """

    def is_edit(event: Column) -> Column:
        meta = F.try_variant_get(event, "$.meta", "variant")
        meta_fits = meta.isNull() | F.schema_of_variant(meta).startswith("OBJECT")
        outside = ~F.coalesce(F.try_variant_get(event, "$.meta.domain", "string") == "canary", F.lit(False))
        return F.schema_of_variant(event).startswith("OBJECT") & meta_fits & (F.try_variant_get(event, "$.type", "string") == "edit") & outside

    parsed = F.array(F.try_parse_json(F.col(json_col)))  # as the variable of a lambda it is parsed once
    return df.where(F.coalesce(F.exists(parsed, is_edit), F.lit(False)))


def table_schema(spark: SparkSession, table: str) -> StructType | None:
    """The columns of all batches written so far; null before the first."""
    text = storage.read_text(spark, f"{table}/_schema.json")
    return StructType.fromJson(json.loads(text)) if text else None


def stream_to_table(df: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream holds now to Parquet, batch by batch; a batch that runs again replaces itself.

    Columns that the table does not have yet are added to its schema, and read
    as null in older batches; columns that ``df`` lacks are null in its rows. A
    column of another type ends the stream before anything is written.
    """

    def merged(batch: DataFrame, _: int) -> DataFrame:
        known = table_schema(batch.sparkSession, table)
        schema = batch.schema if known is None else widened_schema(known, batch.schema)
        if schema != known:
            storage.write_text(batch.sparkSession, f"{table}/_schema.json", schema.json())
        return batch

    writer = df.writeStream.outputMode("append").foreachBatch(batch_writer(table, merged)).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_stream_table(spark: SparkSession, table: str, schema: StructType | str | None = None) -> DataFrame:
    """The table's rows, in the columns of ``schema``: all that its batches have, unless it is given."""
    known = schema or table_schema(spark, table)
    if known is None:
        raise LookupError(f"{table} has no batch yet")
    fields = StructType.fromDDL(known) if isinstance(known, str) else known
    full = StructType(list(fields)).add("_ckpt", "string").add("_batch", "string")
    return spark.read.schema(full).parquet(table).drop("_ckpt", "_batch")
