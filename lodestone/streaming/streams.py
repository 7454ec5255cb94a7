"""Structured Streaming: watermarks, windows, dead letters, exactly-once sinks and change fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import expr as E
from ..operators import cdc
from ..sources.adapter import EVENT_SCHEMA, REQUIRED
from ..table.versioned import VersionedTable

# The output columns of windows.
WINDOW_KEYS = ("window_start", "window_end", "event_type", "product_line")


def parse_payload(messages: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Message rows with their JSON payload as columns; the text stays as raw_value."""
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return messages.select(
        F.col("value").cast("string").alias("raw_value"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_ts"),
        F.from_json(F.col("value").cast("string"), nullable).alias("payload"),
    ).select("raw_value", "kafka_partition", "kafka_offset", "kafka_ts", "payload.*")


def watermark(df: DataFrame, column: str = "event_ts", delay: str = "10 minutes") -> DataFrame:
    return df.withWatermark(column, delay)


def window_aggregate(df: DataFrame, column: str = "event_ts", size: str = "5 minutes", slide: str | None = None, approximate: bool = False) -> DataFrame:
    """Counts and sums by window, event type and product line: tumbling, or sliding if slide is given. Distinct counts are exact unless approximate."""
    distinct = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.size(F.collect_set(c)).cast("long"))
    out = df.groupBy(F.window(column, size, slide) if slide else F.window(column, size), "event_type", "product_line").agg(
        F.count("*").alias("event_count"), F.sum("revenue_amount").alias("total_revenue"), distinct("user_id").alias("unique_users"), distinct("session_id").alias("unique_sessions")
    )
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "product_line", "event_count", "total_revenue", "unique_users", "unique_sessions")


def split_payload(parsed: DataFrame, required: Sequence[str] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """Good rows without, bad rows with the raw text and a reason."""
    bad = E.any_null(required)
    return parsed.filter(~bad).drop("raw_value"), parsed.filter(bad).select("raw_value", "kafka_partition", "kafka_offset", "kafka_ts", F.lit("NULL_REQUIRED_FIELD").alias("dlq_reason"), F.current_timestamp().alias("dlq_at"))


def append_to(df: DataFrame, table: VersionedTable, checkpoint: str, name: str, **trigger) -> StreamingQuery:
    """Each micro-batch is one commit, once: a batch number that the log has is passed over."""
    write = lambda batch, number: table.append(batch, txn=(name, number)) if not batch.isEmpty() else None
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "1 minute"})).start()


def upsert_to(df: DataFrame, table: VersionedTable, keys: Sequence[str], checkpoint: str, name: str, **trigger) -> StreamingQuery:
    """An update-mode stream merged into a table by its keys."""
    write = lambda batch, number: table.merge(batch, list(keys), txn=(name, number)) if not batch.isEmpty() else None
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(**(trigger or {"processingTime": "1 minute"})).start()


def run_events(messages: DataFrame, windows: VersionedTable, dead: VersionedTable, checkpoint: str, delay: str = "10 minutes", size: str = "5 minutes", slide: str | None = None, **trigger) -> tuple[StreamingQuery, StreamingQuery]:
    """Parse, set bad rows aside, and keep window aggregates up to date: two queries with a checkpoint each."""
    good, bad = split_payload(parse_payload(messages))
    dlq = append_to(bad, dead, f"{checkpoint}_dlq", f"{dead.name}:dlq", **trigger)
    agg = window_aggregate(watermark(good, delay=delay), size=size, slide=slide).withColumns({"event_type": F.coalesce("event_type", F.lit("")), "product_line": F.coalesce("product_line", F.lit(""))})
    return upsert_to(agg, windows, WINDOW_KEYS, checkpoint, f"{windows.name}:agg", **trigger), dlq


def run_raw(messages: DataFrame, table: VersionedTable, dead: VersionedTable, checkpoint: str, required: Sequence[str] = ("raw_value",), delay: str = "10 minutes", **trigger) -> tuple[StreamingQuery, StreamingQuery]:
    """Messages as they come, by their own time; rows without the required columns are set aside."""
    raw = watermark(messages.select(F.col("value").cast("string").alias("raw_value"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_ts")), "kafka_ts", delay)
    bad = E.any_null(required)
    return append_to(raw.filter(~bad), table, checkpoint, f"{table.name}:raw", **trigger), append_to(raw.filter(bad).withColumn("dlq_reason", F.lit("NULL_REQUIRED_FIELD")), dead, f"{checkpoint}_dlq", f"{dead.name}:raw", **trigger)


def run_changes(changes: DataFrame, targets: list[cdc.Target], source: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A change stream fanned out to targets, each micro-batch once."""

    def batch(df: DataFrame, number: int) -> None:
        cdc.fan_out(cdc.strip_change_columns(cdc.forward_changes(df)), targets, source, (f"cdc:{source}", number))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def change_stream(table: VersionedTable, max_files: int = 100) -> DataFrame:
    """The change rows of a table as a stream, without version columns (files come in the order that they are found)."""
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in table.schema().fields], T.StructField("_change_type", T.StringType())])
    return table.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(f"{table.root}/changes")
