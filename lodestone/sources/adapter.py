"""The events table in the canonical event shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), False), T.StructField("user_id", T.StringType(), False), T.StructField("event_type", T.StringType(), False), T.StructField("event_ts", T.TimestampType(), False),
    T.StructField("session_id", T.StringType()), T.StructField("revenue_amount", T.DoubleType()), T.StructField("product_line", T.StringType()), T.StructField("is_paid", T.BooleanType()), T.StructField("metadata", T.StringType()),
])
REQUIRED = ("event_id", "user_id", "event_type", "event_ts")
#: Event types that are accepted.
EVENT_TYPES = ("page_view", "click", "purchase", "signup", "logout", "search", "add_to_cart", "checkout_start", "checkout_complete")


def canonical(events: DataFrame) -> DataFrame:
    """event_id, user_id, event_type, event_ts, session_id, revenue_amount, product_line, is_paid, metadata; a narrow projection."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return events.select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("event_ts"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), F.col("value").alias("revenue_amount"),
        F.concat(F.lit("pl_"), (k % 5).cast("string")).alias("product_line"), (F.col("event_type") == "purchase").alias("is_paid"), F.col("props").alias("metadata"),
    )


def with_session_duration(events: DataFrame) -> DataFrame:
    """Adds session_duration_seconds, from the first to the last event of each session."""
    w = Window.partitionBy("session_id")
    return events.withColumn("session_duration_seconds", F.unix_timestamp(F.max("event_ts").over(w)) - F.unix_timestamp(F.min("event_ts").over(w)))


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark.read.parquet(f"{sf_dir}/events.parquet"))
