"""Bronze, silver and gold transforms, each DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from ..sources.files import CORRUPT

QUARANTINE_SCHEMA = T.StructType([
    T.StructField("raw_value", T.StringType()), T.StructField("source_path", T.StringType(), False), T.StructField("error_message", T.StringType(), False),
    T.StructField("quarantined_at", T.TimestampType(), False), T.StructField("ingestion_batch_id", T.StringType(), False),
])


# --- bronze


def add_bronze_metadata(df: DataFrame, batch_id: str, source_path: str) -> DataFrame:
    """Audit columns; the hash is over the columns that df came with."""
    return df.withColumns({"_ingested_at": F.current_timestamp(), "_source_path": F.lit(source_path), "_batch_id": F.lit(batch_id), "_record_hash": E.record_hash(df.columns)})


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_records(parsed: DataFrame, batch_id: str, source_path: str, message: str = "record does not match the schema") -> DataFrame:
    """Records that don't parse, in the quarantine's shape."""
    return parsed.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("raw_value"), F.lit(source_path).alias("source_path"), F.lit(message).alias("error_message"), F.current_timestamp().alias("quarantined_at"), F.lit(batch_id).alias("ingestion_batch_id"))


# --- silver


def keep_latest(df: DataFrame, key: str | Sequence[str], order: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row a key: the greatest order, then the greatest tiebreak. One shuffle, on the key."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.col(order).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tiebreak])
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def add_silver_metadata(df: DataFrame) -> DataFrame:
    return df.withColumns({"_silver_processed_at": F.current_timestamp(), "_silver_version": F.lit(1)})


def silver(df: DataFrame, key: str | Sequence[str], order: str, tiebreak: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Deduplicate, cast by suffix, clean strings, stamp."""
    return add_silver_metadata(E.normalize_strings(E.auto_cast(keep_latest(df, key, order, tiebreak)), exclude=exclude))


# --- gold (fixed values: the names of the output columns)


def _gold(df: DataFrame, family: str, stamp: bool) -> DataFrame:
    return df.withColumns({"_gold_processed_at": F.current_timestamp(), "_metric_family": F.lit(family)}) if stamp else df


def daily_metrics(events: DataFrame, stamp: bool = True) -> DataFrame:
    """By day, user and event type. Needs session_duration_seconds."""
    out = events.groupBy(F.to_date("event_ts").alias("event_date"), "user_id", "event_type").agg(
        F.count("*").alias("event_count"), F.sum("revenue_amount").alias("total_revenue"), F.avg("session_duration_seconds").alias("avg_session_duration_seconds"),
        F.countDistinct("session_id").alias("unique_sessions"), F.min("event_ts").alias("first_event_ts"), F.max("event_ts").alias("last_event_ts"),
    )
    return _gold(out, "daily_metrics", stamp)


def user_cohorts(events: DataFrame, stamp: bool = True) -> DataFrame:
    """By day of a user's first event and time since then: users and revenue. The first day comes from an aggregation by user and a join back, which adaptive execution may broadcast or split."""
    first = events.groupBy("user_id").agg(F.to_date(F.min("event_ts")).alias("acquisition_date"))
    days = F.datediff(F.to_date("event_ts"), "acquisition_date")
    out = events.join(first, "user_id", "left").groupBy("acquisition_date", E.cohort_bucket(days).alias("cohort_bucket")).agg(F.countDistinct("user_id").alias("unique_users"), F.sum("revenue_amount").alias("cohort_revenue"))
    return _gold(out, "user_cohorts", stamp)


def revenue_summary(events: DataFrame, stamp: bool = True, accuracy: int = 1_000_000) -> DataFrame:
    """By day, revenue tier and product line."""
    p = lambda q: F.percentile_approx("revenue_amount", q, accuracy)
    out = events.groupBy(F.to_date("event_ts").alias("event_date"), E.transaction_revenue_tier(F.col("revenue_amount")).alias("revenue_tier"), "product_line").agg(
        F.sum("revenue_amount").alias("gross_revenue"), F.count("*").alias("transaction_count"), F.avg("revenue_amount").alias("avg_transaction_value"), p(0.5).alias("median_transaction_value"), p(0.95).alias("p95_transaction_value")
    )
    return _gold(out, "revenue_summary", stamp)


#: Families of gold tables, with what they are partitioned by.
FAMILIES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {"daily_metrics": (daily_metrics, "event_date"), "user_cohorts": (user_cohorts, "acquisition_date"), "revenue_summary": (revenue_summary, "event_date")}


def gold(family: str, events: DataFrame) -> DataFrame:
    if family not in FAMILIES:
        raise ValueError(f"unknown metric family {family!r}; known: {sorted(FAMILIES)}")
    return FAMILIES[family][0](events)


# --- split by required fields


def split_good_bad(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and the others with reason and time; nothing required: all good."""
    bad: Column = E.any_null(required)
    return df.filter(~bad), df.filter(bad).withColumns({"dlq_reason": F.lit("NULL_REQUIRED_FIELD"), "dlq_at": F.current_timestamp()})
