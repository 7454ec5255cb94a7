"""The model chain: staging -> sessions -> daily mart, each a DataFrame plan that Catalyst sees whole."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..table.versioned import VersionedTable

#: Far below a cent: makes an average that ends in half a cent round up in whatever order it was summed.
NUDGE = 1e-9
AUDIT = ("_ingested_at", "_source_path", "_batch_id", "_record_hash")


def _time(t: datetime):
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def stage_events(raw: DataFrame, as_of: datetime) -> DataFrame:
    """Typed, cleaned events from raw text columns; rows without keys, more than an hour after as_of or over a year before it are left out."""
    typed = raw.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), F.col("session_id").cast("string").alias("session_id"),
        F.to_utc_timestamp(F.try_to_timestamp("event_ts", F.lit("yyyy-MM-dd'T'HH:mm:ss")), "UTC").alias("event_ts"),
        F.lower(F.trim("event_type")).alias("event_type"), F.lower(F.trim("product_line")).alias("product_line"),
        F.coalesce(F.col("revenue_amount").try_cast("double"), F.lit(0.0)).alias("revenue_amount"), E.parse_flag(F.col("is_paid")).alias("is_paid"), F.col("metadata").alias("raw_metadata"),
        *[c for c in AUDIT if c in raw.columns],
    )
    year_ago = F.add_months(_time(as_of), -12)
    return typed.filter(F.col("event_id").isNotNull() & F.col("user_id").isNotNull() & F.col("event_ts").isNotNull() & (F.col("event_ts") <= _time(as_of + timedelta(hours=1))) & (F.col("event_ts") >= year_ago))


def sessions(events: DataFrame, as_of: datetime | None = None, lookback_days: int = 3, incremental: bool = False, literal: bool = False, stamp: bool = True) -> DataFrame:
    """One row a session and user. incremental: sessions touched in the lookback before as_of, with all their events; literal: with only the events of the lookback.

    Revenue is added up event by event, in the order of event_id: a sum of doubles
    hangs on its order, and one a hair below a tier's bound is another row than one at it.
    """
    if incremental or literal:
        recent = events.filter(F.col("event_ts") >= _time(as_of - timedelta(days=lookback_days)))
        events = recent if literal else events.join(recent.select("session_id").distinct(), "session_id", "left_semi")
    bounds = events.groupBy("session_id", "user_id").agg(
        F.to_date(F.min("event_ts")).alias("session_date"), F.min("event_ts").alias("session_start_ts"), F.max("event_ts").alias("session_end_ts"),
        F.count("event_id").alias("total_events"), F.countDistinct("event_type").alias("unique_event_types"),
    )
    place = Window.partitionBy("session_id").orderBy("event_id", "event_ts", "revenue_amount")
    so_far = F.sum("revenue_amount").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = events.filter(F.col("session_id").isNotNull()).withColumns({"revenue_so_far": so_far, "place": F.row_number().over(place)})
    money = summed.groupBy("session_id").agg(F.max_by("revenue_so_far", "place").alias("session_revenue"), F.max(F.col("is_paid").cast("int")).alias("paid"), F.collect_set("product_line").alias("product_lines_touched"))
    out = bounds.join(money, "session_id", "left").select(
        "session_id", "user_id", "session_date", "session_start_ts", "session_end_ts", (F.unix_timestamp("session_end_ts") - F.unix_timestamp("session_start_ts")).alias("duration_seconds"),
        "total_events", "unique_event_types", "session_revenue", (F.col("paid") == 1).alias("had_payment"), "product_lines_touched", F.size("product_lines_touched").alias("product_lines_count"),
        E.engagement_tier(F.col("total_events")).alias("engagement_tier"), E.session_revenue_tier(F.col("session_revenue")).alias("revenue_tier"),
    )
    return out.withColumn("_int_processed_at", F.current_timestamp()) if stamp else out


def daily_mart(sess: DataFrame, run_id: str | None = None, accuracy: int = 1_000_000, by_days: bool = False) -> DataFrame:
    """By day, revenue tier and engagement tier, with rolling sums by revenue tier over 30 and 7 rows (by_days: calendar days). Rows of one day are ordered by engagement tier."""
    p = lambda c, q: F.percentile_approx(c, q, accuracy)
    n, paying = F.countDistinct("session_id"), F.count(F.when(F.col("had_payment"), 1))
    agg = sess.groupBy(F.col("session_date").alias("metric_date"), "revenue_tier", "engagement_tier").agg(
        n.alias("unique_sessions"), F.countDistinct("user_id").alias("unique_users"),
        E.round_scaled(F.avg("duration_seconds"), 2).alias("avg_session_duration_seconds"), E.round_scaled(F.avg("total_events"), 2).alias("avg_events_per_session"), E.round_scaled(F.avg("product_lines_count"), 2).alias("avg_products_per_session"),
        F.round(F.sum("session_revenue"), 2).alias("gross_revenue"), E.round_scaled(F.avg("session_revenue") + NUDGE, 2).alias("avg_revenue_per_session"), paying.alias("paying_sessions"),
        E.round_scaled(paying / F.nullif(n, F.lit(0)) * 100, 2).alias("conversion_rate_pct"),
        p("session_revenue", 0.5).alias("p50_revenue"), p("session_revenue", 0.9).alias("p90_revenue"), p("session_revenue", 0.99).alias("p99_revenue"), p("duration_seconds", 0.5).alias("p50_duration_seconds"),
    )
    by_tier = Window.partitionBy("revenue_tier")
    if by_days:
        day = by_tier.orderBy(F.datediff("metric_date", F.lit("1970-01-01").cast("date")))
        w30, w7 = day.rangeBetween(-29, 0), day.rangeBetween(-6, 0)
    else:
        rows = by_tier.orderBy("metric_date", "engagement_tier")
        w30, w7 = rows.rowsBetween(-29, 0), rows.rowsBetween(-6, 0)
    out = agg.withColumns({"event_type": F.lit("all"), "rolling_30d_revenue": F.round(F.sum("gross_revenue").over(w30), 2), "rolling_7d_sessions": F.sum("unique_sessions").over(w7)})
    return out.withColumns({"_mart_processed_at": F.current_timestamp(), "_dbt_invocation_id": F.lit(run_id)}) if run_id is not None else out


def run_models(raw: DataFrame, sessions_table: VersionedTable, mart_table: VersionedTable, as_of: datetime, run_id: str = "manual") -> dict[str, int]:
    """Refresh both tables: sessions are merged by their key, the mart replaces the days that it has rows for."""
    staged = stage_events(raw, as_of)
    first = not sessions_table.exists()
    sessions_table.merge(sessions(staged, as_of, incremental=not first), ["session_id", "user_id"])
    days = sessions_table.read()
    if not first:
        days = days.filter(F.col("session_date") >= F.lit((as_of - timedelta(days=3)).date()))
    mart_table.overwrite_partitions(daily_mart(days, run_id), "metric_date")
    return {"sessions_version": sessions_table.latest_version(), "mart_version": mart_table.latest_version()}
