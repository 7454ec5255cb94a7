"""Registered queries for the engine's own operators, each beside SQL that gives the same rows."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import expr as E
from .operators import cdc, dlq, layers, quality
from .plans import models
from .sources.adapter import load_events, with_session_duration
from .streaming import monitor, streams
from .table.versioned import VersionedTable

AS_OF = datetime(2024, 1, 31)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _table(spark: SparkSession, name: str) -> VersionedTable:
    """A fresh table in the session's shared folder."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodestone-")
    return VersionedTable(spark, f"{root}/tables-{uuid.uuid4().hex}", name)


# SQL of the canonical events, as sources.adapter makes them
CANON = """ev AS (SELECT event_id, user_id, event_type, ts AS event_ts, concat_ws('-', CAST(user_id AS VARCHAR), strftime(ts, '%Y%m%d')) AS session_id, value AS revenue_amount,
 'pl_' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS product_line, event_type = 'purchase' AS is_paid, props AS metadata FROM events)"""


# --- gold


@query(f"""WITH {CANON} SELECT CAST(event_ts AS DATE) AS event_date, CASE WHEN revenue_amount >= 1000 THEN 'enterprise' WHEN revenue_amount >= 100 THEN 'mid_market' ELSE 'smb' END AS revenue_tier, product_line,
 round(sum(revenue_amount), 4) AS gross_revenue, count(*) AS transaction_count, round(avg(revenue_amount), 4) AS avg_transaction_value, quantile_disc(revenue_amount, 0.5) AS median_transaction_value, quantile_disc(revenue_amount, 0.95) AS p95_transaction_value
 FROM ev GROUP BY ALL""")
def gold_revenue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(layers.revenue_summary(load_events(spark, sf_dir), stamp=False), "gross_revenue", "avg_transaction_value")


@query(f"""WITH {CANON}, x AS (SELECT *, floor(epoch(max(event_ts) OVER (PARTITION BY session_id)))::BIGINT - floor(epoch(min(event_ts) OVER (PARTITION BY session_id)))::BIGINT AS secs FROM ev)
 SELECT CAST(event_ts AS DATE) AS event_date, user_id, event_type, count(*) AS event_count, round(sum(revenue_amount), 4) AS total_revenue, round(avg(secs), 4) AS avg_session_duration_seconds,
 count(DISTINCT session_id) AS unique_sessions, min(event_ts) AS first_event_ts, max(event_ts) AS last_event_ts FROM x GROUP BY ALL""")
def gold_daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(_rounded(layers.daily_metrics(with_session_duration(load_events(spark, sf_dir)), stamp=False), "total_revenue", "avg_session_duration_seconds"), "first_event_ts", "last_event_ts")


@query(f"""WITH {CANON}, f AS (SELECT user_id, CAST(min(event_ts) AS DATE) AS acquisition_date FROM ev GROUP BY 1), j AS (SELECT ev.*, acquisition_date, date_diff('day', acquisition_date, CAST(event_ts AS DATE)) AS d FROM ev LEFT JOIN f USING (user_id))
 SELECT acquisition_date, CASE WHEN d = 0 THEN 'day_0' WHEN d BETWEEN 1 AND 7 THEN 'day_1_7' WHEN d BETWEEN 8 AND 30 THEN 'day_8_30' ELSE 'day_30_plus' END AS cohort_bucket,
 count(DISTINCT user_id) AS unique_users, round(sum(revenue_amount), 4) AS cohort_revenue FROM j GROUP BY ALL""")
def gold_user_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(layers.user_cohorts(load_events(spark, sf_dir), stamp=False), "cohort_revenue")


# --- models

RAW = """raw AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS event_id, CAST(user_id AS VARCHAR) AS user_id, concat_ws('-', CAST(user_id AS VARCHAR), strftime(ts, '%Y%m%d')) AS session_id,
 CASE WHEN event_id % 11 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS event_ts, CASE WHEN event_id % 3 = 0 THEN '  ' || upper(event_type) || ' ' ELSE event_type END AS event_type, ' PL_' || CAST(event_id % 5 AS VARCHAR) AS product_line,
 CASE WHEN event_id % 13 = 0 THEN 'x' ELSE CAST(CAST(value * 100 AS BIGINT) / 100.0 AS VARCHAR) END AS revenue_amount, list_element(['true', 'Yes', '1', 'no', '0', 'FALSE', 'other'], CAST(event_id % 7 AS INTEGER) + 1) AS is_paid, props AS metadata FROM events)"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as untyped, untidy text, made by rule from the events table."""
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    return e.select(
        F.when(i % 7 != 0, i.cast("string")).alias("event_id"), F.col("user_id").cast("string").alias("user_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.when(i % 11 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("event_ts"), F.when(i % 3 == 0, F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).otherwise(F.col("event_type")).alias("event_type"),
        F.concat(F.lit(" PL_"), (i % 5).cast("string")).alias("product_line"), F.when(i % 13 == 0, "x").otherwise((F.round(F.col("value") * 100).cast("bigint") / 100.0).cast("string")).alias("revenue_amount"),
        F.get(F.array(*[F.lit(x) for x in ("true", "Yes", "1", "no", "0", "FALSE", "other")]), (i % 7).cast("int")).alias("is_paid"), F.col("props").alias("metadata"),
    )


@query(f"""WITH {RAW} SELECT event_id, user_id, session_id, try_strptime(event_ts, '%Y-%m-%dT%H:%M:%S') AS event_ts, lower(trim(event_type)) AS event_type, lower(trim(product_line)) AS product_line,
 coalesce(try_cast(revenue_amount AS DOUBLE), 0.0) AS revenue_amount, CASE WHEN lower(trim(is_paid)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(is_paid)) IN ('false', '0', 'no') THEN false END AS is_paid, metadata AS raw_metadata
 FROM raw WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND try_strptime(event_ts, '%Y-%m-%dT%H:%M:%S') <= TIMESTAMP '2024-01-31 01:00:00' AND try_strptime(event_ts, '%Y-%m-%dT%H:%M:%S') >= TIMESTAMP '2023-01-31'""")
def stg_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(models.stage_events(raw_events(spark, sf_dir), AS_OF), "event_ts")


def _sessions_sql(source: str) -> str:
    return f"""b AS (SELECT session_id, user_id, CAST(min(event_ts) AS DATE) AS session_date, min(event_ts) AS session_start_ts, max(event_ts) AS session_end_ts, count(event_id) AS total_events, count(DISTINCT event_type) AS unique_event_types FROM {source} GROUP BY 1, 2),
 m AS (SELECT session_id, sum(revenue_amount) AS session_revenue, max(CAST(is_paid AS INTEGER)) AS paid, count(DISTINCT product_line) AS product_lines_count FROM {source} GROUP BY 1),
 s AS (SELECT b.*, floor(epoch(session_end_ts))::BIGINT - floor(epoch(session_start_ts))::BIGINT AS duration_seconds, session_revenue, paid = 1 AS had_payment, product_lines_count,
 CASE WHEN total_events >= 50 THEN 'power_user' WHEN total_events >= 20 THEN 'engaged' WHEN total_events >= 5 THEN 'casual' ELSE 'bounced' END AS engagement_tier,
 CASE WHEN session_revenue >= 1000 THEN 'enterprise' WHEN session_revenue >= 100 THEN 'mid_market' WHEN session_revenue > 0 THEN 'smb' ELSE 'free' END AS revenue_tier FROM b LEFT JOIN m USING (session_id))"""


SESSION_COLUMNS = "session_id, user_id, session_date, session_start_ts, session_end_ts, duration_seconds, total_events, unique_event_types, round(session_revenue, 4) AS session_revenue, had_payment, CAST(product_lines_count AS INTEGER) AS product_lines_count, engagement_tier, revenue_tier"


def _session_output(df: DataFrame) -> DataFrame:
    return _naive(_rounded(df.drop("product_lines_touched"), "session_revenue"), "session_start_ts", "session_end_ts")


@query(f"WITH {CANON}, {_sessions_sql('ev')} SELECT {SESSION_COLUMNS} FROM s")
def int_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_output(models.sessions(load_events(spark, sf_dir), stamp=False))


@query(f"WITH {CANON}, t AS (SELECT * FROM ev WHERE session_id IN (SELECT session_id FROM ev WHERE event_ts >= TIMESTAMP '2024-01-28')), {_sessions_sql('t')} SELECT {SESSION_COLUMNS} FROM s")
def int_sessions_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_output(models.sessions(load_events(spark, sf_dir), AS_OF, incremental=True, stamp=False))


@query(f"""WITH {CANON}, {_sessions_sql("ev")}, a AS (SELECT session_date AS metric_date, 'all' AS event_type, revenue_tier, engagement_tier, count(DISTINCT session_id) AS unique_sessions, count(DISTINCT user_id) AS unique_users,
 round(avg(duration_seconds), 2) AS avg_session_duration_seconds, round(avg(total_events), 2) AS avg_events_per_session, round(avg(product_lines_count), 2) AS avg_products_per_session, round(sum(session_revenue), 2) AS gross_revenue, round(avg(session_revenue) + 1e-9, 2) AS avg_revenue_per_session,
 count(CASE WHEN had_payment THEN 1 END) AS paying_sessions, round(count(CASE WHEN had_payment THEN 1 END) / nullif(count(DISTINCT session_id), 0) * 100, 2) AS conversion_rate_pct,
 round(quantile_disc(session_revenue, 0.5), 4) AS p50_revenue, round(quantile_disc(session_revenue, 0.9), 4) AS p90_revenue, round(quantile_disc(session_revenue, 0.99), 4) AS p99_revenue, quantile_disc(duration_seconds, 0.5) AS p50_duration_seconds FROM s GROUP BY 1, 3, 4)
 SELECT *, round(sum(gross_revenue) OVER (PARTITION BY revenue_tier ORDER BY metric_date, engagement_tier ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 2) AS rolling_30d_revenue,
 CAST(sum(unique_sessions) OVER (PARTITION BY revenue_tier ORDER BY metric_date, engagement_tier ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_7d_sessions FROM a""")
def mart_daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.daily_mart(models.sessions(load_events(spark, sf_dir), stamp=False)), "p50_revenue", "p90_revenue", "p99_revenue")


# --- silver

DOUBLED = "d AS (SELECT event_id, user_id, event_type, ts, value FROM events UNION ALL SELECT event_id, user_id, event_type, ts + INTERVAL 1 HOUR, value + 1 FROM events WHERE event_id % 10 = 0)"


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts", "value")
    return e.unionByName(e.filter("event_id % 10 = 0").withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 HOUR"), "value": F.col("value") + 1}))


@query(f"WITH {DOUBLED} SELECT event_id, user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, value DESC) AS r FROM d) WHERE r = 1")
def dedup_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.keep_latest(_doubled(spark, sf_dir), "event_id", "ts", ["value"])


UNTYPED = """u AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 9 = 0 THEN 'none' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_ts, CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE CAST(event_id % 100 AS VARCHAR) END AS item_count,
 CASE WHEN event_id % 6 = 0 THEN 'bad' ELSE CAST(event_id % 50 AS VARCHAR) || '.5' END AS sale_amount, CAST(event_id % 8 AS VARCHAR) AS box_qty FROM events)"""


@query(f"WITH {UNTYPED} SELECT event_id, try_cast(event_ts AS TIMESTAMP) AS event_ts, try_cast(item_count AS BIGINT) AS item_count, try_cast(sale_amount AS DOUBLE) AS sale_amount, try_cast(box_qty AS INTEGER) AS box_qty FROM u")
def auto_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        i.alias("event_id"), F.when(i % 9 == 0, "none").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("event_ts"), F.when(i % 4 == 0, "n/a").otherwise((i % 100).cast("string")).alias("item_count"),
        F.when(i % 6 == 0, "bad").otherwise(F.concat((i % 50).cast("string"), F.lit(".5"))).alias("sale_amount"), (i % 8).cast("string").alias("box_qty"),
    )
    return _naive(E.auto_cast(u), "event_ts")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE lower(event_type) END AS event_type FROM events")
def normalize_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return E.normalize_strings(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(i % 5 == 0, "   ").otherwise(F.concat(F.lit(" "), F.upper("event_type"), F.lit("  "))).alias("event_type")))


_KEY = "concat_ws('||', coalesce(CAST(user_id AS VARCHAR), ''), coalesce(event_type, ''))"


@query(f"SELECT event_id, md5({_KEY}) AS key FROM events")
def surrogate_key_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", E.surrogate_key("user_id", "event_type").alias("key"))


@query(f"SELECT event_id, sha256({_KEY}) AS key FROM events")
def surrogate_key_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", E.surrogate_key_sha256("user_id", "event_type").alias("key"))


@query("SELECT event_id, md5(concat_ws('||', CAST(user_id AS VARCHAR), event_type, strftime(ts, '%Y-%m-%d'))) AS key FROM events")
def partitioned_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts")).select("event_id", E.partitioned_key(["user_id", "event_type"], "day").alias("key"))


# --- splits and dead letters

HOLED = "h AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id, event_type, value FROM events)"


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(i % 7 != 0, i).alias("event_id"), F.when(i % 5 != 0, F.col("user_id")).alias("user_id"), "event_type", "value")


@query(f"WITH {HOLED} SELECT * FROM h WHERE event_id IS NOT NULL AND user_id IS NOT NULL")
def split_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.split_good_bad(_holed(spark, sf_dir), ["event_id", "user_id"])[0]


@query(f"WITH {HOLED} SELECT *, 'NULL_REQUIRED_FIELD' AS dlq_reason FROM h WHERE event_id IS NULL OR user_id IS NULL")
def split_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.split_good_bad(_holed(spark, sf_dir), ["event_id", "user_id"])[1].drop("dlq_at")


@query(f"WITH {HOLED} SELECT reason, count(*) AS records FROM (SELECT CASE WHEN event_id IS NULL OR user_id IS NULL THEN 'NULL_REQUIRED_FIELDS:' || concat_ws(',', CASE WHEN event_id IS NULL THEN 'event_id' END, CASE WHEN user_id IS NULL THEN 'user_id' END) END AS reason FROM h) GROUP BY 1")
def dlq_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _holed(spark, sf_dir)
    return h.select(dlq.classify(["event_id", "user_id"], h.columns).alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))


@query(f"WITH {HOLED} SELECT 'QUARANTINED' AS dlq_status, CASE WHEN event_id IS NULL THEN 'NO_EVENT' ELSE 'NO_USER' END AS dlq_reason, count(*) AS records FROM h WHERE event_id IS NULL OR user_id IS NULL GROUP BY ALL")
def dlq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _holed(spark, sf_dir)
    return dlq.stats(dlq.quarantine(h.filter("event_id IS NULL"), "NO_EVENT", "events").unionByName(dlq.quarantine(h.filter("event_id IS NOT NULL AND user_id IS NULL"), "NO_USER", "events")))


@query("SELECT event_id, CAST(event_id % 4 AS INTEGER) AS kafka_partition, props AS raw_value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_deserialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    messages = events.select(F.col("props").alias("value"), (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))
    return streams.parse_payload(messages, T.StructType([T.StructField("k", T.LongType())])).select(F.col("kafka_offset").alias("event_id"), "kafka_partition", "raw_value", "k")


@query(f"""WITH {HOLED}, c AS (SELECT count(*) AS total_records, count(*) FILTER (event_id IS NULL OR user_id IS NULL) AS dlq_records FROM h)
 SELECT total_records, dlq_records, round(100 * dlq_records / total_records, 3) AS dlq_rate_pct, CASE WHEN 100 * dlq_records / total_records >= 5 THEN 'CRITICAL' WHEN 100 * dlq_records / total_records >= 1 THEN 'WARN' ELSE 'OK' END AS severity FROM c""")
def dlq_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, bad = _holed(spark, sf_dir).agg(F.count("*"), F.count(F.when(E.any_null(["event_id", "user_id"]), 1))).first()
    rate = dlq.dlq_rate(n, bad)
    names = ("total_records", "dlq_records", "dlq_rate_pct", "severity")
    return spark.createDataFrame([tuple(rate[k] for k in names)], "total_records long, dlq_records long, dlq_rate_pct double, severity string")


@query("""WITH b AS (SELECT event_id FROM events WHERE event_id % 7 = 0) SELECT CASE WHEN event_id % 2 = 0 THEN 'RESOLVED' ELSE 'UNRESOLVABLE' END AS dlq_status, CASE WHEN event_id % 2 = 0 THEN '1' ELSE '2' END AS dlq_reprocess_count,
 count(*) AS records, CAST(count(*) FILTER (event_id % 2 = 0) AS BIGINT) AS landed FROM b GROUP BY ALL""")
def dlq_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tries at dead letters, of which half can be mended."""
    letters, target = _table(spark, "dead"), _table(spark, "mended")
    dlq.write(letters, _events(spark, sf_dir).filter("event_id % 7 = 0"), "events")
    for _ in range(2):
        dlq.reprocess(letters, target, lambda d: d.filter("event_id % 2 = 0"), max_attempts=2)
    landed = target.read().select("event_id").withColumn("in_target", F.lit(1))
    return letters.read().join(landed, "event_id", "left").groupBy("dlq_status", "dlq_reprocess_count").agg(F.count("*").alias("records"), F.count("in_target").alias("landed"))


@query("""SELECT event_id, value * 20 AS amount, CASE WHEN value * 20 >= 1000 THEN 'enterprise' WHEN value * 20 >= 100 THEN 'mid_market' WHEN value * 20 > 0 THEN 'smb' ELSE 'free' END AS session_tier, CASE WHEN value * 20 >= 1000 THEN 'enterprise' WHEN value * 20 >= 100 THEN 'mid_market' ELSE 'smb' END AS transaction_tier,
 CASE WHEN event_id % 80 >= 50 THEN 'power_user' WHEN event_id % 80 >= 20 THEN 'engaged' WHEN event_id % 80 >= 5 THEN 'casual' ELSE 'bounced' END AS engagement, CASE WHEN event_id % 40 = 0 THEN 'day_0' WHEN event_id % 40 <= 7 THEN 'day_1_7' WHEN event_id % 40 <= 30 THEN 'day_8_30' ELSE 'day_30_plus' END AS bucket
 FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END AS value FROM events)""")
def tiers_every_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("value")) * 20
    e = _events(spark, sf_dir).select("event_id", amount.alias("amount"))
    return e.select("event_id", "amount", E.session_revenue_tier(F.col("amount")).alias("session_tier"), E.transaction_revenue_tier(F.col("amount")).alias("transaction_tier"), E.engagement_tier(F.col("event_id") % 80).alias("engagement"), E.cohort_bucket(F.col("event_id") % 40).alias("bucket"))


# --- windows


@query(f"""WITH {CANON} SELECT time_bucket(INTERVAL 5 MINUTE, event_ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 5 MINUTE, event_ts, TIMESTAMP '1970-01-01') + INTERVAL 5 MINUTE AS window_end, event_type, product_line,
 count(*) AS event_count, round(sum(revenue_amount), 4) AS total_revenue, count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions FROM ev GROUP BY ALL""")
def window_tumbling_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(_rounded(streams.window_aggregate(load_events(spark, sf_dir)), "total_revenue"), "window_start", "window_end")


@query(f"""WITH {CANON}, x AS (SELECT ev.*, time_bucket(INTERVAL 1 MINUTE, event_ts, TIMESTAMP '1970-01-01') - INTERVAL 1 MINUTE * k AS window_start FROM ev, range(5) AS r(k))
 SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, event_type, product_line, count(*) AS event_count, round(sum(revenue_amount), 4) AS total_revenue, count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions FROM x GROUP BY ALL""")
def window_sliding_5m_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(_rounded(streams.window_aggregate(load_events(spark, sf_dir), slide="1 minute"), "total_revenue"), "window_start", "window_end")


# --- versioned table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts", "value")


def _history(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """Version 0: two thirds of the events; 1: a merge of changed and new ones; 2: without some."""
    e, t = _events(spark, sf_dir), _table(spark, "events")
    t.append(e.filter("event_id % 3 <> 2"))
    t.merge(e.filter("event_id % 4 = 0 AND event_id % 3 <> 2").withColumn("value", F.col("value") + 100).unionByName(e.filter("event_id % 3 = 2")), "event_id")
    t.delete("event_id % 11 = 0")
    return t


V0 = "v0 AS (SELECT event_id, user_id, event_type, ts, value FROM events WHERE event_id % 3 <> 2)"
V1 = "v1 AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 3 <> 2 AND event_id % 4 = 0 THEN value + 100 ELSE value END AS value FROM events)"


@query(f"WITH {V1} SELECT * FROM v1")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).read(1)


@query(f"WITH {V1} SELECT * FROM v1")
def merge_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = _events(spark, sf_dir), _table(spark, "events")
    change = e.filter("event_id % 4 = 0 AND event_id % 3 <> 2").withColumn("value", F.col("value") + 100).unionByName(e.filter("event_id % 3 = 2"))
    t.append(e.filter("event_id % 3 <> 2"))
    for _ in range(2):
        t.merge(change, "event_id")
    return t.read()


@query(f"WITH {V0} SELECT * FROM v0")
def time_travel_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).read(0)


@query(f"WITH {V1} SELECT * FROM v1")
def restore_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _history(spark, sf_dir)
    t.restore(1)
    return t.read()


@query(f"WITH {V1} SELECT event_id, value, CASE WHEN event_id % 3 = 2 THEN 'insert' ELSE 'update_postimage' END AS _change_type, CAST(1 AS BIGINT) AS _commit_version FROM v1 WHERE event_id % 3 = 2 OR event_id % 4 = 0")
def cdf_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.forward_changes(_history(spark, sf_dir).changes(1, 2)).select("event_id", "value", "_change_type", "_commit_version")


@query(f"WITH {V1} SELECT event_id, value, CAST(2 AS BIGINT) AS _commit_version FROM v1 WHERE event_id % 11 = 0")
def cdf_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.deletes(_history(spark, sf_dir).changes(0)).select("event_id", "value", "_commit_version")


@query(f"WITH {V1}, f AS (SELECT * FROM v1 WHERE event_id % 3 = 2 OR event_id % 4 = 0) SELECT 'big' AS target, event_id, value, 'events' AS _cdc_source_table FROM f WHERE value >= 500 UNION ALL SELECT 'all', event_id, value, 'events' FROM f")
def cdc_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    big, every = _table(spark, "big"), _table(spark, "all")
    cdc.run_batch(_history(spark, sf_dir), [cdc.Target(big, "value >= 500"), cdc.Target(every)], 1)
    pick = lambda t: t.read().select(F.lit(t.name).alias("target"), "event_id", "value", "_cdc_source_table")
    return pick(big).unionByName(pick(every))


@query(f"WITH {V1} SELECT * FROM v1")
def time_travel_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _history(spark, sf_dir)
    return t.read_timestamp(datetime.fromtimestamp(t.commits()[1]["ts"], UTC) + timedelta(microseconds=1))


@query(f"WITH {V0} SELECT * FROM v0")
def restore_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _history(spark, sf_dir)
    t.restore_timestamp(datetime.fromtimestamp(t.commits()[0]["ts"], UTC) + timedelta(microseconds=1))
    return t.read()


@query(f"WITH {V1} SELECT * FROM v1 WHERE event_id % 11 <> 0")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).read()


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'APPEND'), (1, 'MERGE'), (2, 'DELETE')) AS h (version, operation)")
def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).history().select("version", "operation")


@query("SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, event_type, ts, value FROM events")
def widen_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one file from before a column was widened, and of one from after."""
    e, t = _events(spark, sf_dir), _table(spark, "events")
    t.append(e.filter("event_id % 2 = 0"))
    t.enable_type_widening()
    t.widen_column("user_id", "double")
    t.append(e.filter("event_id % 2 = 1"))
    return t.read()


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00.25' AND ts <= TIMESTAMP '2024-01-20 10:30:00.75'")
def range_to_the_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds with fractions of a second, one of them in a zone of its own, over files cut along time."""
    t = _table(spark, "events")
    t.append(_events(spark, sf_dir).repartitionByRange(8, "ts"))
    return t.read(ranges={"ts": (datetime(2024, 1, 10, 0, 0, 0, 250_000, UTC), datetime(2024, 1, 20, 12, 30, 0, 750_000, timezone(timedelta(hours=2))))}).select("event_id", "ts")


@query("SELECT CAST(0 AS BIGINT) AS version_a, CAST(2 AS BIGINT) AS version_b, (SELECT count(*) FROM events WHERE event_id % 3 <> 2) AS rows_a, (SELECT count(*) FROM events WHERE event_id % 11 <> 0) AS rows_b")
def diff_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _history(spark, sf_dir).diff_versions(0, 2)
    return spark.createDataFrame([tuple(d[k] for k in ("version_a", "version_b", "rows_a", "rows_b"))], "version_a long, version_b long, rows_a long, rows_b long")


@query("SELECT event_id, user_id, event_type, ts, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN value + 1 ELSE value END AS value, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-10' OR event_id % 2 = 0")
def insert_overwrite_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = _events(spark, sf_dir).withColumn("day", F.to_date("ts")), _table(spark, "days")
    t.append(e, partition_by=["day"])
    t.overwrite_partitions(e.filter("day = '2024-01-10' AND event_id % 2 = 0").withColumn("value", F.col("value") + 1), "day")
    return t.read()


@query("SELECT event_id, user_id AS customer_id, ts, value, CASE WHEN event_id % 2 = 0 THEN event_id END AS extra FROM events")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column joins with an append, one is renamed and one dropped."""
    e, t = _events(spark, sf_dir), _table(spark, "evolving")
    t.append(e.filter("event_id % 2 = 1"))
    t.append(e.filter("event_id % 2 = 0").withColumn("extra", F.col("event_id")))
    t.enable_column_mapping()
    t.rename_column("user_id", "customer_id")
    t.drop_column("event_type")
    return t.read()


def _clustered(spark: SparkSession, sf_dir: str, zorder: list[str]) -> VersionedTable:
    t = _table(spark, "clustered")
    t.append(_events(spark, sf_dir))
    t.optimize(zorder, files=16)
    return t


@query("SELECT count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id = 7")
def zorder_point_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, ["user_id"]).read(ranges={"user_id": (7, 7)}).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-24'")
def partition_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = _events(spark, sf_dir).withColumn("day", F.to_date("ts")), _table(spark, "days")
    t.append(e, partition_by=["day"])
    return t.read(ranges={"day": (datetime(2024, 1, 24).date(), None)}).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id BETWEEN 7 AND 9 AND value >= 500")
def combined_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, ["user_id", "value"]).read(ranges={"user_id": (7, 9), "value": (500, None)}).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN value * 2 ELSE value END AS value FROM events")
def predicate_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, "updated")
    t.append(_events(spark, sf_dir).drop("ts"))
    t.update("event_id % 5 = 0", {"value": F.col("value") * 2})
    return t.read()


# --- quality


@query(f"WITH {HOLED} SELECT count(*) AS rows, round(avg(CASE WHEN event_id IS NULL THEN 1.0 ELSE 0 END), 6) AS event_id, round(avg(CASE WHEN user_id IS NULL THEN 1.0 ELSE 0 END), 6) AS user_id FROM h")
def gx_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, shares = quality.profile(_holed(spark, sf_dir), ["event_id", "user_id"])
    return spark.createDataFrame([(n, round(shares["event_id"], 6), round(shares["user_id"], 6))], "rows long, event_id double, user_id double")


@query("SELECT event_type, count(*) AS n_records FROM events WHERE event_type NOT IN ('click', 'purchase') GROUP BY 1")
def accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failing_accepted_values(_events(spark, sf_dir), "event_type", ["click", "purchase", None])


@query(f"WITH {DOUBLED} SELECT event_id, count(*) AS n_records FROM d GROUP BY 1 HAVING count(*) > 1")
def unique_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failing_unique(_doubled(spark, sf_dir), "event_id")


@query("SELECT event_id, value FROM events WHERE value < 10 OR value > 500")
def accepted_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failing_accepted_range(_events(spark, sf_dir), "value", 10, 500).select("event_id", "value")


@query(f"WITH {HOLED} SELECT event_type, value FROM h WHERE user_id IS NULL")
def not_null_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failing_not_null(_holed(spark, sf_dir), "user_id").select("event_type", "value")


@query(f"WITH {HOLED} SELECT count(*) >= 100 AS enough_rows, count(*) >= 1000000000 AS far_more, avg(CAST(user_id IS NULL AS INTEGER)) < 0.3 AS few_nulls, avg(CAST(user_id IS NULL AS INTEGER)) < 0.01 AS hardly_any FROM h")
def row_count_and_null_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _holed(spark, sf_dir)
    found = (quality.check_row_count(h, 100), quality.check_row_count(h, 1_000_000_000), quality.check_not_null(h, "user_id", 0.3), quality.check_not_null(h, "user_id"))
    return spark.createDataFrame([found], "enough_rows boolean, far_more boolean, few_nulls boolean, hardly_any boolean")


# --- lag


@query("""WITH l AS (SELECT 'events' AS topic, CAST(user_id % 4 AS INTEGER) AS partition, count(*) AS log_end_offset FROM events GROUP BY ALL), c AS (SELECT 'events' AS topic, CAST(user_id % 4 AS INTEGER) AS partition, count(*) AS done FROM events WHERE event_id < 500 AND user_id % 4 <> 3 GROUP BY ALL)
 SELECT topic, partition, log_end_offset, coalesce(done, 0) AS committed_offset, log_end_offset - coalesce(done, 0) AS lag, CASE WHEN log_end_offset - coalesce(done, 0) >= 2400 THEN 'CRITICAL' WHEN log_end_offset - coalesce(done, 0) >= 2300 THEN 'WARN' ELSE 'OK' END AS severity FROM l LEFT JOIN c USING (topic, partition)""")
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumns({"topic": F.lit("events"), "partition": (F.col("user_id") % 4).cast("int")})
    ends = e.groupBy("topic", "partition").agg(F.count("*").alias("offset"))
    done = e.filter("event_id < 500 AND partition <> 3").groupBy("topic", "partition").agg(F.count("*").alias("offset"))
    return monitor.lag_table(ends, done, monitor.LagLimits(2300, 2400))


@query("""WITH l AS (SELECT CAST(user_id % 4 AS INTEGER) AS partition, count(*) AS n, count(*) FILTER (event_id < 500 AND user_id % 4 <> 3) AS done FROM events GROUP BY ALL)
 SELECT CAST(sum(n - done) AS BIGINT) AS total_lag, max(n - done) AS max_lag, count(*) AS partitions, CASE WHEN max(n - done) >= 2400 THEN 'CRITICAL' WHEN max(n - done) >= 2300 THEN 'WARN' ELSE 'OK' END AS severity FROM l""")
def consumer_lag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("partition", (F.col("user_id") % 4).cast("int"))
    offsets = lambda d: {("events", r["partition"]): r["count"] for r in d.groupBy("partition").count().collect()}
    found = monitor.consumer_lag(offsets(e), offsets(e.filter("event_id < 500 AND partition <> 3")), monitor.LagLimits(2300, 2400)).summary()
    names = ("total_lag", "max_lag", "partitions", "severity")
    return spark.createDataFrame([tuple(found[k] for k in names)], "total_lag long, max_lag long, partitions long, severity string")
