"""File and message sources: schema inference, permissive reads, streams, Kafka options and row shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
KAFKA_ROW = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"


@dataclass(frozen=True)
class KafkaConfig:
    bootstrap_servers: str
    topic: str
    checkpoint_location: str
    output_table: str
    starting_offsets: str = "latest"
    max_offsets_per_trigger: int = 100_000
    kafka_group_id: str = "lodestone"
    watermark_delay: str = "10 minutes"
    trigger_interval: str = "1 minute"
    dlq_table: str | None = None

    @property
    def dead_letter_table(self) -> str:
        return self.dlq_table or f"{self.output_table}_dlq"


def kafka_read_options(c: KafkaConfig) -> dict[str, str]:
    return {"kafka.bootstrap.servers": c.bootstrap_servers, "subscribe": c.topic, "startingOffsets": c.starting_offsets, "maxOffsetsPerTrigger": str(c.max_offsets_per_trigger), "kafka.group.id": c.kafka_group_id, "failOnDataLoss": "false"}


def stream_write_options(c: KafkaConfig) -> dict[str, str]:
    if not c.checkpoint_location.strip():
        raise ValueError("checkpoint_location must not be empty: a stream without one loses its place")
    return {"checkpointLocation": c.checkpoint_location, "mergeSchema": "true"}


def kafka_stream(spark: SparkSession, c: KafkaConfig) -> DataFrame:
    """The topic as a stream; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_read_options(c)).load()


def message_files(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A folder of Parquet files in the Kafka row shape as a stream."""
    return spark.readStream.schema(KAFKA_ROW).option("maxFilesPerTrigger", max_files).parquet(path)


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "json", max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(kind).load(path)


def infer_schema(spark: SparkSession, path: str | list[str], kind: str = "json", ratio: float = 0.1) -> T.StructType:
    """The schema of a sample; an empty source is an error."""
    reader = spark.read.format(kind)
    df = reader.option("samplingRatio", ratio).load(path) if kind == "json" else reader.option("header", "true").option("inferSchema", "true").load(path) if kind == "csv" else reader.load(path)
    if df.isEmpty():
        raise ValueError(f"no rows at {path} to infer a schema from")
    return T.StructType([f for f in df.schema.fields if f.name != CORRUPT])


def read_permissive(spark: SparkSession, path: str | list[str], schema: T.StructType, kind: str = "json") -> DataFrame:
    """All records; what doesn't parse has its text in _corrupt_record, which is always a column."""
    with_corrupt = T.StructType([*[f for f in schema.fields if f.name != CORRUPT], T.StructField(CORRUPT, T.StringType())])
    if kind not in ("json", "csv"):
        return spark.read.format(kind).load(path).withColumn(CORRUPT, F.lit(None).cast("string"))
    return spark.read.schema(with_corrupt).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).format(kind).load(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def generated_events(spark: SparkSession, rows: int, users: int = 1_000_000, days: int = 365, seed: int = 7, start: str = "2024-01-01") -> DataFrame:
    """Random events for benchmarks, alike for equal seeds."""
    kinds = F.array(*[F.lit(k) for k in ("page_view", "click", "purchase", "signup")])
    return spark.range(rows).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"), F.concat(F.lit("user_"), F.floor(F.rand(seed) * users).cast("string")).alias("user_id"),
        F.date_add(F.lit(start).cast("date"), F.floor(F.rand(seed + 1) * days).cast("int")).alias("event_date"), F.get(kinds, F.floor(F.rand(seed + 2) * 4).cast("int")).alias("event_type"), (F.rand(seed + 3) * 1000).alias("revenue_amount"),
    )
