"""The batch pipeline: bronze -> silver -> gold over versioned tables, with retries and a report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import layers, quality
from ..sources import files
from ..table.versioned import VersionedTable
from . import governance as G


@dataclass(frozen=True)
class PipelineConfig:
    root: str
    source_path: str
    batch_id: str
    key: str = "event_id"
    order: str = "event_ts"
    kind: str = "json"
    family: str = "revenue_summary"
    zorder: tuple[str, ...] = ()
    gate: quality.GateConfig = quality.GateConfig()
    max_attempts: int = 3


def run_bronze(spark: SparkSession, c: PipelineConfig) -> dict:
    """Read, split, stamp and append; a batch that was written before isn't written again."""
    schema = files.infer_schema(spark, c.source_path, c.kind)
    parsed = files.read_permissive(spark, c.source_path, schema, c.kind).persist()
    try:
        n, bad = parsed.agg(F.count("*").alias("n"), F.count(files.CORRUPT).alias("bad")).first()
        VersionedTable(spark, c.root, "bronze").append(layers.add_bronze_metadata(layers.good_records(parsed), c.batch_id, c.source_path), txn=("bronze", _number(c.batch_id)))
        if bad:
            VersionedTable(spark, c.root, "quarantine").append(layers.bad_records(parsed, c.batch_id, c.source_path), txn=("quarantine", _number(c.batch_id)))
        return {"good_records": n - bad, "bad_records": bad, "batch_id": c.batch_id}
    finally:
        parsed.unpersist()


def run_bronze_stream(spark: SparkSession, c: PipelineConfig, checkpoint: str, max_files: int = 1_000, **trigger):
    """New files of the source as a stream into bronze: types are inferred from each micro-batch, columns that bronze has keep their types, new ones join it.

    The stream only says which files are new (max_files a micro-batch at most);
    they are read as in run_bronze, and records that don't parse are quarantined.
    A micro-batch is one commit under the name of its source, once, also when the
    query is started again from its checkpoint.
    """
    bronze, quarantine = VersionedTable(spark, c.root, "bronze"), VersionedTable(spark, c.root, "quarantine")

    def batch(found, number: int) -> None:
        paths = [r[0] for r in found.distinct().collect()]
        if not paths:
            return
        own = found.sparkSession
        held = {f.name: f for f in bronze.schema().fields} if bronze.exists() else {}
        schema = T.StructType([held.get(f.name, f) for f in files.infer_schema(own, paths, c.kind, ratio=1.0).fields])
        parsed = files.read_permissive(own, paths, schema, c.kind).persist()
        try:
            bad = parsed.agg(F.count(files.CORRUPT)).first()[0]
            bronze.append(layers.add_bronze_metadata(layers.good_records(parsed), c.batch_id, c.source_path), txn=(f"bronze-stream:{c.source_path}", number))
            if bad:
                quarantine.append(layers.bad_records(parsed, c.batch_id, c.source_path), txn=(f"quarantine-stream:{c.source_path}", number))
        finally:
            parsed.unpersist()

    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(c.source_path).select("_metadata.file_path")
    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def _number(batch_id: str) -> int:
    """A batch's name as a number for the log."""
    import zlib

    return int(batch_id) if batch_id.isdigit() else zlib.crc32(batch_id.encode()) + (len(batch_id) << 32)


def run_silver(spark: SparkSession, c: PipelineConfig) -> dict:
    """Deduplicate, clean, check, and merge into silver; nothing is written if a check fails."""
    df = layers.silver(VersionedTable(spark, c.root, "bronze").read(), c.key, c.order, ["_record_hash"], exclude=("event_id", "user_id", "session_id")).persist()
    try:
        result = quality.gate(df, c.gate)
        table = VersionedTable(spark, c.root, "silver")
        table.merge(df, c.key)
        return {"row_count": result.rows, "gx_checks": result.null_shares, "version": table.latest_version()}
    finally:
        df.unpersist()


def run_gold(spark: SparkSession, c: PipelineConfig) -> dict:
    started = time.time()
    table = VersionedTable(spark, c.root, f"gold_{c.family}")
    v = table.overwrite(layers.gold(c.family, VersionedTable(spark, c.root, "silver").read()), [layers.FAMILIES[c.family][1]] if c.family in layers.FAMILIES else [])
    rows = table.commits()[v]["metrics"]["rows"]
    if c.zorder:
        table.optimize(c.zorder)
    return G.track_sla(c.family, started, rows)


def run_pipeline(spark: SparkSession, c: PipelineConfig, sleep: Callable[[float], None] = time.sleep) -> dict:
    """All three stages; the first that fails for good ends the run. The report never hides a failure."""
    report: dict = {"batch_id": c.batch_id, "stages": {}, "status": "SUCCESS"}
    for name, work in (("bronze", run_bronze), ("silver", run_silver), ("gold", run_gold)):
        r = G.run_with_retry(name, lambda f=work: f(spark, c), c.max_attempts, sleep=sleep)
        report["stages"][name] = {"success": r.success, "attempts": r.attempts, "duration_seconds": round(r.duration_seconds, 3), "error": r.error, "result": r.result}
        if not r.success:
            return report | {"status": "FAILED", "failed_stage": name, "error": r.error}
    found = report["stages"]
    return report | {"metrics": G.layer_metrics(found["bronze"]["result"], found["silver"]["result"], found["gold"]["result"])}
