"""Dead letters: quarantine, classification, statistics and reprocessing over a versioned table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..table.versioned import VersionedTable

# The states and the columns of a dead letter.
QUARANTINED, REPROCESSING, RESOLVED, UNRESOLVABLE = "QUARANTINED", "REPROCESSING", "RESOLVED", "UNRESOLVABLE"
COLUMNS = ("dlq_id", "dlq_reason", "dlq_status", "dlq_quarantined_at", "dlq_resolved_at", "dlq_source_table", "dlq_batch_id", "dlq_reprocess_count")


def quarantine(df: DataFrame, reason: str, source_table: str, batch_id: str | None = None) -> DataFrame:
    """Adds the dead letter columns; the count is text by contract."""
    return df.withColumns({
        "dlq_id": F.expr("uuid()"), "dlq_reason": F.lit(reason), "dlq_status": F.lit(QUARANTINED), "dlq_quarantined_at": F.current_timestamp(), "dlq_resolved_at": F.lit(None).cast("timestamp"),
        "dlq_source_table": F.lit(source_table), "dlq_batch_id": F.lit(batch_id or "unknown"), "dlq_reprocess_count": F.lit("0"),
    })


def strip(df: DataFrame) -> DataFrame:
    return df.drop(*COLUMNS)


def classify(required: Sequence[str], columns: Sequence[str]) -> Column:
    """Why a row is bad: missing required fields first, then an unparsed record, else null."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() if c in columns else F.lit(True), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in columns else F.lit(False)
    return F.when(F.size(missing) > 0, F.concat(F.lit("NULL_REQUIRED_FIELDS:"), F.array_join(missing, ","))).when(corrupt, "PARSE_FAILURE")


def classify_record(record: dict, required: Sequence[str]) -> str | None:
    missing = [c for c in required if record.get(c) is None]
    return f"NULL_REQUIRED_FIELDS:{','.join(missing)}" if missing else "PARSE_FAILURE" if record.get("_corrupt_record") else None


def dlq_rate(total: int, bad: int) -> dict:
    if not total:
        return {"dlq_rate_pct": 0.0, "severity": "OK", "message": "no records processed"}
    rate = round(100 * bad / total, 3)
    return {"total_records": total, "dlq_records": bad, "dlq_rate_pct": rate, "severity": "CRITICAL" if rate >= 5 else "WARN" if rate >= 1 else "OK"}


def stats(df: DataFrame) -> DataFrame:
    return df.groupBy("dlq_status", "dlq_reason").agg(F.count("*").alias("records"))


def write(table: VersionedTable, df: DataFrame, source_table: str, reason: str = "PIPELINE_REJECTION", batch_id: str | None = None) -> int:
    rows = quarantine(df, reason, source_table, batch_id)
    if df.isEmpty():
        return 0
    v = table.append(rows)
    return next(c for c in table.commits() if c["version"] == v)["metrics"]["rows"]


@dataclass(frozen=True)
class Reprocessed:
    attempted: int
    resolved: int
    returned: int
    unresolvable: int


def load(table: VersionedTable, max_attempts: int = 3, limit: int | None = None) -> DataFrame:
    """Quarantined rows that have been tried less than max_attempts times, the oldest first."""
    df = table.read().filter((F.col("dlq_status") == QUARANTINED) & (F.col("dlq_reprocess_count").try_cast("int") < max_attempts))
    return df.orderBy("dlq_quarantined_at", "dlq_id").limit(limit) if limit else df


def reprocess(table: VersionedTable, target: VersionedTable, fix: Callable[[DataFrame], DataFrame], max_attempts: int = 3, limit: int | None = None) -> Reprocessed:
    """Run fix over quarantined rows; rows that it returns (it must keep dlq_id) go to target and are resolved, others go back, or for good once they have been tried max_attempts times.

    The rows are pinned to the version that they are read at, so changes of
    status don't change what is being worked on. If fix or the write fails, all
    go back to quarantine with a try counted.
    """
    batch = load(table, max_attempts, limit)
    spark, tried = table.spark, F.col("dlq_reprocess_count").try_cast("int")
    ids = batch.select("dlq_id").persist()
    attempted = ids.count()
    if not attempted:
        ids.unpersist()
        return Reprocessed(0, 0, 0, 0)

    def mark(found: DataFrame, changes: dict[str, Column]) -> None:
        rows = table.read().join(found.select("dlq_id"), "dlq_id", "left_semi")
        table.merge(rows.withColumns(changes), "dlq_id")

    one_more = (tried + 1).cast("string")
    mark(ids, {"dlq_status": F.lit(REPROCESSING), "dlq_reprocess_count": one_more})
    try:
        fixed = fix(batch).persist()
        good = fixed.select("dlq_id").distinct().persist()
        resolved = good.count()
        if resolved:
            target.append(strip(fixed))
    except Exception:
        mark(ids, {"dlq_status": F.lit(QUARANTINED)})
        ids.unpersist()
        raise
    mark(good, {"dlq_status": F.lit(RESOLVED), "dlq_resolved_at": F.current_timestamp()})
    left = ids.join(good, "dlq_id", "left_anti")
    mark(left, {"dlq_status": F.when(tried >= max_attempts, UNRESOLVABLE).otherwise(QUARANTINED)})
    over = table.read().join(left, "dlq_id", "left_semi").filter(F.col("dlq_status") == UNRESOLVABLE).count()
    for d in (fixed, good, ids):
        d.unpersist()
    assert spark is not None
    return Reprocessed(attempted, resolved, attempted - resolved - over, over)
