"""Change data: forward changes, deletes, lineage columns and fan-out to targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..table.versioned import CHANGE_COLUMNS, VersionedTable


@dataclass(frozen=True)
class Target:
    table: VersionedTable
    condition: str | None = None


def forward_changes(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_change_type").isin("insert", "update_postimage"))


def deletes(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_change_type") == "delete")


def strip_change_columns(df: DataFrame) -> DataFrame:
    return df.drop(*CHANGE_COLUMNS)


def add_lineage(df: DataFrame, source: str) -> DataFrame:
    return df.withColumns({"_cdc_source_table": F.lit(source), "_cdc_propagated_at": F.current_timestamp()})


def fan_out(df: DataFrame, targets: list[Target], source: str, txn: tuple[str, int] | None = None) -> dict[str, int]:
    """Append the rows that each target wants to it; returns rows by target. Targets that want none are left alone, but made if they aren't there, so that they can be read; a batch that a target has had isn't appended again."""
    stamped = add_lineage(df, source).persist()
    try:
        flags = [F.count(F.when(F.coalesce(F.expr(t.condition), F.lit(False)) if t.condition else F.lit(True), 1)).alias(f"n{i}") for i, t in enumerate(targets)]
        counts = stamped.agg(*flags).first() if targets else []
        out = {}
        for t, n in zip(targets, counts, strict=True):
            out[t.table.name] = n
            if n or not t.table.exists():
                t.table.append(stamped.filter(t.condition) if t.condition else stamped, txn=(f"{txn[0]}:{t.table.name}", txn[1]) if txn else None)
        return out
    finally:
        stamped.unpersist()


def run_batch(source: VersionedTable, targets: list[Target], start: int, end: int | None = None) -> dict:
    """Propagate the changes of versions start to end."""
    changes = source.changes(start, end)
    by_type = {r["_change_type"]: r["count"] for r in changes.groupBy("_change_type").count().collect()}
    last = source.latest_version() if end is None else end
    written = fan_out(strip_change_columns(forward_changes(changes)), targets, source.name, (f"cdc:{source.name}:{start}", last))
    return {"source_table": source.name, "starting_version": start, "ending_version": last, "total_changes": sum(by_type.values()), "forward_changes": by_type.get("insert", 0) + by_type.get("update_postimage", 0), "deletes": by_type.get("delete", 0), "targets": written}


def apply_changes(changes: DataFrame, target: VersionedTable, keys: list[str]) -> None:
    """Upsert the latest forward change of each key and delete the keys whose last change is a delete."""
    from .layers import keep_latest

    rank = F.when(F.col("_change_type") == "delete", 0).when(F.col("_change_type") == "insert", 1).otherwise(2)  # a key that a merge moved comes last in its version
    last = keep_latest(changes.filter("_change_type <> 'update_preimage'").withColumn("__rank2", rank), keys, "_commit_version", ["__rank2"]).drop("__rank2").persist()
    gone = deletes(last).select(*keys)
    if target.exists() and not gone.isEmpty():
        rows = target.read()
        target.overwrite(rows.join(gone, keys, "left_anti").select(*rows.columns))
    fresh = strip_change_columns(forward_changes(last))
    if not fresh.isEmpty():
        target.merge(fresh, keys)
    last.unpersist()
