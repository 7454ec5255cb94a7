"""Lag, back-pressure and late-data policy."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E

log = logging.getLogger(__name__)
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


@dataclass(frozen=True)
class LagLimits:
    warn: int = 10_000
    critical: int = 100_000

    def severity(self, lag: int) -> str:
        return "CRITICAL" if lag >= self.critical else "WARN" if lag >= self.warn else "OK"


@dataclass(frozen=True)
class LagReport:
    partitions: dict[tuple[str, int], int]
    limits: LagLimits = field(default_factory=LagLimits)

    @property
    def total(self) -> int:
        return sum(self.partitions.values())

    @property
    def largest(self) -> int:
        return max(self.partitions.values(), default=0)

    def severity(self) -> str:
        return self.limits.severity(self.largest)

    def summary(self) -> dict:
        return {"total_lag": self.total, "max_lag": self.largest, "partitions": len(self.partitions), "severity": self.severity()}


def consumer_lag(log_end: Mapping[tuple[str, int], int], committed: Mapping[tuple[str, int], int], limits: LagLimits = LagLimits()) -> LagReport:
    """Messages not yet consumed, by partition; nothing committed counts as 0, and lag is never negative."""
    return LagReport({p: max(0, end - committed.get(p, 0)) for p, end in log_end.items()}, limits)


def lag_table(log_end: DataFrame, committed: DataFrame, limits: LagLimits = LagLimits()) -> DataFrame:
    """The same over tables (topic, partition, offset)."""
    joined = log_end.join(committed.select("topic", "partition", F.col("offset").alias("done")), ["topic", "partition"], "left")
    out = joined.select("topic", "partition", F.col("offset").alias("log_end_offset"), F.coalesce("done", F.lit(0)).alias("committed_offset"))
    return out.withColumn("lag", F.greatest(F.lit(0), F.col("log_end_offset") - F.col("committed_offset"))).withColumn("severity", E.severity(F.col("lag"), limits.warn, limits.critical))


def run_monitor(log_end: Callable[[], Mapping], committed: Callable[[], Mapping], limits: LagLimits = LagLimits(), every: float = 30.0, max_iterations: int | None = None, sleep: Callable[[float], None] = time.sleep) -> list[LagReport]:
    """Poll offsets and log the lag; a failed poll is logged and the next one made. No wait after the last."""
    out: list[LagReport] = []
    k = 0
    while max_iterations is None or k < max_iterations:
        k += 1
        try:
            report = consumer_lag(log_end(), committed(), limits)
            log.log({"OK": logging.INFO, "WARN": logging.WARNING, "CRITICAL": logging.ERROR}[report.severity()], "lag %s", report.summary())
            out.append(report)
        except Exception:
            log.exception("lag could not be read")
        if max_iterations is None or k < max_iterations:
            sleep(every)
    return out


def detect_backpressure(history: Sequence[Mapping], drop_pct: float = 30.0) -> dict:
    """Whether the processing rate fell by drop_pct or more between the last two batches (mappings with processed_rows_per_second, as in a query's progress)."""
    if len(history) < 2:
        return {"detected": False, "reason": "insufficient_history", "drop_pct": 0.0}
    rate = lambda b: float(b.get("processed_rows_per_second", b.get("processedRowsPerSecond", 0)) or 0)
    before, after = rate(history[-2]), rate(history[-1])
    if before <= 0:
        return {"detected": False, "reason": "zero_previous_rate", "drop_pct": 0.0}
    fell = round(100 * (before - after) / before, 2)
    return {"detected": fell >= drop_pct, "reason": "rate_drop" if fell >= drop_pct else "ok", "drop_pct": fell}


def parse_delay(text: str) -> dict:
    """'10 minutes' as value, unit, total_seconds and spark_string; ValueError for anything else."""
    parts = text.split()
    if len(parts) != 2:
        raise ValueError(f"a delay is a number and a unit, not {text!r}")
    number, unit = parts[0], parts[1].lower().removesuffix("s")
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unknown unit in {text!r}; known: {sorted(UNIT_SECONDS)}")
    if not number.isdigit() or int(number) <= 0:
        raise ValueError(f"a delay needs a whole number above 0, not {number!r}")
    n = int(number)
    return {"value": n, "unit": unit, "total_seconds": n * UNIT_SECONDS[unit], "spark_string": f"{n} {unit}{'s' if n != 1 else ''}"}


def late_data_policy(watermark: str, trigger: str, max_late_minutes: float) -> dict:
    """Warnings if the watermark is shorter than the lateness expected, or than the trigger."""
    w, t = parse_delay(watermark)["total_seconds"], parse_delay(trigger)["total_seconds"]
    warnings = []
    if w < max_late_minutes * 60:
        warnings.append(f"watermark of {w} s is shorter than the expected lateness of {max_late_minutes:g} min: later events are dropped")
    if t > w:
        warnings.append(f"trigger of {t} s is longer than the watermark of {w} s")
    return {"valid": not warnings, "warnings": warnings, "watermark_seconds": w, "trigger_seconds": t}
