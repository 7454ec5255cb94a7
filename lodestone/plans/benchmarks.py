"""Layout benchmarks: the same query before and after a table is compacted, clustered or partitioned."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import generated_events
from ..table.versioned import VersionedTable
from . import governance as G


@dataclass(frozen=True)
class Scenario:
    """A table's rows, the column ranges of its query, and how its layout is improved."""

    name: str
    ranges: dict[str, tuple]
    zorder: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    start_files: int = 32
    files: int = 32
    runs: int = 5


@dataclass(frozen=True)
class ScenarioResult:
    name: str
    before: float
    after: float
    improvement_pct: float
    verdict: str
    files_before: tuple[int, int]
    files_after: tuple[int, int]

    @property
    def files(self) -> str:
        return f"{self.files_before[0]}/{self.files_before[1]} -> {self.files_after[0]}/{self.files_after[1]}"


def timed(make: Callable[[], DataFrame], runs: int = 5) -> float:
    """Median seconds to compute all of a query (a noop sink leaves nothing to prune), after one run to warm up."""
    took = []
    for _ in range(runs + 1):
        started = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - started)
    return G.median(took[1:])


def _probe(table: VersionedTable, ranges: dict[str, tuple]) -> DataFrame:
    return table.read(ranges=ranges).agg(F.count("*").alias("n"), F.sum("revenue_amount").alias("total"))


def run_scenario(df: DataFrame, root: str, s: Scenario) -> ScenarioResult:
    """Write df badly laid out, measure, improve, measure again."""
    plain = VersionedTable(df.sparkSession, root, f"{s.name}_plain")
    plain.append(df.repartition(s.start_files))
    before, files_before = timed(lambda: _probe(plain, s.ranges), s.runs), plain.files_scanned(s.ranges)
    better = plain
    if s.partition_by:
        better = VersionedTable(df.sparkSession, root, f"{s.name}_parted")
        better.append(df.repartition(*s.partition_by), partition_by=s.partition_by)
    if s.zorder or not s.partition_by:
        better.optimize([*s.partition_by, *s.zorder] if s.partition_by else s.zorder, files=s.files)
    after = timed(lambda: _probe(better, s.ranges), s.runs)
    pct = G.improvement_pct(before, after)
    return ScenarioResult(s.name, before, after, pct, G.scenario_verdict(pct), files_before, better.files_scanned(s.ranges))


def run_all(spark: SparkSession, root: str, rows: int = 100_000, runs: int = 5) -> tuple[list[ScenarioResult], str]:
    """Point filter, date range, both, and compaction; with a report in Markdown."""
    import datetime

    df = generated_events(spark, rows, users=max(10, rows // 10), days=90)
    day = datetime.date(2024, 3, 24)
    scenarios = [
        Scenario("zorder_user", {"user_id": ("user_7", "user_7")}, ("user_id",), runs=runs), Scenario("partition_date", {"event_date": (day, None)}, partition_by=("event_date",), runs=runs),
        Scenario("date_and_user", {"event_date": (day, None), "user_id": ("user_7", "user_7")}, ("event_date", "user_id"), runs=runs), Scenario("compaction", {}, start_files=64, files=4, runs=runs),
    ]
    found = [run_scenario(df, root, s) for s in scenarios]
    return found, G.markdown_report([{**asdict(r), "files": r.files} for r in found])


def benchmark_zorder(table: VersionedTable, zorder: Sequence[str], ranges: dict[str, tuple], files: int | None = None, runs: int = 3) -> dict:
    """Cluster a table and report what a query over ranges gains."""
    make = lambda: table.read(ranges=ranges)
    before, scanned = timed(make, runs), table.files_scanned(ranges)
    metrics = table.optimize(zorder, files=files)
    after = timed(make, runs)
    pct = G.improvement_pct(before, after)
    return {"table": table.name, "before_seconds": before, "after_seconds": after, "improvement_pct": pct, "verdict": G.benchmark_verdict(pct), "files_scanned_before": scanned, "files_scanned_after": table.files_scanned(ranges), "optimize": metrics}


def optimize_by_partition(table: VersionedTable, column: str, values: Sequence, zorder: Sequence[str] = ()) -> dict:
    """Optimize the files of each partition value by itself; one that fails doesn't stop the others."""
    out: dict = {}
    for v in values:
        try:
            out[v] = table.optimize(zorder, ranges={column: (v, v)})
        except Exception as e:  # reported by value
            out[v] = {"error": f"{type(e).__name__}: {e}"}
    return out
