"""Freshness, lineage, test coverage, dependency graphs, service levels and SQL statements: small, driver-side, without Spark."""

from __future__ import annotations

import statistics
import time
from collections import deque
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

# --- freshness


@dataclass(frozen=True)
class Freshness:
    warn_after_hours: int = 12
    error_after_hours: int = 24

    def __post_init__(self):
        if self.warn_after_hours < 1:
            raise ValueError("warn_after_hours must be >= 1")
        if self.warn_after_hours >= self.error_after_hours:
            raise ValueError("warn_after_hours must be less than error_after_hours")


@dataclass(frozen=True)
class FreshnessResult:
    source: str
    status: str
    age_hours: float | None


def check_freshness(source: str, loaded_at: datetime | None, limits: Freshness = Freshness(), now: datetime | None = None) -> FreshnessResult:
    """pass, warn or error by age; unknown if never loaded. Times without a zone are UTC."""
    if loaded_at is None:
        return FreshnessResult(source, "unknown", None)
    now = now or datetime.now(UTC)
    aware = lambda t: t if t.tzinfo else t.replace(tzinfo=UTC)
    age = (aware(now) - aware(loaded_at)).total_seconds() / 3600
    return FreshnessResult(source, "error" if age >= limits.error_after_hours else "warn" if age >= limits.warn_after_hours else "pass", round(age, 3))


def check_all(sources: Mapping[str, tuple[datetime | None, Freshness]], now: datetime | None = None) -> tuple[str, list[FreshnessResult]]:
    """The worst status (error, unknown, warn, pass), and each result."""
    found = [check_freshness(s, t, f, now) for s, (t, f) in sources.items()]
    return next((s for s in ("error", "unknown", "warn") if any(r.status == s for r in found)), "pass"), found


# --- lineage


class Lineage:
    """Which models a column of the same name comes through."""

    def __init__(self):
        self.models: dict[str, tuple[list[str], list[str]]] = {}

    def register(self, model: str, columns: Sequence[str], upstream: Sequence[str] = ()) -> None:
        self.models[model] = (list(columns), list(upstream))

    def list_models(self) -> list[str]:
        return sorted(self.models)

    def columns(self, model: str) -> list[str]:
        return list(self.models[model][0]) if model in self.models else []

    def column_lineage(self, model: str, column: str) -> list[str]:
        """Upstream models that have the column, nearest first."""
        return [m for m in self.upstream_chain(model) if column in self.columns(m)]

    def upstream_chain(self, model: str) -> list[str]:
        """All models upstream, nearest first, each once."""
        out, todo = [], deque(self.models.get(model, ([], []))[1])
        while todo:
            m = todo.popleft()
            if m not in out and m != model:
                out.append(m)
                todo += self.models.get(m, ([], []))[1]
        return out


# --- test coverage


@dataclass(frozen=True)
class Coverage:
    model: str
    total: int
    tested: int
    percent: float
    untested: list[str]
    tests: dict[str, int]


def model_coverage(model: Mapping) -> Coverage:
    """How many of a model's columns have a test."""
    tests = {c.get("name", ""): len(c.get("tests") or []) for c in model.get("columns") or []}
    tested = sum(n > 0 for n in tests.values())
    return Coverage(model.get("name", "unknown"), len(tests), tested, round(100 * tested / len(tests), 1) if tests else 0.0, [c for c, n in tests.items() if not n], tests)


def project_coverage(models: Sequence[Mapping]) -> dict:
    found = [model_coverage(m) for m in models]
    total, tested = sum(c.total for c in found), sum(c.tested for c in found)
    return {"total_columns": total, "tested_columns": tested, "coverage_pct": round(100 * tested / total, 1) if total else 0.0, "models": found}


# --- dependencies


@dataclass
class Dependencies:
    upstream: dict[str, list[str]] = field(default_factory=dict)

    def cycles(self) -> list[list[str]]:
        """Each cycle that a depth-first walk closes, as its nodes with the first again at the end."""
        done: set[str] = set()
        out: list[list[str]] = []
        for start in self.upstream:
            if start in done:
                continue
            path, todo = [start], [iter(self.upstream[start])]
            while todo:
                nxt = next((n for n in todo[-1]), None)
                if nxt is None:
                    todo.pop()
                    done.add(path.pop())
                elif nxt in path:
                    out.append([*path[path.index(nxt) :], nxt])
                elif nxt not in done and nxt in self.upstream:
                    path.append(nxt)
                    todo.append(iter(self.upstream[nxt]))
        return out

    def missing(self) -> dict[str, list[str]]:
        """Upstream names that aren't models, by model."""
        return {m: gone for m, ups in self.upstream.items() if (gone := [u for u in ups if u not in self.upstream])}

    def orphans(self) -> list[str]:
        """Models with nothing upstream that nothing uses."""
        used = {u for ups in self.upstream.values() for u in ups}
        return sorted(m for m, ups in self.upstream.items() if not ups and m not in used)

    def validate(self) -> dict:
        found = {"cycles": self.cycles(), "missing": self.missing(), "orphans": self.orphans()}
        return found | {"valid": not found["cycles"] and not found["missing"]}

    def order(self) -> list[str]:
        """Models after all that they build on; names that aren't models don't count. ValueError on a cycle."""
        waits = {m: {u for u in ups if u in self.upstream} for m, ups in self.upstream.items()}
        out: list[str] = []
        ready = deque(sorted(m for m, w in waits.items() if not w))
        while ready:
            m = ready.popleft()
            out.append(m)
            for k in sorted(waits):
                if m in waits[k]:
                    waits[k].discard(m)
                    if not waits[k]:
                        ready.append(k)
        if len(out) < len(waits):
            raise ValueError(f"cycle among {sorted(set(waits) - set(out))}")
        return out


# --- service levels and retries

#: Seconds that each family may take.
SLA_SECONDS = {"daily_metrics": 900, "user_cohorts": 600, "revenue_summary": 300}
DEFAULT_SLA = 1800


def track_sla(family: str, started: float, rows: int, now: float | None = None) -> dict:
    took, limit = (time.time() if now is None else now) - started, SLA_SECONDS.get(family, DEFAULT_SLA)
    return {"metric_family": family, "row_count": rows, "duration_seconds": round(took, 3), "sla_threshold_seconds": limit, "sla_breached": took > limit}


@dataclass(frozen=True)
class StageResult:
    stage: str
    success: bool
    attempts: int
    duration_seconds: float
    result: object = None
    error: str | None = None


def backoff(attempt: int, base: float = 2.0, exponent: float = 2.0, most: float = 300.0) -> float:
    return min(base * exponent ** (attempt - 1), most)


def run_with_retry(stage: str, work: Callable[[], object], max_attempts: int = 3, base: float = 2.0, exponent: float = 2.0, most: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> StageResult:
    """Runs work until it succeeds or has been tried max_attempts times; never raises."""
    started, error = time.time(), None
    for k in range(1, max_attempts + 1):
        try:
            return StageResult(stage, True, k, time.time() - started, work())
        except Exception as e:  # a stage's failure is a result
            error = f"{type(e).__name__}: {e}"
            if k < max_attempts:
                sleep(backoff(k, base, exponent, most))
    return StageResult(stage, False, max_attempts, time.time() - started, None, error)


# --- benchmarks and layer metrics


def improvement_pct(before: float, after: float) -> float:
    if before <= 0:
        raise ValueError("before must be > 0")
    if after < 0:
        raise ValueError("after must be >= 0")
    return round(100 * (before - after) / before, 1)


def benchmark_verdict(pct: float) -> str:
    return "BENEFICIAL" if pct >= 20 else "MARGINAL" if pct >= 5 else "NOT_BENEFICIAL"


def scenario_verdict(pct: float) -> str:
    return "EXCELLENT" if pct >= 50 else "GOOD" if pct >= 20 else "MARGINAL" if pct >= 5 else "NOT_BENEFICIAL"


def median(values: Sequence[float]) -> float:
    return statistics.median(values)


def upper_median(values: Sequence[float]) -> float:
    return sorted(values)[len(values) // 2]


def layer_metrics(bronze: Mapping, silver: Mapping, gold: Mapping) -> dict:
    good, bad = bronze.get("good_records", 0), bronze.get("bad_records", 0)
    return {
        "bronze_good_records": good, "bronze_bad_records": bad, "quarantine_rate": bad / max(good + bad, 1), "silver_row_count": silver.get("row_count", 0), "silver_checks": silver.get("gx_checks", {}),
        "gold_row_count": gold.get("row_count", 0), "gold_sla_breached": gold.get("sla_breached", False), "gold_duration_seconds": gold.get("duration_seconds", 0.0),
    }


def diff_schemas(old: Sequence[tuple[str, str]], new: Sequence[tuple[str, str]]) -> dict:
    """Columns added, removed and changed in type between two lists of (name, type); compatible if nothing was removed or changed."""
    a, b = dict(old), dict(new)
    added, removed = sorted(b.keys() - a.keys()), sorted(a.keys() - b.keys())
    changed = {c: (a[c], b[c]) for c in a if c in b and a[c] != b[c]}
    return {"added": added, "removed": removed, "type_changed": changed, "compatible": not removed and not changed}


def validate_compatible(old: Sequence[tuple[str, str]], new: Sequence[tuple[str, str]], strict: bool = False) -> dict:
    found = diff_schemas(old, new)
    if strict and not found["compatible"]:
        raise ValueError(f"schemas are not compatible: removed {found['removed']}, changed {found['type_changed']}")
    return found


# --- statements for engines that have them


def _table(name: str) -> str:
    if not name.strip():
        raise ValueError("table_name must not be empty")
    return name


def optimize_sql(table: str, zorder: Sequence[str], where: str | None = None) -> str:
    _table(table)
    if not zorder:
        raise ValueError("z_order_columns must not be empty")
    return " ".join(["OPTIMIZE", table, *(["WHERE", where] if where else []), f"ZORDER BY ({', '.join(zorder)})"])


def check_retention(hours: float) -> dict:
    if hours < 1:
        raise ValueError("retention_hours must be >= 1")
    return {"retention_hours": hours, "safe": hours >= 168, "message": "ok" if hours >= 168 else "less than 168 hours: versions that readers use may lose files"}


def vacuum_sql(table: str, hours: int, dry_run: bool = False) -> str:
    _table(table)
    check_retention(hours)
    return f"VACUUM {table} RETAIN {hours} HOURS" + " DRY RUN" * dry_run


def schema_sql(operation: str, table: str, column: str, kind: str | None = None, new_name: str | None = None) -> str:
    _table(table)
    if operation not in ("add", "rename", "drop"):
        raise ValueError(f"Unsupported operation: {operation}")
    if operation == "add" and not kind:
        raise ValueError("add needs the column's type")
    if operation == "rename" and not new_name:
        raise ValueError("rename needs the new name")
    change = {"add": f"ADD COLUMN {column} {kind}", "rename": f"RENAME COLUMN {column} TO {new_name}", "drop": f"DROP COLUMN {column}"}[operation]
    return f"ALTER TABLE {table} {change}"


def markdown_report(results: Sequence[Mapping]) -> str:
    """Benchmark results as a table."""
    lines = ["| Scenario | Before (s) | After (s) | Improvement | Files | Verdict |", "|---|---|---|---|---|---|"]
    lines += [f"| {r['name']} | {r['before']:.3f} | {r['after']:.3f} | {r['improvement_pct']:.1f}% | {r.get('files', '-')} | {r['verdict']} |" for r in results]
    return "\n".join(lines) + "\n"
