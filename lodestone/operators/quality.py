"""Quality gates: one aggregation for all checks of a table, and failing-row queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GateConfig:
    min_rows: int = 1
    expected_columns: tuple[str, ...] = ()
    max_null_share: float = 0.20


@dataclass(frozen=True)
class GateResult:
    rows: int
    null_shares: dict[str, float]
    failures: list[str] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.failures


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, dict[str, float]]:
    """Row count and null share of each column (0 for an empty table), in one job."""
    columns = list(df.columns if columns is None else columns)
    row = df.agg(F.count("*").alias("__n"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"__{i}") for i, c in enumerate(columns)]).first()
    n = row["__n"]
    return n, {c: (row[f"__{i}"] / n if n else 0.0) for i, c in enumerate(columns)}


def check_not_null(df: DataFrame, column: str, limit: float = 0.01) -> bool:
    return profile(df, [column])[1][column] < limit


def check_row_count(df: DataFrame, least: int) -> bool:
    return df.count() >= least


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def gate(df: DataFrame, config: GateConfig = GateConfig()) -> GateResult:
    """All checks; raises ValueError if any fails."""
    n, shares = profile(df, [c for c in df.columns if not c.startswith("_")])
    failures = [f"row count {n} is less than {config.min_rows}"] if n < config.min_rows else []
    failures += [f"column {c} is missing" for c in missing_columns(df, config.expected_columns)]
    failures += [f"column {c} is null in {s:.2%} of rows" for c, s in shares.items() if s > config.max_null_share]
    result = GateResult(n, shares, failures)
    if failures:
        raise ValueError("quality gate failed: " + "; ".join(failures))
    return result


# --- failing rows of column tests; a test passes if there are none


def failing_unique(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_records")).filter("n_records > 1")


def failing_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def failing_accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values that aren't accepted; null is never one."""
    return df.filter(~F.col(column).isin([v for v in values if v is not None])).groupBy(column).agg(F.count("*").alias("n_records"))


def failing_accepted_range(df: DataFrame, column: str, least=None, most=None) -> DataFrame:
    c, bad = F.col(column), F.lit(False)
    if least is not None:
        bad = bad | (c < least)
    if most is not None:
        bad = bad | (c > most)
    return df.filter(bad)
