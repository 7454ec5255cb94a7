"""Column functions: tiers, buckets, keys, safe casts, string and flag cleaning. All stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column suffix and the type that it is cast to; the first that fits holds.
SUFFIX_TYPES = (("_ts", "timestamp"), ("_at", "timestamp"), ("_date", "timestamp"), ("_id", "string"), ("_count", "bigint"), ("_amount", "double"), ("_price", "double"), ("_qty", "int"))


def _steps(value: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    out = None
    for least, name in steps:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(rest)


def engagement_tier(total_events: Column) -> Column:
    return _steps(total_events, ((50, "power_user"), (20, "engaged"), (5, "casual")), "bounced")


def session_revenue_tier(revenue: Column) -> Column:
    return F.when(revenue >= 1000, "enterprise").when(revenue >= 100, "mid_market").when(revenue > 0, "smb").otherwise("free")


def transaction_revenue_tier(revenue: Column) -> Column:
    """Without a free tier: null and negative amounts are smb."""
    return _steps(revenue, ((1000, "enterprise"), (100, "mid_market")), "smb")


def cohort_bucket(days: Column) -> Column:
    """Days since acquisition as a bucket; null and negative days fall into the last."""
    return F.when(days == 0, "day_0").when(days.between(1, 7), "day_1_7").when(days.between(8, 30), "day_8_30").otherwise("day_30_plus")


def _key_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def surrogate_key(*columns: str) -> Column:
    """md5 of the columns as text; null and empty are the same, and so is a value that holds the separator."""
    return F.md5(_key_text(columns))


def surrogate_key_sha256(*columns: str) -> Column:
    return F.sha2(_key_text(columns), 256)


def partitioned_key(columns: Sequence[str], partition: str) -> Column:
    return surrogate_key(*columns, partition)


def record_hash(columns: Sequence[str]) -> Column:
    """md5 of the row as JSON; a null field and a missing one are the same."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))


def parse_flag(value: Column) -> Column:
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False)


def clean_string(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(trimmed != "", F.lower(trimmed))


def auto_cast(df: DataFrame) -> DataFrame:
    """Columns whose names end in a known suffix, cast to its type; what can't be cast becomes null."""
    casts = {}
    for f in df.schema.fields:
        kind = next((k for s, k in SUFFIX_TYPES if f.name.endswith(s)), None)
        if kind and f.dataType.simpleString() != kind:
            casts[f.name] = F.col(f"`{f.name}`").try_cast(kind) if isinstance(f.dataType, (T.StringType, T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(f"`{f.name}`").cast("string").try_cast(kind)
    return df.withColumns(casts) if casts else df


def string_columns(df: DataFrame) -> list[str]:
    """String columns that aren't system columns (which begin with _)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")]


def normalize_strings(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Trimmed, lower-case, empty as null; columns that df lacks are passed over."""
    chosen = [c for c in (string_columns(df) if columns is None else columns) if c in df.columns and c not in exclude]
    return df.withColumns({c: clean_string(F.col(f"`{c}`")) for c in chosen}) if chosen else df


def any_null(columns: Sequence[str]) -> Column:
    return reduce(or_, [F.col(f"`{c}`").isNull() for c in columns], F.lit(False))


def round_scaled(value: Column, places: int) -> Column:
    """The double times a power of ten, rounded half away from zero, as DuckDB rounds; F.round goes by the digits that a double prints, and makes 1.005 (a hair less in binary) 1.01."""
    scale = float(10**places)
    return F.round(value * scale) / scale


def severity(value: Column, warn: float, critical: float) -> Column:
    return F.when(value >= critical, "CRITICAL").when(value >= warn, "WARN").otherwise("OK")
