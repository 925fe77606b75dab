"""Schema and domain checks (CHK1-CHK5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNCLASSIFIED = "Unclassified"


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """CHK1: raise when a required column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CHK2 / AGG7: keys that occur more than once, with their count
    (partial aggregation first, so a hot key costs one row per task)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], show: int = 5) -> DataFrame:
    """CHK2: raise listing the first duplicated keys."""
    dups = duplicate_keys(df, keys).orderBy(*keys).take(show)
    if dups:
        raise ValueError(f"duplicate keys on {list(keys)}: {[tuple(r) for r in dups]}")
    return df


def uniqueness_counts(df: DataFrame, key: str) -> DataFrame:
    """AGG7: row count next to distinct count of a column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_distinct"))


def coerce_to_domain(col: Column | str, values: Sequence[str], fallback: str = UNCLASSIFIED) -> Column:
    """CHK3: value outside the closed set (or null) -> ``fallback``.  Exact,
    case-sensitive match; the set is a literal ``IN`` list, no join."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(list(values)), c).otherwise(F.lit(fallback))


def split_by_domain(df: DataFrame, col: str, values: Sequence[str], mode: str = "quarantine"):
    """CHK4: strict domain.  Returns ``(accepted, rejected)``; with
    ``mode='fail'`` any rejected row raises instead.  Null is rejected."""
    ok = F.coalesce(F.col(col).isin(list(values)), F.lit(False))
    accepted, rejected = df.filter(ok), df.filter(~ok)
    if mode == "fail":
        bad = rejected.select(col).limit(5).collect()
        if bad:
            raise ValueError(f"values outside the domain of {col}: {[r[0] for r in bad]}")
    elif mode != "quarantine":
        raise ValueError(mode)
    return accepted, rejected


def column_profile(df: DataFrame) -> DataFrame:
    """CHK5: per column, its non-null count and whether it has any value.
    One aggregation pass over the table, then a 1-row unpivot."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column_name", "non_null")
    return long.withColumn("has_values", F.col("non_null") > 0)
