"""Pivots, unpivots, dedup and match-list reshaping (AGG1-AGG3, RSH1-RSH3, DED1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_names(df: DataFrame, col: str) -> list:
    """Distinct non-null values of ``col``, sorted: the column names of a wide form."""
    return [r[0] for r in df.select(col).dropna().distinct().orderBy(col).collect()]


def _listed(name: Column, values: Sequence) -> Column:
    """``name``, or an error for a value outside ``values``: a wide form never
    loses rows because the caller's list of columns is incomplete."""
    return F.when(name.isNull() | name.isin(list(values)), name).otherwise(
        F.raise_error(F.concat(F.lit("value without a column: "), name.cast("string"))))


def pivot_mean(df: DataFrame, index: Sequence[str], names: str, value: str,
               values: Sequence | None = None) -> DataFrame:
    """AGG1: long -> wide with the mean (pandas ``pivot_table`` default);
    null keys dropped, nulls skipped.  ``values`` lists the columns (all
    distinct names by default); a name outside the list is an error."""
    values = list(values) if values is not None else pivot_names(df, names)
    if not values:
        return df.select(*index).limit(0)
    base = df.withColumn("_name", _listed(F.col(names), values))
    return base.filter(F.col(names).isNotNull()).groupBy(*index).pivot("_name", values).agg(F.avg(value))


def pivot_first(df: DataFrame, index: Sequence[str], names: str, value: str, order: Sequence[str],
                values: Sequence | None = None) -> DataFrame:
    """AGG2: long -> wide with the first non-null value under an explicit row
    order; null keys and null values dropped first (pandas ``first``).  One
    row per (index, name) is found first, then pivoted.  ``values`` as in
    ``pivot_mean``."""
    base = df.filter(F.col(names).isNotNull() & F.col(value).isNotNull())
    values = list(values) if values is not None else pivot_names(base, names)
    if not values:
        return df.select(*index).limit(0)
    base = base.withColumn("_name", _listed(F.col(names), values))
    first = base.groupBy(*index, "_name").agg(F.min(F.struct(*order, F.col(value).alias("_value"))).alias("_first"))
    return first.groupBy(*index).pivot("_name", values).agg(F.max("_first._value"))


def composite_name(name: Column | str, unit: Column | str, sep: str = "|") -> Column:
    """AGG2/AGG3: one header from (name, unit)."""
    n = F.col(name) if isinstance(name, str) else name
    u = F.col(unit) if isinstance(unit, str) else unit
    return F.concat_ws(sep, n, u)


def unit_table(df: DataFrame, name: str, unit: str, exclude_units: Sequence[str] = ()) -> DataFrame:
    """AGG3: distinct (name, unit), without the listed units."""
    out = df.select(name, unit).distinct()
    if exclude_units:
        out = out.filter(~F.col(unit).isin(list(exclude_units)))
    return out


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """DED1: first row per key under an ascending explicit order.

    An aggregate (``min_by`` over the row struct), so partial aggregation
    runs before the shuffle and a hot key never lands whole in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, "_r.*")


def match_lists(matches: DataFrame, key: Sequence[str], target: str, name: str, score: str,
                targets: Sequence | None = None) -> DataFrame:
    """Wide match lists (the reference's storage form): one
    ``array<struct<name, score>>`` column per target, best first, equal scores
    by the smaller name.  Input is a top-N table, so every list holds at most
    N entries.  ``targets`` defaults to those in the data."""
    targets = list(targets) if targets is not None else pivot_names(matches, target)
    pairs = F.struct((-F.col(score)).alias("order"), F.col(name).alias("name"), F.col(score).alias("score"))
    lists = matches.withColumn("_target", _listed(F.col(target), targets)).groupBy(*key, "_target").agg(F.array_sort(F.collect_list(pairs)).alias("_l"))
    lists = lists.withColumn("_l", F.transform("_l", lambda s: F.struct(s["name"].alias("name"), s["score"].alias("score"))))
    return lists.groupBy(*key).pivot("_target", targets).agg(F.first("_l"))


def melt_match_lists(wide: DataFrame, key: Sequence[str], list_cols: Sequence[str],
                     var_name: str = "matched_dataset") -> DataFrame:
    """RSH1 + RSH2: wide lists -> ranked long rows
    ``(key.., matched_dataset, matched_name, matched_score)``; empty and null
    lists give no row (FLT2, ARR2), pairs expand to columns (ARR3)."""
    long = wide.unpivot(list(key), list(list_cols), var_name, "_l")
    long = long.filter(F.size("_l") > 0)
    return long.select(*key, var_name, F.explode("_l").alias("_p")).select(
        *key, var_name, F.col("_p.name").alias("matched_name"), F.col("_p.score").alias("matched_score"))
