"""Join helpers (JN1-JN12).  Whether a side is broadcast is Spark's choice, by
its own size rule at planning and by measured sizes at run time."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import assert_unique


def join_dim(df: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """JN1/JN3/JN6: join to a dimension."""
    return df.join(dim, on, how)


def left_join_all(base: DataFrame, tables: Sequence[DataFrame], on, dedupe: bool = True) -> DataFrame:
    """JN4: N-way left join of one-row-per-key tables onto a base.  Each
    table is checked unique on the key first, so no row multiplies."""
    keys = [on] if isinstance(on, str) else list(on)
    if dedupe:
        for t in tables:
            assert_unique(t, keys)
    return functools.reduce(lambda acc, t: acc.join(t, keys, "left"), tables, base)


def keep_matching(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """JN7: left semi join."""
    return df.join(keys, on, "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """JN8 / SET3: left anti join (key set difference)."""
    return df.join(keys, on, "left_anti")


def reindex(spine: DataFrame, src: DataFrame, on, check_unique: bool = True) -> DataFrame:
    """JN9: exactly the spine's keys, nulls where ``src`` has none, extra
    ``src`` keys dropped; a duplicated ``src`` key is an error."""
    keys = [on] if isinstance(on, str) else list(on)
    if check_unique:
        assert_unique(src, keys)
    return spine.select(*keys).join(src, keys, "left")


def keyed_update(df: DataFrame, updates: DataFrame, on, columns: Sequence[str]) -> DataFrame:
    """JN11: overwrite ``columns`` for the keys present in ``updates``; a null
    in an update is written like any other value, and a null key meets a null
    key.  A key with several updates is an error."""
    keys = [on] if isinstance(on, str) else list(on)
    new = F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    # the check is part of the plan: an aggregation by the key, no job of its own
    upd = updates.groupBy(*[F.col(k).alias(f"_on_{i}") for i, k in enumerate(keys)]).agg(F.first(new).alias("_new"), F.count(F.lit(1)).alias("_n"))
    upd = upd.withColumn("_new", F.when(F.col("_n") == 1, F.col("_new")).otherwise(F.raise_error(F.lit(f"several updates for one key of {keys}"))))
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{i}")) for i, k in enumerate(keys)])
    joined = df.join(upd, same, "left")
    return joined.withColumns({c: F.when(F.col("_n").isNotNull(), F.col(f"_new._{i}")).otherwise(F.col(f"`{c}`")) for i, c in enumerate(columns)}).drop(
        "_new", "_n", *[f"_on_{i}" for i in range(len(keys))])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """SET1: union by name, missing columns null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_prefix(df: DataFrame, record: str, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """STR2: expand a struct column into ``{prefix}__{field}`` columns (row-local, no join)."""
    fields = df.schema[record].dataType.fieldNames()
    return df.select(*keep, *[F.col(f"{record}.{f}").alias(f"{prefix}__{f}") for f in fields])


def to_record(df: DataFrame, cols: Sequence[str], name: str = "record", keep: Sequence[str] = ()) -> DataFrame:
    """STR1: rows -> one struct column."""
    return df.select(*keep, F.struct(*cols).alias(name))


def flag_in(col: Column | str, values: Sequence[str]) -> Column:
    """FLT4: IN-list predicate (null -> false)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.isin(list(values)), F.lit(False))
