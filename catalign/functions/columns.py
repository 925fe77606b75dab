"""Column-level projections (PRJ1-PRJ18).  Plain DataFrame/Column code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ3: rename by dictionary; names not present are ignored (as pandas)."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def rename_strict(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ4: rename to a canonical vocabulary and keep exactly those columns;
    a missing source column is an error."""
    missing = [k for k in mapping if k not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(k).alias(v) for k, v in mapping.items()])


def columns_first(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """PRJ5: listed columns first, the rest after in their order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def tag(df: DataFrame, name: str, column: str = "dataset") -> DataFrame:
    """PRJ6: literal source tag."""
    return df.withColumn(column, F.lit(name))


def copy_key(df: DataFrame, src: str, dst: str, when: bool) -> DataFrame:
    """PRJ7: alias the key when the source is the shared space itself."""
    return df.withColumn(dst, F.col(src)) if when else df


def concat_strict(*cols: Column | str, sep: str = ", ") -> Column:
    """PRJ8: ``a || sep || b``; null when any part is null (``concat``, not ``concat_ws``)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.col(c) if isinstance(c, str) else c)
    return F.concat(*parts)


def priority(col: Column | str, high: Sequence, high_value: int = 1, other_value: int = 2) -> Column:
    """PRJ12: label rows whose value is in ``high`` with ``high_value``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(list(high)), F.lit(high_value)).otherwise(F.lit(other_value))


def replace_text(col: Column | str, search: str, repl: str) -> Column:
    """PRJ13: substring replace."""
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(c, F.lit(search), F.lit(repl))


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """PRJ14: null -> constant per column."""
    return df.fillna(dict(values))


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """PRJ15: NaN -> null on float columns (all float columns by default)."""
    fl = (T.DoubleType, T.FloatType)
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, fl)]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in cols})


# fixed value: kilojoules per kilocalorie
KJ_PER_KCAL = 4.184


def energy_kcal(kcal: Column | str, kj: Column | str) -> Column:
    """PRJ16: keep kcal, else kJ / 4.184."""
    a = F.col(kcal) if isinstance(kcal, str) else kcal
    b = F.col(kj) if isinstance(kj, str) else kj
    return F.coalesce(a, b / F.lit(KJ_PER_KCAL))


def similarity_to_distance(score: Column | str, max_distance: Column | float | None = None) -> Column:
    """PRJ17: ``clip(1 - s, 0, 1)``, divided by the global max distance when given."""
    s = F.col(score) if isinstance(score, str) else score
    d = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - s))
    if max_distance is None:
        return d
    m = max_distance if isinstance(max_distance, Column) else F.lit(float(max_distance))
    return F.try_divide(d, m)


def simplify(df: DataFrame, fields: Sequence[str], mask: Column | None = None) -> DataFrame:
    """PRJ18: null out the listed fields (on rows matching ``mask``, all rows by default)."""
    m = F.lit(True) if mask is None else mask
    return df.withColumns({c: F.when(~m, F.col(c)) for c in fields})


def drop_flagged(df: DataFrame, flag: str = "unlikely_food_item") -> DataFrame:
    """FLT5: drop rows flagged implausible (null flag counts as not flagged)."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))
