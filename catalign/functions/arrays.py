"""Array column expressions (ARR1, ARR4, FLT2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_non_empty(cols: Sequence[Column | str]) -> Column:
    """ARR1: array of the candidate columns without nulls and empty strings."""
    arr = F.array(*[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.filter(arr, lambda x: x.isNotNull() & (x != F.lit("")))


def is_member(value: Column | str, candidates: Column | str) -> Column:
    """ARR4: chosen value is one of the candidates (null if either is null)."""
    v = F.col(value) if isinstance(value, str) else value
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    return F.array_contains(c, v)


def non_empty(col: Column | str) -> Column:
    """FLT2: list has at least one element (null list -> null, dropped by filter)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.size(c) > 0
