"""Nearest-donor imputation over long facts (IMP1-IMP3).

Facts are long rows ``(item, fact, value)``.  For every (item, fact) whose
value is missing, the ``k`` nearest items that *have* that fact are needed.

One kernel run serves all facts: an item goes into it once, with the list of
the facts it lacks or has, so a pair is scored once and a vector travels once
per cell.  An item's neighbours are listed best first, ``neighbours`` of them;
where that does not settle a fact, the item's list is doubled for the facts
that are still open.
Distance is ``clip(1 - cosine, 0, 1)``; ties go to the smaller donor key.
Dividing distances by their global maximum changes neither the k=1 choice
nor the weights below, so it is not applied here (see ``similarity_to_distance``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import ITEM, VECTOR, nearest_with_facts

#: Neighbours that an item lists at first.
NEIGHBOURS = 32


def split_known(facts: DataFrame):
    """IMP1: ``(known, missing)`` facts."""
    return facts.filter(F.col("value").isNotNull()), facts.filter(F.col("value").isNull())


def nearest_donors(facts: DataFrame, vectors: DataFrame, k: int, cell_rows: int | None = None,
                   neighbours: int = NEIGHBOURS) -> DataFrame:
    """``(item, fact, donor, score, rank)`` for every missing (item, fact).
    ``neighbours``: length of the neighbour lists before they are doubled; it
    changes the cost, never the result."""
    known, missing = split_known(facts)
    vec = vectors.select(F.col(ITEM), F.col(VECTOR)).dropna()
    # the facts of one item: bounded by the number of facts
    side = lambda df: df.groupBy(ITEM).agg(F.collect_set(F.col("fact").cast("string")).alias("facts")).join(vec, ITEM)
    near = nearest_with_facts(side(missing), side(known), k=k, first=max(int(neighbours), k), cell_rows=cell_rows)
    return near.withColumn("fact", F.col("fact").cast(facts.schema["fact"].dataType))


def knn_values(facts: DataFrame, vectors: DataFrame, k: int = 1, weights: str = "distance",
               cell_rows: int | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """IMP2: predicted value per missing (item, fact).

    ``uniform``: mean of the k donor values.  ``distance``: ``sum(v/d)/sum(1/d)``;
    when some of the k donors are at distance 0, the mean of those alone.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(weights)
    known, _ = split_known(facts)
    near = nearest_donors(facts, vectors, k, cell_rows, neighbours)
    donor_vals = known.select(F.col(ITEM).alias("donor"), "fact", F.col("value").alias("donor_value"))
    rows = near.join(donor_vals, ["donor", "fact"])
    d = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - F.col("score")))
    rows = rows.withColumn("d", d)
    if weights == "uniform":
        pred = F.avg("donor_value")
    else:
        zero = F.col("d") == 0.0
        pred = F.when(F.count_if(zero) > 0, F.avg(F.when(zero, F.col("donor_value")))).otherwise(
            F.sum(F.try_divide(F.col("donor_value"), F.col("d"))) / F.sum(F.try_divide(F.lit(1.0), F.col("d"))))
    return rows.groupBy(ITEM, "fact").agg(pred.alias("imputed"))


def impute(facts: DataFrame, vectors: DataFrame, k: int = 1, weights: str = "distance",
           cell_rows: int | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """IMP3: every fact row, known values kept and missing ones filled from
    the nearest donors (a fact without donors stays null).
    Output ``(item, fact, value, imputed)``."""
    pred = knn_values(facts, vectors, k, weights, cell_rows, neighbours)
    out = facts.join(pred, [ITEM, "fact"], "left")
    return out.select(ITEM, "fact", F.coalesce(F.col("value"), F.col("imputed")).alias("value"),
                      (F.col("value").isNull() & F.col("imputed").isNotNull()).alias("imputed"))


def facts_long(wide: DataFrame, key: str, fact_cols: list[str]) -> DataFrame:
    """Wide facts -> long ``(item, fact, value)`` (NaN counted as missing)."""
    w = wide.select(F.col(key).alias(ITEM),
                    *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in fact_cols])
    return w.unpivot([ITEM], fact_cols, "fact", "value")


def facts_wide(long: DataFrame, fact_names: list[str], key: str = ITEM) -> DataFrame:
    """Long facts -> wide, one column per fact name (RSH3: one pivot at the sink)."""
    return long.groupBy(F.col(ITEM).alias(key)).pivot("fact", fact_names).agg(F.first("value"))
