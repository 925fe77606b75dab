"""Match lists built on the similarity kernel (SIM4-SIM8, DED1, LIM1).

All ranking is ``row_number`` over an explicit order that ends with a key, so
results never depend on file or partition order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import DATASET, ITEM, top_matches
from .tables import rank_within


def best_match(left: DataFrame, right: DataFrame, *, cell_rows: int | None = None) -> DataFrame:
    """SIM4: one best right item per left item over the whole right set
    (ties: smaller target dataset, then smaller key)."""
    return top_matches(left, right, k=1, per_target=False, exclude_self=False,
                       cell_rows=cell_rows).drop("rank")


def cross_dataset_top_n(items: DataFrame, n: int = 3, *, rank_by: str = "item",
                        space_name: DataFrame | None = None, cell_rows: int | None = None) -> DataFrame:
    """SIM5 + SIM6 + SIM7: for every item, the best ``n`` items of every
    dataset (its own included, itself excluded), ranked.

    ``rank_by='item'`` ranks per (item, target).  ``rank_by='space_name'``
    re-ranks per (dataset, target, name of the item in the shared space);
    ``space_name`` then holds ``(dataset, item, space_name)``.
    """
    out = top_matches(items, None, k=n, per_target=True, cell_rows=cell_rows)
    if rank_by == "item":
        return out
    if rank_by != "space_name" or space_name is None:
        raise ValueError("rank_by='space_name' needs a space_name table")
    return rank_by_space_name(out, space_name)


def rank_by_space_name(matches: DataFrame, space_name: DataFrame) -> DataFrame:
    """SIM7: ``matches`` ranked per (dataset, target, name of the item in the
    shared space).  Many items may share one name: no per-group window."""
    named = matches.drop("rank").join(space_name, [DATASET, ITEM], "left")
    return rank_within(named, [DATASET, "target", "space_name"], [F.desc("score"), F.asc(ITEM), F.asc("match")])


def choose_source(best: DataFrame, *, threshold: float, priority: Sequence, key: Sequence[str] = (DATASET, ITEM),
                  source_col: str = "target", score_col: str = "score",
                  none_label: str = "no_relevant_match", items: DataFrame | None = None) -> DataFrame:
    """SIM8: pick one source per item among its candidate best matches.

    The highest score at or above ``threshold`` wins; equal scores go to the
    source listed first in ``priority``.  Items with no candidate above the
    threshold get ``none_label``; ``items`` lists all items by ``key``, so
    that those without any candidate row are answered as well.  One
    aggregation, no N-way join.
    """
    prio = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(source_col)),
                      F.lit(len(priority) + 1))
    cand = best.withColumn("_prio", prio)
    ok = F.col(score_col) >= F.lit(threshold)
    pick = F.max_by(F.when(ok, F.struct(F.col(source_col).alias("source"), F.col("match").alias("match"),
                                        F.col(score_col).alias("score"))),
                    F.when(ok, F.struct(F.col(score_col), -F.col("_prio"))))
    agg = cand.groupBy(*key).agg(pick.alias("_best"))
    if items is not None:
        agg = items.select(*key).distinct().join(agg, list(key), "left")
    return agg.select(*key,
                      F.coalesce(F.col("_best.source").cast("string"), F.lit(none_label)).alias("database_choice"),
                      F.col("_best.match").alias("chosen_match"),
                      F.col("_best.score").alias("chosen_score"))


def top_k(df: DataFrame, k: int, order: Sequence[Column | str]) -> DataFrame:
    """LIM1 global form: ``orderBy(...).limit(k)`` (Spark plans TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)
