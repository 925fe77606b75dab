"""Fact transfer from matched items (JN5, PRJ12, AGG4, AGG5, PIP10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import reindex, union_all


def transfer_facts(matches: DataFrame, facts: DataFrame, fact_cols: Sequence[str], *,
                   low_priority: Sequence, key: Sequence[str] = ("dataset", "item"),
                   match_dataset: str = "matched_dataset", match_key: str = "matched_item",
                   score: str = "matched_score") -> DataFrame:
    """Facts for each item from its matches.

    ``matches``: ``(key.., matched_dataset, matched_item, matched_score)``.
    ``facts``: ``(dataset, item, fact columns..)`` of the matched datasets.
    Matches into ``low_priority`` datasets rank 1, all others rank 2.  Per
    (item, rank) every numeric column is averaged (nulls skipped, the match
    score included); then per column the rank-2 mean is taken when it is
    not null, else the rank-1 mean.  One join on the composite key and one
    aggregation; no loop over datasets.
    """
    key = list(key)
    f = facts.select(F.col("dataset").alias(match_dataset), F.col("item").alias(match_key), *fact_cols)
    joined = matches.join(f, [match_dataset, match_key], "left")
    rank = F.when(F.col(match_dataset).isin(list(low_priority)), F.lit(1)).otherwise(F.lit(2))
    joined = joined.withColumn("_rank", rank)
    cols = list(fact_cols) + [score]

    def first_non_null(c):
        return F.coalesce(F.avg(F.when(F.col("_rank") == 2, F.col(c))), F.avg(F.when(F.col("_rank") == 1, F.col(c))))

    return joined.groupBy(*key).agg(*[first_non_null(c).alias(c) for c in cols])


def full_fact_table(transferred: DataFrame, facts: DataFrame, spine: DataFrame,
                    key: Sequence[str] = ("dataset", "item")) -> DataFrame:
    """PIP10 tail: transferred facts of the items of interest, unioned with
    the source datasets' own facts, reindexed to the embedding spine."""
    return reindex(spine, union_all([transferred, facts]), list(key))


def transfer_facts_long(matches: DataFrame, facts: DataFrame, *, low_priority: Sequence,
                        key: Sequence[str] = ("dataset", "item"), match_dataset: str = "matched_dataset",
                        match_key: str = "matched_item") -> DataFrame:
    """Long form of ``transfer_facts`` for facts kept as
    ``(dataset, item, fact, value)``: per (item, fact) the mean over the
    rank-2 matches when any has a value, else the mean over rank-1 matches
    (AGG4 per rank, then AGG5 as ``max_by`` over the rank).  Both steps are
    partial-then-final aggregations; no pivot until the sink."""
    key = list(key)
    f = (facts.filter(F.col("value").isNotNull())
         .select(F.col("dataset").alias(match_dataset), F.col("item").alias(match_key), "fact", "value"))
    joined = matches.join(f, [match_dataset, match_key])
    rank = F.when(F.col(match_dataset).isin(list(low_priority)), F.lit(1)).otherwise(F.lit(2))
    per_rank = joined.withColumn("_rank", rank).groupBy(*key, "fact", "_rank").agg(F.avg("value").alias("_v"))
    return per_rank.groupBy(*key, "fact").agg(F.max_by("_v", "_rank").alias("value"))
