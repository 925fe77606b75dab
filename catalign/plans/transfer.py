"""Source choice, fact transfer and imputation jobs (PIP8, PIP10, PIP11, MDL5, MDL6)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import is_member, pack_non_empty
from ..operators.checks import split_by_domain
from ..operators.consolidate import full_fact_table, transfer_facts
from ..operators.impute import facts_long, facts_wide, impute
from ..operators.joins import keyed_update, left_join_all
from ..operators.modelcall import model_map
from ..operators.reshape import first_per_key, melt_match_lists


def registry_with_sources(base: DataFrame, key: str, best: Mapping[str, DataFrame],
                          order: Sequence[str] = ("similarity_score",)) -> DataFrame:
    """PIP8 / JN4: left-join the one-best-match table of every candidate
    source onto the registry; each table is deduplicated on the key first
    (the best score wins, then the smaller match key; a match without a score
    comes last)."""
    tables = []
    for name, t in best.items():
        cols = [c for c in t.columns if c != key]
        t = t.withColumn("_none", F.col(order[0]).isNull()).withColumn("_neg", -F.col(order[0]))
        t = first_per_key(t, [key], ["_none", "_neg", *[c for c in cols if c not in order]]).drop("_none", "_neg")
        tables.append(t.select(key, *[F.col(c).alias(f"{name}__{c}") for c in cols]))
    return left_join_all(base, tables, key, dedupe=False)


def choose_source_model(df: DataFrame, fn: Callable[[dict], dict], in_cols: Sequence[str], labels: Sequence[str],
                        key: str, none_label: str = "no_relevant_match", **model_kw):
    """MDL5: the model picks one source label (+ reason) per row; a label
    outside ``labels`` + ``none_label`` is quarantined (CHK4).
    Returns ``(chosen, rejected)``."""
    out = model_map(df, fn, list(in_cols), "database_choice string, reason string", keep_cols=[key], **model_kw)
    return split_by_domain(out, "database_choice", list(labels) + [none_label])


def best_name(df: DataFrame, key: str, candidate_cols: Sequence[str], fn: Callable[[dict], dict],
              describe_cols: Sequence[str], write_col: str = "arabic_name", write_suggestion: bool = False,
              **model_kw) -> DataFrame:
    """MDL6: pack non-empty candidates (ARR1), ask the model for the best one
    plus its own suggestion, re-ask while the choice is not a candidate
    (ARR4 as validator), write the validated choice back by key (JN11)."""
    packed = df.withColumn("candidates", pack_non_empty(list(candidate_cols)))
    ask = packed.filter(F.size("candidates") > 0)

    def valid(row, out):
        return out is not None and out.get("best_name") in list(row["candidates"])

    res = model_map(ask, fn, [*describe_cols, "candidates"], "best_name string, suggested_name string",
                    keep_cols=[key], validate=valid, **model_kw)
    res = res.join(packed.select(key, "candidates"), key).withColumn(
        "valid", is_member("best_name", "candidates"))
    chosen = res.select(key, F.when(F.col("valid"), F.col("suggested_name" if write_suggestion else "best_name"))
                        .alias(write_col))
    return keyed_update(df, chosen, key, [write_col])


def transfer_from_lists(match_lists: DataFrame, facts: DataFrame, fact_cols: Sequence[str], list_cols: Sequence[str],
                        dataset_of_interest: str, low_priority: Sequence[str], spine: DataFrame) -> DataFrame:
    """PIP10 end to end: wide match lists of the dataset of interest
    (RSH2) -> facts of the matched items (JN5) -> priority means (AGG4/AGG5)
    -> union with the sources' own facts, reindexed to the spine (JN9)."""
    mine = match_lists.filter(F.col("dataset") == dataset_of_interest)
    long = melt_match_lists(mine, ["dataset", "item"], list(list_cols))
    matches = long.select("dataset", "item", "matched_dataset", F.col("matched_name").alias("matched_item"),
                          F.col("matched_score").alias("matched_score"))
    sources = facts.filter(F.col("dataset") != dataset_of_interest)
    moved = transfer_facts(matches, sources, list(fact_cols), low_priority=low_priority)
    return full_fact_table(moved, sources, spine)


def impute_all(table: DataFrame, vectors: DataFrame, key: str, fact_cols: Sequence[str], k: int = 1,
               weights: str = "distance") -> DataFrame:
    """PIP11: nearest-donor fill of every fact column of a wide table
    (long inside, one pivot at the end); the match score is not a fact (Q8)."""
    cols = [c for c in fact_cols if c != "matched_score"]
    long = facts_long(table, key, cols)
    vec = vectors.select(F.col(key).alias("item"), "embedding")
    filled = impute(long, vec, k=k, weights=weights)
    return facts_wide(filled, cols, key)
