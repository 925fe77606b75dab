"""Cross-dataset mapping jobs (PIP6, PIP7, PIP9, PIP12)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import copy_key, rename, tag
from ..operators.joins import union_all
from ..operators.matching import best_match, cross_dataset_top_n, rank_by_space_name
from ..operators.modelcall import model_map
from ..operators.reshape import first_per_key
from ..operators.similarity import as_items, top_matches
from ..sources.sinks import output_exists


def collect_embeddings(tables: Mapping[str, DataFrame], renames: Mapping[str, Mapping[str, str]] | None = None,
                       key: str = "food_name", vector: str = "embedding", phase: str | None = "final") -> DataFrame:
    """PIP9: embeddings of many datasets in one space -> ``(dataset, key, embedding)``.

    Per dataset: rename (PRJ3), tag (PRJ6), keep ``phase == 'final'`` when
    the table has a phase column (FLT1); then one union by name (SET1).
    """
    frames = []
    for name, df in tables.items():
        df = rename(df, (renames or {}).get(name, {}))
        df = tag(df, name)
        if phase is not None and "phase" in df.columns:
            df = df.filter(F.col("phase") == phase)
        frames.append(df.select("dataset", key, vector))
    return union_all(frames)


def load_space(tables: Mapping[str, DataFrame], space: str, own_keys: Mapping[str, str],
               space_key: str, vector: str = "embedding") -> DataFrame:
    """PIP6 loader: per dataset its own key, its name in the shared space
    (PRJ7 copies the key when the dataset *is* the space) and the vector;
    deduplicated on (dataset, own key), final phase first (Q5)."""
    frames = []
    for name, df in tables.items():
        df = copy_key(df, own_keys[name], space_key, name == space)
        has_phase = "phase" in df.columns
        df = df.select(F.lit(name).alias("dataset"), F.col(own_keys[name]).cast("string").alias("item"),
                       F.col(space_key).cast("string").alias("space_name"), F.col(vector).alias("embedding"),
                       (F.col("phase") if has_phase else F.lit("final")).alias("phase"))
        frames.append(df)
    allv = union_all(frames).withColumn("_not_final", (F.col("phase") != "final").cast("int"))
    return first_per_key(allv, ["dataset", "item"], ["_not_final", "space_name"]).drop("_not_final")


def _pairs_done(spark: SparkSession, out_path: str) -> set[tuple[str, str]]:
    """Ordered pairs of datasets in an output's ledger; at most the square of
    the number of datasets."""
    ledger = f"{out_path}__pairs"
    return {(r["dataset"], r["target"]) for r in spark.read.parquet(ledger).select("dataset", "target").distinct().collect()} if output_exists(spark, ledger) else set()


def _pairs_write(df: DataFrame, out_path: str, pairs: Sequence[tuple[str, str]]) -> None:
    """Replace the folders of ``pairs`` (dataset, target) and nothing else,
    then enter them in the ledger, each as a folder of its own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "target").parquet(out_path)
    entries = df.sparkSession.createDataFrame([(a, b, a, b) for a, b in pairs], "dataset string, target string, d string, t string")
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("d", "t").parquet(f"{out_path}__pairs")


def top_n_of_pairs(items: DataFrame, pairs: Sequence[tuple[str, str]], n: int) -> DataFrame:
    """SIM5 + SIM6 for the given ordered (dataset, target) pairs alone.
    Datasets with the same targets share one kernel run, which gets their
    items on the left and those of their targets on the right."""
    targets: dict[str, list[str]] = {}
    for a, b in sorted(set(pairs)):
        targets.setdefault(a, []).append(b)
    groups: dict[tuple[str, ...], list[str]] = {}
    for a, bs in targets.items():
        groups.setdefault(tuple(bs), []).append(a)
    runs = [top_matches(items.filter(F.col("dataset").isin(of)), items.filter(F.col("dataset").isin(list(to))), k=n, per_target=True, exclude_self=True)
            for to, of in groups.items()]
    return union_all(runs)


def cross_dataset_mapping(spark: SparkSession, tables: Mapping[str, DataFrame], space: str,
                          own_keys: Mapping[str, str], space_key: str, n: int = 3, out_path: str | None = None,
                          overwrite: bool = False, rank_by: str = "item") -> DataFrame | None:
    """PIP6 + SIM5 + SIM6 + SIM7: top-``n`` matches of every item in every
    dataset (all ordered pairs, self-pairs included, itself excluded).

    With ``out_path`` the output is partitioned by (dataset, target), and a
    ledger beside it holds the pairs that are there.  Only pairs not in the
    ledger are computed and written (all of them with ``overwrite``), so a
    dataset that joins later costs its own pairs; a run that broke off repeats
    the pairs that it did not enter.  Returns the whole output, or ``None``
    when no pair was missing (SNK3)."""
    pairs = [(a, b) for a in tables for b in tables]
    if out_path is not None and not overwrite:
        done = _pairs_done(spark, out_path)
        pairs = [p for p in pairs if p not in done]
        if not pairs:
            return None
    items = load_space(tables, space, own_keys, space_key)
    kernel_items = as_items(items, "dataset", "item")
    names = items.select("dataset", "item", "space_name")
    top = top_n_of_pairs(kernel_items, pairs, n) if len(pairs) < len(tables) ** 2 else cross_dataset_top_n(kernel_items, n)
    if rank_by == "item":
        top = top.join(names, ["dataset", "item"], "left")
    else:
        top = rank_by_space_name(top, names)
    match_names = names.select(F.col("dataset").alias("target"), F.col("item").alias("match"),
                               F.col("space_name").alias("match_space_name"))
    out = (top.join(match_names, ["target", "match"], "left")
           .select("dataset", "item", "space_name", "target", "match", "match_space_name",
                   F.col("score").alias("similarity_score"), F.col("rank").cast("int").alias("rank")))
    if out_path is None:
        return out
    _pairs_write(out, out_path, pairs)
    return spark.read.schema(out.schema).parquet(out_path)


def validate_mappings(mapping: DataFrame, judge: Callable[[dict], dict], texts: DataFrame | None = None,
                      only: Sequence[tuple[str, str]] | None = None, out_path: str | None = None,
                      overwrite: bool = False, **model_kw) -> DataFrame | None:
    """PIP7 + MDL4 + JN12: judge each distinct (item, match) pair once and
    attach ``same_item`` by the pair key.  ``texts`` ``(dataset, item, text)``
    supplies the rendered texts given to the judge as ``a`` / ``b``;
    ``only`` limits the work to listed (dataset, target) pairs.

    With ``out_path`` the output is partitioned by (dataset, target) with a
    ledger of the pairs judged.  Only pairs asked for and not in the ledger
    (all asked for with ``overwrite``) are judged and their folders replaced;
    pairs of the mapping that were never written are written without an
    answer.  Returns the whole output, or ``None``, before any call, when
    nothing is left to do (SNK3)."""
    spark, m = mapping.sparkSession, mapping
    new = []
    if only is not None or out_path is not None:
        there = {(r["dataset"], r["target"]) for r in mapping.select("dataset", "target").distinct().collect()}
        asked = [p for p in (there if only is None else only) if p in there]
        if out_path is not None:
            done = set() if overwrite else _pairs_done(spark, out_path)
            asked = [p for p in asked if p not in done]
            if not asked:
                return None
            known = ({(r["dataset"], r["target"]) for r in spark.read.parquet(out_path).select("dataset", "target").distinct().collect()}
                     if output_exists(spark, out_path) else set())
            new = sorted(there - known - set(asked))
        m = mapping.filter(_one_of(asked))
    pairs = m.select("dataset", "item", "target", "match", "similarity_score").dropDuplicates(
        ["dataset", "item", "target", "match"])
    if texts is not None:
        t = texts.select("dataset", "item", F.col("text").alias("a"))
        u = texts.select(F.col("dataset").alias("target"), F.col("item").alias("match"), F.col("text").alias("b"))
        pairs = pairs.join(t, ["dataset", "item"], "left").join(u, ["target", "match"], "left")
        in_cols = ["a", "b", "similarity_score"]
    else:
        in_cols = ["similarity_score"]
    judged = model_map(pairs, judge, in_cols, "same_item boolean",
                       keep_cols=["dataset", "item", "target", "match"], **model_kw)
    if out_path is not None:
        mapping = mapping.filter(_one_of([*asked, *new]))
    out = mapping.join(judged.select("dataset", "item", "target", "match", "same_item"),
                       ["dataset", "item", "target", "match"], "left")
    if out_path is None:
        return out
    _pairs_write(out, out_path, asked)
    return spark.read.schema(out.schema).parquet(out_path)


def _one_of(pairs: Sequence[tuple[str, str]]):
    """Rows of the given (dataset, target) pairs."""
    return functools.reduce(lambda x, y: x | y, [(F.col("dataset") == a) & (F.col("target") == b) for a, b in pairs], F.lit(False))


def match_in_shared_space(a: DataFrame, b: DataFrame, key_a: str, key_b: str, vector: str = "embedding") -> DataFrame:
    """PIP12: best item of ``b`` for each item of ``a`` when both are embedded
    in a third dataset's space; rows without key or vector are dropped (FLT3)."""
    la = as_items(a, F.lit("a"), key_a, vector)
    lb = as_items(b, F.lit("b"), key_b, vector)
    out = best_match(la, lb)
    return out.select(F.col("item").alias(key_a), F.col("match").alias(key_b), F.col("score").alias("similarity_score"))
