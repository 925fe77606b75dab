"""Align one catalogue to another (PIP5, MDL1, MDL2, CHK5, SET2).

Per chunk of reference items: translate each record into the external
catalogue's record layout with a caller-supplied model function, run the
second pass on records flagged inconsistent, render, embed, and keep the
best ``k`` external items per translated record.  Chunks already written are
skipped, so a failed or interrupted run resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import flag_in, keyed_update, union_all, with_prefix
from ..operators.modelcall import ERROR_COL, embed_texts, model_map
from ..operators.similarity import as_items, top_matches
from ..session import materialize, over_cores
from ..sources.sinks import replace_rows, run_chunks, same_keys
from ..specs import SECOND_PASS_FLAGS, DatasetSpec, prepare_items, simplify_items


#: Row id of a record during a run.
ROW = "_row"


def record_schema(spec: DatasetSpec) -> T.StructType:
    fields = [T.StructField(f, T.StringType()) for f in spec.fields]
    fields += [T.StructField("unlikely_food_item", T.BooleanType()),
               T.StructField("food_item_discrepancy", T.StringType())]
    return T.StructType(fields)


def translate(items: DataFrame, source: DatasetSpec, target: DatasetSpec, fn: Callable[[dict], dict],
              keep: Sequence[str] | None = None, **model_kw) -> DataFrame:
    """MDL1: each source record -> a ``target`` record, checked and normalised
    with the target's rules.  Every record comes back once, with the columns
    ``keep`` (the key by default): ``status`` is ``ok``, ``failed`` (the call gave no answer; ``_error`` says why) or
    ``rejected`` (an answer outside a strict domain).  The calls run once;
    the checked records are materialised."""
    out = model_map(items, fn, list(source.fields), record_schema(target), keep_cols=list(keep or [source.key]), **model_kw)
    out = materialize(out)
    checked, rejected = prepare_items(out, target, text_col="text", mode="quarantine")
    status = lambda df, s: df.withColumn("status", F.when(F.col(ERROR_COL).isNotNull(), "failed").otherwise(s))
    checked = status(checked, "ok")
    if rejected is None:
        return checked
    rejected = rejected.withColumn("text", F.lit(None).cast("string")) if "text" not in rejected.columns else rejected
    return checked.unionByName(status(rejected, "rejected"), allowMissingColumns=True)


def two_pass_translate(items: DataFrame, source: DatasetSpec, target: DatasetSpec, fn: Callable[[dict], dict],
                       flags: Sequence[str] = SECOND_PASS_FLAGS, **model_kw):
    """MDL2: translate all; records whose answer is flagged inconsistent are
    simplified (PRJ18 on the source) and translated again; the redone answers
    replace the first ones (JN11), nulls included.  The model is called once
    per record and pass.  Records are told apart by a row id (column ``_row``
    of the results), so repeated and null keys stay records of their own.
    The calls are dealt over all cores, however few files the records came from.
    Returns ``(final, phase_1, redone)``."""
    items = over_cores(materialize(items.withColumn(ROW, F.monotonically_increasing_id())))
    keep = [source.key, ROW]
    phase_1 = translate(items, source, target, fn, keep, **model_kw)
    flagged = phase_1.filter(flag_in("food_item_discrepancy", flags)).select(ROW)
    retry_src = simplify_items(items.join(flagged, ROW, "left_semi"), source)
    redone = translate(retry_src, source, target, fn, keep, **model_kw)
    cols = [c for c in phase_1.columns if c not in keep]
    final = keyed_update(phase_1, redone, ROW, cols)
    return final, phase_1, redone


def phases_union(final: DataFrame, phase_1: DataFrame, redone: DataFrame, key: str, target: str) -> DataFrame:
    """SET2 + STR2: final records plus the first-phase versions of redone
    ones, tagged by phase, record fields prefixed ``{target}__``.  Records are
    told apart by the row id where they have one."""
    by = ROW if ROW in final.columns else key
    cols = [c for c in final.columns if c not in (key, ROW)]
    first_bad = phase_1.join(redone.select(by), by, "left_semi")
    tag = lambda df, p: with_prefix(df.select(key, F.struct(*cols).alias("r")), "r", target, [key]).withColumn(
        "phase", F.lit(p))
    return union_all([tag(final, "final"), tag(first_bad, "first_phase_discrepancy")])


def align(spark: SparkSession, items: DataFrame, source: DatasetSpec, target: DatasetSpec,
          target_embeddings: DataFrame, translate_fn: Callable[[dict], dict], embed_fn: Callable[[dict], dict],
          out_dir: str, chunk_size: int = 100_000, chunk_start: int | None = None, chunk_end: int | None = None,
          overwrite: bool = False, k: int = 1, **model_kw) -> DataFrame:
    """PIP5.  ``target_embeddings``: ``(key, embedding)`` of the external
    catalogue; the keys of ``items`` must be unique.  Writes per chunk ``embeddings`` (both phases; failed and
    rejected records with their status and no vector), ``pair_scores`` (best
    ``k`` per record, long) and ``top_match`` (one row per record, without a
    match where it has none) under ``out_dir``.  A record is done when the
    run that computed it wrote all three (``run_chunks``): a run that stopped
    anywhere resumes, added and changed records are computed, those that left
    the input leave the outputs, and no other record is sent to the model.
    Returns the table of chunk ids that ran.  The chunk size changes only
    the file layout (one directory per chunk), never the results."""
    target_items = materialize(as_items(target_embeddings, F.lit(target.name), target.key))

    def compute(todo: DataFrame) -> DataFrame:
        final, phase_1, redone = two_pass_translate(todo.drop("chunk"), source, target, translate_fn, **model_kw)
        both = phases_union(final, phase_1, redone, source.key, target.name)
        text = both.select(source.key, "phase", F.col(f"{target.name}__status").alias("status"),
                           F.when(F.col(f"{target.name}__status") == "ok", F.col(f"{target.name}__text")).alias("text"))
        emb = embed_texts(materialize(text), "text", embed_fn, **model_kw).drop(ERROR_COL)
        return emb.join(todo.select(F.col(source.key).alias("_key"), "chunk"), F.col(source.key).eqNullSafe(F.col("_key"))).drop("_key")

    def match(todo: DataFrame, current: DataFrame, chunks: DataFrame, per: int) -> None:
        emb = spark.read.parquet(f"{out_dir}/embeddings").join(chunks, "chunk", "left_semi").filter(F.col("phase") == "final")
        emb = emb.alias("_l").join(todo.select(source.key).alias("_r"), same_keys("_l", "_r", [source.key]), "left_semi")
        pairs = top_matches(as_items(emb, F.lit(source.name), source.key), target_items, k=k, per_target=False)
        pairs = pairs.select(F.col("item").alias("_key"), F.col("match").alias(target.key), F.col("score").alias("similarity_score"), "rank")
        every = emb.select(source.key, F.col("chunk").cast("long").alias("chunk")).join(pairs, F.col(source.key) == F.col("_key"), "left").drop("_key")
        every = materialize(every)
        replace_rows(spark, f"{out_dir}/pair_scores", every, [source.key], todo, current, chunks, "chunk", per)
        top = every.filter(F.coalesce("rank", F.lit(1)) == 1).drop("rank")
        replace_rows(spark, f"{out_dir}/top_match", top, [source.key], todo, current, chunks, "chunk", per)

    return run_chunks(spark, items, [source.key], chunk_size, f"{out_dir}/embeddings", compute, chunk_start, chunk_end, overwrite, then=match)

