"""Importance resampling towards a target distribution.

A document's features are its runs of one to three words, hashed to buckets.
A bucket's gain is the log ratio of its share in the target texts and in the
documents; the gains are one array, and a document's weight is the sum of the
array's entries over its features.  Weight plus Gumbel noise is its score, and
the documents of the highest scores are drawn.

The draw does not sort the corpus.  A quantile sketch of the scores gives a
bracket that should hold the last drawn score; exact counts of the rows above
and inside confirm it, or widen it.  Rows above the bracket are drawn, rows
below are not, and the bracket alone is sorted to find the cutoff."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textbytes as tb
from .ordinal import numbered
from .scratch import Scratch

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
SHARE = (5, 100)
SEED = 42
#: Accuracy of the quantile sketch: its ranks are off by about 1 in so many.
ACCURACY = 1_000


def _buckets(texts: pa.ChunkedArray, buckets: int, longest: int):
    """Per piece of a text column: first row, words by text, and (bucket, text) arrays."""
    for piece in tb.pieces(texts):
        data = tb.LOWER[piece.data]
        start, end, heads = tb.words(data, piece.bounds)
        yield piece.first, np.diff(heads), [(crc % buckets, text) for crc, text in tb.crc_runs(data, start, end, heads, longest)]


def bucket_counts(texts: DataFrame, col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket.  A task adds up its texts before the
    shuffle; the driver gets one number per bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, runs in _buckets(batch.column(0), buckets, longest):
                for bucket, _ in runs:
                    total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(col).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) by bucket, each count raised by one."""
    k = len(docs)
    of, at = float(docs.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * of / ((float(s) + 1) * at))) for s, t in zip(docs, target)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row, from its whole text."""
    def weights(batches):
        for batch in batches:
            n = batch.num_rows
            n_words, n_runs, weight = (np.zeros(n, np.int64) for _ in range(3))
            for first, sizes, runs in _buckets(batch.column(1), len(gain), longest):
                rows = slice(first, first + len(sizes))
                n_words[rows] = sizes
                for bucket, text in runs:
                    n_runs[rows] += np.bincount(text, minlength=len(sizes))
                    np.add.at(weight[rows], text, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_runs), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(col).cast("string").alias("text"))
    return rows.mapInArrow(weights, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of an id; a null id counts as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def bracket(scores: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> tuple[int | None, int | None, int]:
    """(low, high, above): bounds of ``score`` (None: open) such that the k-th
    highest of the ``n`` scores lies between them, and the rows above ``high``.
    The sketch proposes them; the counts are exact, and a bracket that misses
    is widened to twice its ranks until it holds."""
    margin = 2.0 / accuracy
    while True:
        p_low, p_high = 1 - k / n - margin, 1 - k / n + margin
        ask = [min(max(p, 0.0), 1.0) for p in (p_low, p_high)]
        low, high = scores.agg(F.percentile_approx("score", ask, accuracy).alias("p")).first()["p"]
        low, high = low if p_low > 0 else None, high if p_high < 1 else None
        over = F.lit(False) if high is None else F.col("score") > high
        reach = F.lit(True) if low is None else F.col("score") >= low
        got = scores.agg(F.count_if(over).alias("above"), F.count_if(reach).alias("reached")).first()
        if got["above"] < k <= got["reached"]:
            return low, high, got["above"]
        margin *= 2


def draw(scores: DataFrame, scratch: Scratch, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, accuracy: int = ACCURACY) -> DataFrame:
    """``scores`` (written: doc_id, n_words, score, ..) with ``rank``: 1, 2, ..
    for the floor(share) documents of the highest scores among those of at
    least ``min_words`` words, null for the others.  Equal scores go to the
    smaller id, null ids last; of rows equal in both, as many are drawn as fit."""
    able = F.col("n_words") >= min_words
    n = scores.where(able).count()
    k = share[0] * n // share[1]
    none = F.lit(None).cast("long")
    if not k:
        return scores.withColumn("rank", none)
    low, high, above = bracket(scores.where(able), k, n, accuracy)
    over = F.lit(False) if high is None else F.col("score") > high
    under = F.lit(False) if low is None else F.col("score") < low
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place = lambda df, before: numbered(df, [], order, scratch).withColumn("rank", F.col("position") + before + 1).drop("position")
    inside = place(scores.where(able & ~over & ~under), above)
    out = inside.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).unionByName(scores.where(~able | under).withColumn("rank", none))
    return out.unionByName(place(scores.where(able & over), 0)) if above else out


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, share: tuple[int, int] = SHARE,
             min_words: int = MIN_WORDS, seed: int = SEED, accuracy: int = ACCURACY) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of
    ``docs`` (doc_id, text); ``target`` (text) holds the wanted texts.

    Null texts have no words, weight 0 and are never drawn; repeated rows are
    rows of their own; without documents the result is empty, without target
    texts every bucket counts as empty there.  Other columns are not read."""
    scratch = Scratch(docs.sparkSession, "importance")
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    scores = scratch.put(weigh(docs, gain).withColumn("score", F.col("weight") + noise(seed=seed)), "scores")
    return draw(scores, scratch, share, min_words, accuracy)
