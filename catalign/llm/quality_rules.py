"""Quality classifier: a sparse ensemble of rules.

A document's features are statistics of its whole text.  Trees are grown on a
bounded labelled sample, and every path from a root to one of its nodes is a
rule: a conjunction of bounds on statistics.  A logistic regression with a
lasso penalty over the rules keeps a few of them, and the classifier is the
sum of their weights, compiled into one Spark column over the statistics."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from . import textbytes as tb
from .scratch import Scratch
from .toxicity import held_out

#: Bound of the labelled rows a fit reads, chosen by a hash of their id.
MAX_LABELLED = 12_000
TREES = 30
DEPTH = 3
#: Weight of the lasso penalty.
LASSO = 0.0005
#: Steps of the lasso fit.
ROUNDS = 1_500
SEED = 42
THRESHOLD = 0.5

#: Statistics of a text.  ``*_share`` are shares of its bytes unless the
#: name says words or lines; an empty text has 0 everywhere.
STATISTICS = ("n_words", "mean_word", "longest_word", "letter_share", "upper_share", "digit_share", "symbol_share", "stop_share", "bang_share",
              "bar_share", "space_share", "mixed_word_share", "bare_word_share", "repeat_word_share", "distinct_word_share", "distinct_pair_share",
              "mean_line", "longest_run")

_CLASS = np.zeros(256, np.uint8)  # 0: anything else
for _k, _bytes in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b"#$%&*+/<=>@\\^_`~[]{}", b".,;:'\"()-", b"!?", b"|", b" \t\n\v\f\r", range(0x80, 0x100)), 1):
    _CLASS[list(_bytes)] = _k
_KINDS = 10
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Different keys (32 bits) of each text."""
    return np.bincount((np.unique(text.astype(np.uint64) << np.uint64(32) | keys) >> np.uint64(32)).astype(np.int64), minlength=n)


def _ratio(a, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(b)), where=np.asarray(b) > 0)


def piece_statistics(piece: tb.Piece) -> np.ndarray:
    """(texts, statistics) of a piece of whole texts."""
    data, bounds = piece.data, piece.bounds
    n, size = len(bounds) - 1, np.diff(bounds)
    text = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    kinds = np.bincount(text * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
    lower, upper, digit, symbol, stop, bang, bar, space, beyond = kinds[:, 1:].T

    start, end, heads = tb.words(data, bounds, tb.TOKEN_BYTES)
    of = np.repeat(np.arange(n), np.diff(heads))
    n_words, length = np.diff(heads), end - start
    count = lambda hit: np.bincount(of[hit], minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    wordy = np.r_[0, np.cumsum(tb.WORD_BYTES[data])]
    good = wordy[end] - wordy[start]
    odd = np.r_[0, np.cumsum((kind == 4) | (kind == 6) | (kind == 7))]
    crc = tb.crc_words(tb.LOWER[data], start, end)
    again = np.r_[False, (crc[1:] == crc[:-1]) & (of[1:] == of[:-1])] if len(crc) else np.zeros(0, bool)
    pair = np.flatnonzero(of[1:] == of[:-1])
    pairs = tb.crc_append(crc[pair], crc[pair + 1], length[pair + 1])

    n_lines = np.diff(tb.words(data, bounds, _LINE)[2])
    change = np.flatnonzero(np.r_[True, (data[1:] != data[:-1]) | (text[1:] != text[:-1])]) if len(data) else np.zeros(0, np.int64)
    run = np.zeros(n)
    np.maximum.at(run, text[change], np.diff(np.r_[change, len(data)]))

    letters = lower + upper + beyond
    return np.column_stack([
        n_words, _ratio(np.bincount(of, length, n), n_words), longest, _ratio(letters, size), _ratio(upper, lower + upper), _ratio(digit, size), _ratio(symbol, size),
        _ratio(stop, size), _ratio(bang, size), _ratio(bar, size), _ratio(space, size),
        _ratio(count((good > 0) & (odd[end] > odd[start])), n_words), _ratio(count(good == 0), n_words), _ratio(count(again), n_words),
        _ratio(_distinct(crc, of, n), n_words), _ratio(_distinct(pairs, of[pair], n), n_words - (n_words > 0)),
        _ratio(size, n_lines), run]).astype(float)


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and a column for each statistic of the
    whole text; a null text is an empty one.  Names in ``keep`` that are also
    names of statistics are an error."""
    if clash := set(keep) & set(STATISTICS):
        raise ValueError(f"columns {sorted(clash)} have the name of a statistic")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_text"))

    def measure(batches):
        for batch in batches:
            found = [piece_statistics(p) for p in tb.pieces(batch.column("_text"))]
            values = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(v) for v in values.T]], [*keep, *STATISTICS])

    schema = rows.drop("_text").schema
    for name in STATISTICS:
        schema = schema.add(name, "double")
    return rows.mapInArrow(measure, schema)


class Rule(NamedTuple):
    """Bounds ``low < statistic <= high``, at most one pair a statistic."""
    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = None
        for name, low, high in self.bounds:
            for c in ([F.col(name) > low] if low > -math.inf else []) + ([F.col(name) <= high] if high < math.inf else []):
                out = c if out is None else out & c
        return out


def _narrowed(path: list[tuple[str, bool, float]]) -> Rule:
    bounds: dict[str, tuple[float, float]] = {}
    for name, above, at in path:
        low, high = bounds.get(name, (-math.inf, math.inf))
        bounds[name] = (max(low, at), high) if above else (low, min(high, at))
    return Rule(tuple((name, *bounds[name]) for name in sorted(bounds)))


_STEP = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(tree: str, names: tuple[str, ...] = STATISTICS) -> set[Rule]:
    """The paths of a printed decision tree to every node below its root."""
    out, path, margin = set(), [], None
    for line in tree.splitlines():
        m = _STEP.match(line)
        if not m:
            continue
        margin = len(m[1]) if margin is None else margin
        del path[len(m[1]) - margin:]  # a level is indented by one space
        path.append((names[int(m[2])], m[3] == ">", float(m[4])))
        out.add(_narrowed(path))
    return out


class Model(NamedTuple):
    """Rules with weights, and the log odds of a text that fits none."""
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled rows outside the
    held-out fold: those of the smallest hashes of their id.  Of repeated ids
    the smallest text and label count; rows without id or label do not."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where(~held_out())
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fit_lasso(x: np.ndarray, y: np.ndarray, lasso: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of the least mean log loss plus ``lasso`` times the
    sum of absolute weights (the bias is free), by accelerated proximal steps."""
    n = len(y)
    v = np.ones(x.shape[1] + 1)
    for _ in range(30):  # largest eigenvalue of the columns and the bias, for the step
        u = x.T @ (r := x @ v[:-1] + v[-1])
        v = np.r_[u, r.sum()]
        v /= (norm := np.linalg.norm(v))
    step = 4 * n / (1.05 * norm)
    w = ahead = np.r_[np.zeros(x.shape[1]), np.log(y.mean() / (1 - y.mean()))]
    pace = 1.0
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30))) - y) / n
        new = ahead - step * np.r_[x.T @ r, r.sum()]
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * lasso, 0)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + (pace - 1) / faster * (new - w), new, faster
    return w[:-1], float(w[-1])


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> Model:
    """Rules and weights from ``sample`` (statistics, label), a bounded one:
    the trees are grown by Spark, which rules each row fits goes to the
    driver.  Without a row of each label the score is the share of label 1
    (0.5 for none)."""
    rows = sample.select(*STATISTICS, F.col("label").cast("double").alias("label"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("label"), F.lit(0.5)).alias("share")).first()
    if not size["n"] or not 0 < size["share"] < 1:
        share = min(max(size["share"], 1e-3), 1 - 1e-3)
        return Model((), math.log(share / (1 - share)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="onethird", minInstancesPerNode=5,
                                    seed=seed, labelCol="label", featuresCol="stats")
    grown = forest.fit(VectorAssembler(inputCols=list(STATISTICS), outputCol="stats").transform(rows))
    rules = sorted(set().union(*[tree_rules(t.toDebugString) for t in grown.trees]))
    if not rules:
        return Model((), math.log(size["share"] / (1 - size["share"])))
    fits = rows.select("label", F.array(*[r.column().cast("double") for r in rules]).alias("fits")).toPandas()
    weights, bias = fit_lasso(np.stack(fits["fits"]), fits["label"].to_numpy(), lasso)
    return Model(tuple((r, float(w)) for r, w in zip(rules, weights) if w), bias)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **how) -> Model:
    """A model from the labels of ``docs``; the sample's statistics are written
    once, in the order of ids, so that a repeated fit reads the same rows."""
    sample = with_statistics(labelled_sample(docs, labels, max_labelled), ["doc_id", "label"])
    return fit(Scratch(docs.sparkSession, "quality").put(sample.orderBy("doc_id"), "sample"), **how)


def score_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the whole text
    alone.  Null and empty texts get the score of a text whose statistics are
    all 0; repeated rows are scored alike; a null id is not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = with_statistics(rows, ["doc_id"]).select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
