"""Toxicity classifier with a counterfactual penalty.

A document's features are its distinct words and their prefixes.  Logistic
weights are fitted on a bounded sample of labelled rows.  Each sampled text
that names an identity group is paired with a copy in which the names are
swapped for other names of their group; a text that names none is used a
second time, under its label, with a mention inserted, and that copy is paired
with one whose mention is swapped.  So every fit has a pair for every row.  The
fit penalises the squared change of the logit between the two texts of a pair,
so a group's mention alone moves no score."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

#: Bound of the labelled rows a fit reads, chosen by a hash of their id.
MAX_LABELLED = 12_000
#: Features kept, by the strength of their link with the label.
VOCABULARY = 3_000
#: Documents of the sample in which a feature has to occur.
MIN_DF = 3
PREFIXES = (4, 5, 6, 7)
PENALTY = 4.0
RIDGE = 1e-3
#: Weight of a toxic row against a clean one; None gives both labels equal total weight.
POSITIVE_WEIGHT = None
ROUNDS = 300
THRESHOLD = 0.7
#: Feature counts held by a task before they are sent on.
_FLUSH = 400_000

#: Names of groups; a name is swapped for the next of its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarze", "weiße", "asiaten", "araber"),
    ("schwule", "lesben", "heteros"), ("einwanderer", "flüchtlinge", "ausländer", "einheimische"), ("behinderte", "gehörlose", "blinde"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs", "hindous"), ("noirs", "blancs", "asiatiques", "arabes"),
    ("homosexuels", "lesbiennes", "hétérosexuels"), ("immigrés", "réfugiés", "étrangers", "autochtones"), ("handicapés", "sourds", "aveugles"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("negros", "blancos", "asiáticos", "árabes"),
    ("homosexuales", "lesbianas", "heterosexuales"), ("inmigrantes", "refugiados", "extranjeros", "nativos"), ("discapacitados", "sordos", "ciegos"),
)

_WORD = re.compile(r"[^\W\d_]+")


def swap_table(terms=IDENTITY_TERMS) -> dict[str, str]:
    return {a: b for row in terms for a, b in zip(row, row[1:] + row[:1])}


def mention(text: str | None, terms: list[str]) -> str:
    """The name inserted into a text that has none, chosen by its content alone."""
    return terms[zlib.crc32((text or "").encode()) % len(terms)]


def word_features(word: str) -> list[str]:
    """The word and its prefixes (marked by ``^``)."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class Model:
    """Feature weights and bias; small and bounded by the vocabulary."""

    def __init__(self, weights: dict[str, float], bias: float, pairs: int = 0):
        self.weights, self.bias, self.pairs = weights, bias, pairs  # pairs: of the fit

    def scorer(self):
        """A function from a word set to its logit, with a bounded cache of words."""
        weights, known = self.weights, {}

        def logit(words: set[str]) -> float:
            hits: set[str] = set()
            for w in words:
                got = known.get(w)
                if got is None:
                    got = tuple(f for f in word_features(w) if f in weights)
                    if len(known) > 500_000:
                        known.clear()
                    known[w] = got
                if got:
                    hits.update(got)
            return self.bias + sum(weights[f] for f in sorted(hits))

        return logit


def _rows(idx: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(idx).astype(np.int64) if idx else np.zeros(0, np.int64),
            np.repeat(np.arange(len(idx)), [len(x) for x in idx]))


def fit_logistic(idx: list[np.ndarray], y: np.ndarray, n: int, pairs: list[tuple[np.ndarray, np.ndarray]],
                 penalty: float = PENALTY, ridge: float = RIDGE, positive_weight: float | None = POSITIVE_WEIGHT,
                 rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias for sparse binary rows ``idx``; ``pairs`` are the
    rows of texts and of their swapped copies.  Full-batch Adam with
    steps that fall to 0, so that it settles in the minimum."""
    col, row = _rows(idx)
    flat = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in pairs]
    pcol, prow = _rows([np.concatenate(p) for p in flat])
    psign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in flat]) if flat else np.zeros(0)
    if positive_weight is None:
        positive_weight = (y <= 0).sum() / max((y > 0).sum(), 1)
    weight = np.where(y > 0, positive_weight, 1.0)
    weight /= weight.sum()
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    p = np.clip((weight * y).sum(), 1e-3, 1 - 1e-3)
    w[n] = np.log(p / (1 - p))
    for t in range(1, rounds + 1):
        z = w[n] + np.bincount(row, w[col], len(idx))
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(col, r[row], n)[:n] + ridge * w[:n], r.sum())
        if flat:
            change = np.bincount(prow, psign * w[pcol], len(flat))
            g[:n] += 2 * penalty / len(flat) * np.bincount(pcol, psign * change[prow], n)[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (1 - (t - 1) / rounds) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:n], float(w[n])


def fit(texts: DataFrame, swaps: dict[str, str] | None = None, max_labelled: int = MAX_LABELLED,
        vocabulary: int = VOCABULARY, penalty: float = PENALTY, **how) -> Model:
    """Fit on ``texts`` (text, toxic), a bounded labelled sample: at most
    ``max_labelled`` rows reach the driver, as lists of vocabulary indices.
    Rows with a null label are left out; without a row of each label every
    score is the share of toxic rows (0.5 for none)."""
    swaps = swap_table() if swaps is None else swaps
    texts = texts.where("toxic is not null").select("text", F.col("toxic").cast("double").alias("toxic"))

    def count(frames):
        df, pos = Counter(), Counter()
        table = lambda: pd.DataFrame({"feature": list(df), "n": list(df.values()), "n_toxic": [pos[f] for f in df]})
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                own = features(words_of(text))
                df.update(own)
                if toxic:
                    pos.update(own)
                if len(df) > _FLUSH:
                    yield table()
                    df.clear()
                    pos.clear()
        yield table()

    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("p")).first()
    share = size["p"] / size["n"] if size["n"] else 0.5
    if not 0 < share < 1:
        return Model({}, float(np.log(np.clip(share, 1e-3, 0.999) / (1 - np.clip(share, 1e-3, 0.999)))))
    counts = texts.mapInPandas(count, "feature string, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("p"))
    expected = F.col("n") * share
    top = counts.where(F.col("n") >= MIN_DF).orderBy(F.desc(F.abs((F.col("p") - expected) / F.sqrt(expected + 1))), "feature").limit(vocabulary)
    vocab = [r["feature"] for r in top.select("feature").collect()]
    # the names' features take part whether or not the sample has them
    vocab = list(dict.fromkeys([*vocab, *sorted(features(set(swaps)))]))
    terms = sorted(swaps)
    index = {f: i for i, f in enumerate(vocab)}

    def encode(frames):
        pick = lambda words: sorted({index[f] for w in words for f in word_features(w) if f in index})
        for frame in frames:
            own = [words_of(t) for t in frame["text"]]
            # with a mention: the words as they are, or with one inserted
            named = [w if not swaps.keys().isdisjoint(w) else w | {mention(t, terms)} if terms else w for w, t in zip(own, frame["text"])]
            yield pd.DataFrame({"toxic": frame["toxic"], "own": [pick(w) for w in own],
                                "inserted": [pick(n) if n is not w else None for w, n in zip(own, named)],
                                "swapped": [pick({swaps.get(x, x) for x in n}) if terms else None for n in named]})

    rows = texts.mapInPandas(encode, "toxic double, own array<int>, inserted array<int>, swapped array<int>").limit(max_labelled).toPandas()
    as_array = lambda x: np.asarray(x, np.int64)
    labelled = [(as_array(x), y) for c in ("own", "inserted") for x, y in zip(rows[c], rows["toxic"]) if x is not None]
    labelled.sort(key=lambda r: (len(r[0]), r[0].tolist(), r[1]))
    pairs = [(as_array(own if new is None else new), as_array(b)) for own, new, b in zip(rows["own"], rows["inserted"], rows["swapped"]) if b is not None]
    pairs.sort(key=lambda p: (len(p[0]), p[0].tolist(), p[1].tolist()))
    w, bias = fit_logistic([x for x, _ in labelled], np.array([y for _, y in labelled]), len(vocab), pairs, penalty, **how)
    return Model({f: float(x) for f, x in zip(vocab, w) if abs(x) > 1e-6}, bias, len(pairs))


def held_out(id_col: str = "doc_id"):
    """Rows that no fit may read (crc32 of the id's text, modulo 3, is 1);
    a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most ``bound`` labelled rows outside the held-out
    fold: those of the smallest hashes of their id.  Of repeated ids the
    smallest text and label count."""
    ids = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where(~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, **how) -> Model:
    bound = how.get("max_labelled", MAX_LABELLED)
    sample = Scratch(docs.sparkSession, "toxicity").put(labelled_sample(docs, labels, bound), "labelled")
    return fit(sample.repartition(sample.sparkSession.sparkContext.defaultParallelism), **how)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` from 0 to 1, computed from the whole
    text alone, however long.  Null texts count as empty and get the model's
    base score; repeated rows are scored alike; a column ``out`` of the input
    is replaced; an empty table gives an empty one."""
    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        logit = model.scorer()
        z = np.clip([logit(words_of(t)) for t in texts], -30, 30) if len(texts) else np.zeros(0)
        return pd.Series(1 / (1 + np.exp(-z)))

    return docs.withColumn(out, udf(F.col(text_col).cast("string")))


def split_by_score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; repeated rows stay
    or go together, null texts score as empty ones."""
    return score(docs, model, out="_toxicity").where(F.col("_toxicity") < threshold).drop("_toxicity")


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(ids, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
