"""The classifier's held-out accuracy and its penalty; the pipeline's stages."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from catalign.llm import line_spread, pack_bestfit, queries, toxicity as tx

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.95
    assert held[held["predicted"] == 1]["toxic"].mean() > 0.9
    assert held[held["toxic"] == 1]["predicted"].mean() > 0.5
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()


def group_corpus(seed=1, n=600):
    """Toxic rows name one group much more often than clean rows do."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        toxic = rng.random() < 0.4
        words = [rng.choice(["tree", "river", "stone", "cloud", "road", "house"]) for _ in range(6)]
        if toxic and rng.random() < 0.75:
            words.append(rng.choice(["vile", "filth"]))
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslims")
        rng.shuffle(words)
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_penalty_takes_the_weight_off_group_names(spark):
    texts = spark.createDataFrame(group_corpus(), "text string, toxic int")
    neutral = [f"the {g} by the river road" for g in ("muslims", "christians", "hindus")]

    def gap(penalty):
        logit = tx.fit(texts, penalty=penalty).scorer()
        s = [logit(tx.words_of(t)) for t in neutral]
        return max(s) - min(s), s[0], logit(tx.words_of("the vile river road"))

    plain, fair = gap(0.0), gap(tx.PENALTY)
    assert fair[0] < 0.3 * plain[0] and fair[1] < plain[1]
    assert fair[2] > fair[1] + 1


def test_a_swapped_name_moves_no_score_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample = tx.labelled_sample(docs, labels)
    model = tx.fit(sample)
    assert model.pairs == sample.count() > 100  # a pair for every row, although no row names a group
    logit = model.scorer()
    table = tx.swap_table()
    texts = [r["text"] for r in sample.limit(60).collect()]
    for a, b in table.items():
        for t in texts[:: max(1, len(texts) // 10)]:
            p, q = (1 / (1 + np.exp(-np.clip(logit(tx.words_of(f"{t} {x}")), -30, 30))) for x in (a, b))
            assert abs(p - q) < 0.05


def slow_loss(w, b, idx, y, pairs, penalty, ridge):
    """The fit's objective, row by row."""
    pos = sum(y) or 1
    weight = [(len(y) - sum(y)) / pos if t > 0 else 1.0 for t in y]
    z = [b + sum(w[i] for i in x) for x in idx]
    loss = sum(c * (np.logaddexp(0, s) - t * s) for c, s, t in zip(weight, z, y)) / sum(weight) + ridge / 2 * sum(v * v for v in w)
    return loss + (penalty / len(pairs) * sum((sum(w[i] for i in p) - sum(w[i] for i in q)) ** 2 for p, q in pairs) if pairs else 0.0)


def test_fit_reaches_the_minimum_of_a_slow_version():
    rng = np.random.default_rng(3)
    idx = [np.flatnonzero(rng.random(8) < 0.4) for _ in range(80)]
    y = np.array([float(rng.random() < (0.8 if 0 in x else 0.2)) for x in idx])
    pairs = [(np.array([0, 2]), np.array([1, 2])), (np.array([3]), np.array([4]))] * 5
    for penalty in (0.0, 2.0):
        w, b = tx.fit_logistic(idx, y, 8, pairs, penalty, ridge=0.05, rounds=3000)
        best = slow_loss(w, b, idx, y, pairs, penalty, 0.05)
        for i in range(9):  # the objective is convex: no step along an axis may lower it
            for step in (0.02, -0.02):
                v, c = w.copy(), b
                if i < 8:
                    v[i] += step
                else:
                    c += step
                assert slow_loss(v, c, idx, y, pairs, penalty, 0.05) > best - 1e-6


def test_swaps_stay_in_their_group():
    table = tx.swap_table()
    for row in tx.IDENTITY_TERMS:
        assert {table[a] for a in row} == set(row) and all(table[a] != a for a in row)


def test_odd_labels_and_rows(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ((1, "a vile text"), (2, None), (3, ""), (None, "x"), (1, "a vile text"))], DOCS)
    for rows in ([], [(1, None, 1), (2, None, None)], [(None, 1, 1)], [(1, 1, 1), (2, 0, 0), (3, 0, 0), (1, 0, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        out = tx.score_rows(docs, tx.train(docs, labels)).collect()
        assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
        assert not next(r for r in out if r["doc_id"] is None)["held_out"]
    assert tx.score_rows(docs.limit(0), tx.Model({}, 0.0)).count() == 0


def test_scores_use_the_whole_text(spark):
    model = tx.Model({"vile": 5.0}, -2.0)
    docs = spark.createDataFrame([(1, "word " * 200_000 + "vile", None, None, None), (2, "word", None, None, None)], DOCS)
    got = {r["doc_id"]: r["predicted"] for r in tx.score_rows(docs, model).collect()}
    assert got == {1: 1, 2: 0}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, read back, starting with the documents."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "source mixing", "best-fit packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_each_stage_equals_its_brute_force(spark, stages):
    from test_simhash_lines import slow_groups, slow_lines, slow_simhash
    rows = [[(r["doc_id"], r["text"], r["source"]) for r in df.collect()] for df in stages[:-1]]
    # toxicity: what the query predicts is what goes
    bad = {r["doc_id"] for r in queries.op9_toxicity(spark, SF).where("predicted = 1").collect()}
    assert bad and sorted(r[0] for r in rows[1]) == sorted(r[0] for r in rows[0] if r[0] not in bad)
    # line dedup
    want = [(i, t) for i, t, n, cut in slow_lines(rows[1], line_spread.MIN_SITES) if not (cut and not t.strip(" \t\r\n"))]
    assert sorted((i, t) for i, t, _ in rows[2]) == sorted(want)
    # near-dedup: one row of each group, its smallest id
    groups = slow_groups([(i, slow_simhash(t)) for i, t, _ in rows[2]])
    assert sorted(i for i, _, _ in rows[3]) == sorted(set(groups)) and len(rows[3]) < len(rows[2])
    # mixing keeps whole rows
    before = {r[0]: r for r in rows[3]}
    assert 0.2 * len(before) < len(rows[4]) < len(before) and all(before[r[0]] == r for r in rows[4])
    # packing: every token of every sampled document, once
    bins = stages[-1].collect()
    sizes = {i: len((t or "").split()) for i, t, _ in rows[4]}
    held = {}
    for b in bins:
        assert b["n_tokens"] == sum(p["n_tokens"] for p in b["pieces"]) <= pack_bestfit.CAPACITY
        assert b["doc_ids"] == [p["doc_id"] for p in b["pieces"]]
        for p in b["pieces"]:
            held[p["doc_id"]] = held.get(p["doc_id"], 0) + p["n_tokens"]
    assert held == sizes


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["bin_id", "n_tokens", "doc_ids", "pieces"]
    assert sorted(map(str, out.collect())) == sorted(map(str, stages[-1].collect()))


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "the same line of text here\n" * 3, None, None, 9, 1), (3, "word " * 40_000, "en", "s", None, 1)]
    schema = DOCS + ", slot int"
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            nxt = stage(spark, docs, SF)
            assert nxt.columns == docs.columns or i == 4
            nxt.write.parquet(f"{tmp_path}/{len(part)}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{len(part)}-{i}")
        assert (docs.count() > 0) == bool(part)


def test_queries_are_registered():
    import __spark_entry__ as e
    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
