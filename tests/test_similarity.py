import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalign.operators import similarity

from catalign.functions.vectors import cosine
from catalign.operators.matching import best_match, choose_source, cross_dataset_top_n
from catalign.operators.reshape import first_per_key
from catalign.operators.similarity import _best_k, as_items, grid_shape, score_range, top_matches

SF = "/root/testdata/sf0.001"


def _items(spark):
    return as_items(spark.read.parquet(f"{SF}/embeddings.parquet"), "label", "vec_id")


def test_best_k_ties_go_to_smaller_column():
    y = np.array([[1.0, 0.0], [0.6, 0.8], [0.6, 0.8], [0.0, 1.0], [0.6, 0.8]])
    x = np.array([[0.6, 0.8]])
    rows, cols, vals, _ = _best_k(x @ y.T, x, y, 2)
    assert cols.tolist() == [1, 2] and vals[0] == vals[1]
    scores = np.array([[-np.inf, 0.3, 0.2]])
    rows, cols, vals, _ = _best_k(scores, np.array([[1.0]]), np.array([[9.0], [0.3], [0.2]]), 5)
    assert cols.tolist() == [1, 2]


@pytest.mark.parametrize("n_left,n_right,batch", [(333, 37, 333), (333, 37, 1), (333, 1003, 7), (1, 1003, 1)])
def test_equal_vectors_score_equally_whatever_the_batch(spark, n_left, n_right, batch, monkeypatch):
    rng = np.random.default_rng(5)
    one = rng.normal(size=64).astype("float32")
    left = pa.table({"dataset": ["l"] * n_left, "item": np.arange(n_left), "embedding": list(rng.normal(size=(n_left, 64)).astype("float32"))})
    right = pa.table({"dataset": ["r"] * n_right, "item": np.arange(n_right)[::-1], "embedding": [one] * n_right})
    monkeypatch.setattr(similarity, "_MAX_SCORES", batch * n_right)
    schema = similarity.T._parse_datatype_string("dataset string, item long, target string, match long, score double")
    out = similarity._cell_function(2, False, False, False, False, schema)(left, right).to_pandas()
    assert (out.groupby("item")["match"].apply(list).map(tuple) == (0, 1)).all() and len(out) == 2 * n_left


def test_repeated_keys_are_tolerated(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("a", 2, [0.9, 0.1]), ("b", 3, [0.0, 1.0]), ("b", 3, [0.5, 0.5])],
                               "dataset string, item int, embedding array<double>")
    for cell_rows in (None, 1):
        out = top_matches(df, None, k=2, per_target=False, cell_rows=cell_rows).collect()
        best = {}
        for r in out:
            assert (r.dataset, r.item) != (r.target, r.match)
            best.setdefault(r.item, []).append((r["rank"], r.match))
        assert sorted(best[2]) == [(1, 1), (2, 1)]


def test_grid_shape_bounds():
    assert grid_shape(10, 10, 100, 8)[0] * grid_shape(10, 10, 100, 8)[1] >= 8
    gl, gr = grid_shape(1_000_000, 50_000, 8192, 8)
    assert 1_000_000 / gl <= 8192 and 50_000 / gr <= 8192


def test_kernel_equals_pairwise_expression(spark):
    items = _items(spark)
    k = top_matches(items, None, k=3, per_target=True, cell_rows=7)  # many small cells
    a = items.alias("a")
    b = items.select(F.col("dataset").alias("target"), F.col("item").alias("match"), F.col("embedding").alias("e2"))
    pairs = a.join(b, ~((F.col("dataset") == F.col("target")) & (F.col("item") == F.col("match"))))
    from pyspark.sql import Window
    w = Window.partitionBy("dataset", "item", "target").orderBy(F.desc("s"), "match")
    brute = (pairs.withColumn("s", cosine("embedding", "e2")).withColumn("rank", F.row_number().over(w))
             .filter("rank <= 3"))
    got = {(r.dataset, r.item, r.target, r.match, r["rank"], round(r.score, 9)) for r in k.collect()}
    exp = {(r.dataset, r.item, r.target, r.match, r["rank"], round(r.s, 9)) for r in brute.collect()}
    assert got == exp


def test_topn_properties(spark):
    out = cross_dataset_top_n(_items(spark), 3).collect()
    groups = {}
    for r in out:
        assert not (r.dataset == r.target and r.item == r.match)
        groups.setdefault((r.dataset, r.item, r.target), []).append(r)
    for g in groups.values():
        assert len(g) <= 3
        g.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in g] == list(range(1, len(g) + 1))
        assert all(g[i].score >= g[i + 1].score for i in range(len(g) - 1))


def test_zero_vector_scores_zero(spark):
    df = spark.createDataFrame([("a", 1, [0.0, 0.0]), ("b", 2, [1.0, 0.0]), ("b", 3, [-1.0, 0.0])],
                               "dataset string, item int, embedding array<double>")
    out = top_matches(df.filter("dataset = 'a'"), df.filter("dataset = 'b'"), k=2, per_target=False).collect()
    assert sorted((r.match, r.score, r["rank"]) for r in out) == [(2, 0.0, 1), (3, 0.0, 2)]


def test_best_match_and_range(spark):
    df = spark.createDataFrame([("l", 1, [1.0, 0.0]), ("r", 7, [0.9, 0.1]), ("r", 8, [0.0, 1.0]), ("r", 6, [0.9, 0.1])],
                               "dataset string, item int, embedding array<double>")
    out = best_match(df.filter("dataset='l'"), df.filter("dataset='r'")).collect()
    assert [(r.item, r.match) for r in out] == [(1, 6)]  # tie -> smaller key
    rng = score_range(df).first()
    assert abs(rng.max_score - 1.0) < 1e-12 and abs(rng.min_score - 0.0) < 1e-12
    grid = score_range(df, cell_rows=1).first()
    assert (grid.min_score, grid.max_score) == (rng.min_score, rng.max_score)


def test_within_dataset_only_compares_same_group(spark):
    df = spark.createDataFrame([("f0", 1, [1.0, 0.0]), ("f0", 2, [1.0, 0.1]), ("f1", 3, [1.0, 0.0])],
                               "dataset string, item int, embedding array<double>")
    left = df.filter("item = 1").unionByName(df.filter("item = 1").withColumn("dataset", F.lit("f1")))
    right = df.filter("item != 1")
    out = {(r.dataset, r.match) for r in top_matches(left, right, k=1, within_dataset=True, exclude_self=False).collect()}
    assert out == {("f0", 2), ("f1", 3)}


def test_rank_by_space_name(spark):
    items = _items(spark)
    names = items.select("dataset", "item", (F.col("item") % 7).cast("string").alias("space_name"))
    out = cross_dataset_top_n(items, 2, rank_by="space_name", space_name=names)
    g = out.groupBy("dataset", "target", "space_name").agg(F.max("rank").alias("m"), F.count("*").alias("n"))
    assert g.filter("m != n").count() == 0


def test_choose_source_threshold_and_priority(spark):
    best = spark.createDataFrame([("d", 1, "x", 10, 0.8), ("d", 1, "y", 11, 0.8), ("d", 2, "x", 12, 0.1)],
                                 "dataset string, item int, target string, match int, score double")
    out = {r.item: (r.database_choice, r.chosen_match) for r in choose_source(best, threshold=0.5, priority=["y", "x"]).collect()}
    assert out == {1: ("y", 11), 2: ("no_relevant_match", None)}


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "y"), ("b", 2, "x"), ("a", 1, "w")], "k string, o int, v string")
    out = sorted(tuple(r) for r in first_per_key(df, ["k"], ["o", "v"]).collect())
    assert out == [("a", 1, "w"), ("b", 2, "x")]


def test_cell_size_changes_nothing(spark):
    items = _items(spark)
    cols = ["dataset", "item", "target", "match", "score", "rank"]
    rows = [{tuple(r[c] for c in cols) for r in top_matches(items, None, k=3, cell_rows=c).collect()} for c in (None, 50, 13)]
    assert rows[0] == rows[1] == rows[2] and rows[0]
    left, right = items.filter("dataset < 5"), items.filter("dataset >= 5")
    g, b = ({(r.item, r.match, r.score, r["rank"]) for r in top_matches(left, right, k=2, per_target=False, cell_rows=c).collect()} for c in (40, None))
    assert g == b


@pytest.mark.parametrize("fall", [0.0, 1.5])
def test_bound_rules_pairs_out_and_changes_nothing(spark, fall):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 24)) * (1.0 / np.arange(1, 25) ** fall)
    v[50], v[60], v[70] = v[40], v[40], 0.0  # equal and zero vectors
    items = spark.createDataFrame([(f"d{i % 3}", i, [float(x) for x in r]) for i, r in enumerate(v)], "dataset string, item long, embedding array<double>")
    for per_target, k, cell_rows in ((True, 3, None), (False, 1, 400), (False, 5, 950)):
        how = dict(k=k, per_target=per_target, cell_rows=cell_rows)
        plain, bound = ({tuple(r) for r in top_matches(items, None, always_bound=a, **how).collect()} for a in (False, True))
        assert plain == bound and len(plain) == 900 * k * (3 if per_target else 1)
        for a in (False, True):
            share = similarity.scored_pairs(items, None, always_bound=a, **how).first()
            assert share["pairs"] == 900 * 900
            if a and fall and not per_target:
                assert share["scored"] < 0.2 * share["pairs"]


def test_single_precision_only_chooses_candidates():
    rng = np.random.default_rng(2)
    for d in (8, 300, 2000):
        x = similarity._unit_rows(pa.chunked_array([pa.array(rng.normal(size=(40, d)).tolist())]))
        y = np.repeat(x[:1], 60, axis=0) + rng.normal(size=(60, d)) * 1e-9  # all but equal scores
        y /= np.linalg.norm(y, axis=1)[:, None]
        single = x.astype(np.float32) @ y.astype(np.float32).T
        assert np.abs(single - x @ y.T).max() <= similarity._rounding(d) / 2
        rows, cols, vals, _ = _best_k(single, x, y, 4)
        want = similarity._pair_scores(x, y, *(g.ravel() for g in np.indices((40, 60)))).reshape(40, 60)
        for i in range(40):
            assert sorted(range(60), key=lambda j: (-want[i, j], j))[:4] == cols[rows == i].tolist()


def test_top_matches_with_range_equals_separate_passes(spark):
    from catalign.operators.similarity import top_matches_with_range
    items = _items(spark)
    for cell_rows in (None, 60):
        top, lo, hi = top_matches_with_range(items, None, k=3, per_target=False, cell_rows=cell_rows)
        ref = top_matches(items, None, k=3, per_target=False, cell_rows=cell_rows)
        cols = ["dataset", "item", "target", "match", "rank"]
        assert {tuple(r[c] for c in cols) for r in top.collect()} == {tuple(r[c] for c in cols) for r in ref.collect()}
        rng = score_range(items, exclude_self=True, cell_rows=cell_rows).first()
        assert abs(lo - rng.min_score) < 1e-12 and abs(hi - rng.max_score) < 1e-12


def test_small_cells_send_no_more_candidates_and_hold_few_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    table = lambda n, ds: pa.table({"dataset": [f"{ds}{i % 2}" for i in range(n)], "item": np.arange(n), "embedding": list(rng.normal(size=(n, 8)))})
    left, right, held, unit = table(60, "a"), table(90, "b"), [], similarity._unit_rows
    schema = similarity.T._parse_datatype_string("dataset string, item long, target string, match long, score double")
    monkeypatch.setattr(similarity, "_unit_rows", lambda c: held.append(len(c)) or unit(c))
    rows = [similarity._cell_function(3, True, False, False, False, schema, most=m)(left, right).to_pylist() for m in (7, 1000)]
    key = lambda r: (r["item"], r["target"], -r["score"], r["match"])
    assert sorted(rows[0], key=key) == sorted(rows[1], key=key) and len(rows[0]) == 60 * 2 * 3  # not so many a cell
    monkeypatch.setattr(similarity, "TILE_ROWS", 10)
    monkeypatch.setattr(similarity, "AXES_ROWS", 10)
    held.clear()
    similarity._cell_function(3, True, False, False, False, schema)(left, right)
    assert held[0] == 60 and max(held[1:]) <= 20  # the right side comes by tiles


def test_a_group_is_a_fixed_share_of_memory():
    left, right = similarity.cell_rows_for(64, similarity.LEFT_MB), similarity.cell_rows_for(64)
    gl, gr = grid_shape(600_000, 600_000, right, 12, left)
    assert 600_000 / gl <= left == 32_768 and 600_000 / gr <= right
    assert grid_shape(100, 1_000_000, right, 12, left)[0] <= 2  # few left rows are not dealt out against many right ones


def _tied_table(n, seed):
    """Rows of which some vectors are zero, some equal, and some keys come twice."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8)).astype("float32")
    v[1::9], v[::17] = v[2:3], 0.0
    item = np.where(np.arange(n) % 23 == 0, np.arange(n) // 2, np.arange(n))
    return pa.table({"dataset": [f"d{i % 3}" for i in item], "item": item, "embedding": list(v)})


@pytest.mark.parametrize("strip,most", [(8192, None), (8192, 30), (40, 7), (8, 1)])
@pytest.mark.parametrize("per_target,within", [(True, False), (False, False), (True, True)])
def test_zero_equal_and_repeated_rows_rank_as_every_pair_scored(strip, most, per_target, within, monkeypatch):
    left, right = _tied_table(150, 1), _tied_table(260, 1)
    monkeypatch.setattr(similarity, "TILE_ROWS", strip)
    schema = similarity.T.StructType().add("dataset", "string").add("item", "long").add("target", "string").add("match", "long").add("score", "double")
    x, y = (similarity._unit_rows(t.column("embedding")) for t in (left, right))
    a, b = ([(r["dataset"], r["item"]) for r in t.drop_columns(["embedding"]).to_pylist()] for t in (left, right))
    score = similarity._pair_scores(x, y, *(g.ravel() for g in np.indices((150, 260)))).reshape(150, 260)
    want = []
    for i, key in enumerate(a):
        pairs = sorted(((b[j][0] if per_target or within else ""), -score[i, j], *b[j]) for j in range(260) if b[j] != key and (not within or b[j][0] == key[0]))
        for group in {p[0] for p in pairs}:
            want += [(*key, p[2], p[3], round(-p[1], 12) + 0.0) for p in [p for p in pairs if p[0] == group][:3]]
    for always in (False, True):
        got = similarity._cell_function(3, per_target, True, within, False, schema, always, most)(left, right).to_pylist()
        assert sorted((r["dataset"], r["item"], r["target"], r["match"], round(r["score"], 12) + 0.0) for r in got) == sorted(want)


def test_zero_vectors_and_small_cells_score_few_pairs():
    table = _tied_table(1200, 3)
    shares = []
    for most in (30, 400):
        work = similarity._Cell(table, table, True, True, False, most)
        pairs, scored = np.sum([f[3:] for f in similarity._search(work, work.bound(), 3)], axis=0)
        assert pairs == 1200 * 1200
        shares.append(scored / pairs)
    assert max(shares) < 0.04, shares
