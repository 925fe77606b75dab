from pyspark.sql import functions as F

from catalign.operators.consolidate import transfer_facts
from catalign.operators.impute import facts_long, facts_wide, impute, knn_values, nearest_donors

VEC = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.7, 0.7]), (5, [1.0, 0.0])]


def _setup(spark, facts):
    vec = spark.createDataFrame(VEC, "item int, embedding array<double>")
    f = spark.createDataFrame(facts, "item int, fact string, value double")
    return f, vec


def test_k1_takes_nearest_donor_and_keeps_known(spark):
    f, vec = _setup(spark, [(1, "a", None), (2, "a", 20.0), (3, "a", 30.0), (4, "a", 40.0), (5, "a", 50.0)])
    out = {r.item: (r.value, r.imputed) for r in impute(f, vec, k=1).collect()}
    assert out[1] == (50.0, True)  # item 5 is identical (distance 0)
    assert out[2] == (20.0, False)


def test_distance_zero_rule_and_weights(spark):
    f, vec = _setup(spark, [(1, "a", None), (2, "a", 20.0), (4, "a", 40.0), (5, "a", 50.0)])
    got = {r.item: r.imputed for r in knn_values(f, vec, k=3, weights="distance").collect()}
    assert got[1] == 50.0  # only the zero-distance donor counts
    f2, _ = _setup(spark, [(1, "a", None), (2, "a", 20.0), (4, "a", 40.0)])
    import math
    d2 = 1 - 0.9 / math.hypot(0.9, 0.1)
    d4 = 1 - 0.7 / math.hypot(0.7, 0.7)
    exp = (20 / d2 + 40 / d4) / (1 / d2 + 1 / d4)
    got = knn_values(f2, vec, k=3, weights="distance").first().imputed
    assert abs(got - exp) < 1e-9
    uni = knn_values(f2, vec, k=3, weights="uniform").first().imputed
    assert abs(uni - 30.0) < 1e-12


def test_no_donor_stays_null_and_k1_equivalence(spark):
    f, vec = _setup(spark, [(1, "a", None), (2, "b", None), (3, "b", 3.0), (4, "a", 4.0)])
    k1 = {(r.item, r.fact): r.value for r in impute(f, vec, k=1).collect()}
    k1u = {(r.item, r.fact): r.value for r in impute(f, vec, k=1, weights="uniform").collect()}
    assert k1 == k1u
    f3, _ = _setup(spark, [(1, "c", None), (2, "c", None)])
    assert all(r.value is None for r in impute(f3, vec, k=1).collect())


def test_long_wide_round_trip(spark):
    wide = spark.createDataFrame([(1, 1.0, float("nan")), (2, None, 2.0)], "item int, x double, y double")
    long = facts_long(wide, "item", ["x", "y"])
    assert long.filter(F.col("value").isNull()).count() == 2
    back = {r.item: (r.x, r.y) for r in facts_wide(long, ["x", "y"]).collect()}
    assert back == {1: (1.0, None), 2: (None, 2.0)}


def test_transfer_priority_and_means(spark):
    matches = spark.createDataFrame([
        ("H", "i1", "Z", "z1", 0.9), ("H", "i1", "S", "s1", 0.8), ("H", "i1", "S", "s2", 0.6),
        ("H", "i2", "Z", "z1", 0.5)], "dataset string, item string, matched_dataset string, matched_item string, matched_score double")
    facts = spark.createDataFrame([("Z", "z1", 1.0, 5.0), ("S", "s1", None, 7.0), ("S", "s2", None, 9.0)],
                                  "dataset string, item string, fat double, sugar double")
    out = {r.item: r for r in transfer_facts(matches, facts, ["fat", "sugar"], low_priority=["Z"]).collect()}
    assert out["i1"].fat == 1.0 and out["i1"].sugar == 8.0 and abs(out["i1"].matched_score - 0.7) < 1e-12
    assert out["i2"].fat == 1.0 and out["i2"].matched_score == 0.5


def _emb_facts(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    e = F.col("embedding")
    wide = emb.select(F.col("vec_id").alias("item"), F.when(e[1] > 0, e[0].cast("double")).alias("f0"),
                      F.when(e[3] > 0.3, e[2].cast("double")).alias("f1"))
    return wide.unpivot(["item"], ["f0", "f1"], "fact", "value"), emb.select(F.col("vec_id").alias("item"), "embedding")


def test_list_length_changes_nothing(spark):
    facts, vec = _emb_facts(spark)
    def run(**kw):  # values compared to 12 places: summation order may differ
        return {(r.item, r.fact): (None if r.value is None else round(r.value, 12)) for r in impute(facts, vec, **kw).collect()}
    for k in (1, 3):
        whole = run(k=k, neighbours=10_000)  # every list holds every item
        few = run(k=k, neighbours=k)  # most lists are doubled
        assert whole == few == run(k=k) == run(k=k, neighbours=k, cell_rows=40)


def test_donors_equal_brute_force(spark):
    import random
    rng = random.Random(7)
    vec = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    vec[10], vec[11], vec[12] = (10, vec[9][1]), (11, vec[9][1]), (12, [0.0] * 4)  # equal and zero vectors
    facts = [(i, f, rng.random() if rng.random() < p else None) for i, _ in vec for f, p in (("common", 0.8), ("rare", 0.05), ("none", 0.0), ("all", 1.0))]
    unit = {i: [x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for i, v in vec}
    want = set()
    for i, f, value in facts:
        if value is None:
            donors = sorted((-round(sum(a * b for a, b in zip(unit[i], unit[j])), 12), j) for j, g, v in facts if g == f and v is not None)
            want |= {(i, f, j, r + 1) for r, (_, j) in enumerate(donors[:3])}
    f = spark.createDataFrame(facts, "item int, fact string, value double")
    v = spark.createDataFrame(vec, "item int, embedding array<double>")
    for how in (dict(neighbours=1), dict(neighbours=40), dict(neighbours=3, cell_rows=17)):
        assert {(r.item, r.fact, r.donor, r["rank"]) for r in nearest_donors(f, v, 3, **how).collect()} == want


def test_ties_at_the_edge_widen_the_list(spark):
    # items 2, 3 and 4 are identical: a one-neighbour list cannot prove which donor is first
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.6, 0.8]), (4, [0.6, 0.8])],
                                "item int, embedding array<double>")
    facts = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", 30.0), (4, "a", 40.0), (2, "b", 5.0)],
                                  "item int, fact string, value double")
    got = {(r.item, r.fact): r.value for r in impute(facts, vec, k=1, neighbours=1).collect()}
    exp = {(r.item, r.fact): r.value for r in impute(facts, vec, k=1, neighbours=100).collect()}
    assert got == exp and got[(1, "a")] == 30.0 and got[(2, "a")] == 30.0


def test_long_and_wide_transfer_agree(spark):
    from catalign.operators.consolidate import transfer_facts_long
    from catalign.operators.similarity import as_items, top_matches
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    items = as_items(emb, "label", "vec_id")
    top = top_matches(items, None, k=2).filter("target != dataset")
    matches = top.select("dataset", "item", F.col("target").alias("matched_dataset"),
                         F.col("match").alias("matched_item"), F.col("score").alias("matched_score"))
    e = F.col("embedding")
    wide = emb.select(F.col("label").alias("dataset"), F.col("vec_id").alias("item"),
                      F.when(e[1] > 0, e[0].cast("double")).alias("f0"), F.when(e[3] > 0, e[2].cast("double")).alias("f1"))
    long = wide.unpivot(["dataset", "item"], ["f0", "f1"], "fact", "value")
    w = {(r.dataset, r.item, f): (None if r[f] is None else round(r[f], 12))
         for r in transfer_facts(matches, wide, ["f0", "f1"], low_priority=[1, 2]).collect() for f in ("f0", "f1")}
    lg = {(r.dataset, r.item, r.fact): round(r.value, 12)
          for r in transfer_facts_long(matches, long, low_priority=[1, 2]).collect()}
    assert {k: v for k, v in w.items() if v is not None} == lg
