import pytest
from pyspark.sql import functions as F

from catalign.functions.arrays import non_empty
from catalign.functions.columns import (columns_first, copy_key, drop_flagged, nan_to_null, priority, rename,
                                        rename_strict, replace_text, similarity_to_distance, simplify, tag)
from catalign.functions.vectors import cosine
from catalign.operators.checks import require_columns, uniqueness_counts
from catalign.operators.joins import union_all
from catalign.specs import SPECS, Paths, simplify_items


def test_projection_helpers(spark):
    df = spark.createDataFrame([("a", 1.0, "FNDDS x")], "name string, v double, src string")
    assert rename(df, {"name": "food_name", "missing": "x"}).columns == ["food_name", "v", "src"]
    with pytest.raises(ValueError):
        rename_strict(df, {"missing": "x"})
    assert columns_first(df, ["src"]).columns == ["src", "name", "v"]
    assert tag(df, "HPP").first().dataset == "HPP"
    assert copy_key(df, "name", "space_name", True).first().space_name == "a"
    assert "space_name" not in copy_key(df, "name", "space_name", False).columns
    assert df.select(replace_text("src", "FNDDS", "SR_Legacy")).first()[0] == "SR_Legacy x"
    assert df.drop("v").columns == ["name", "src"]


def test_priority_and_flags(spark):
    df = spark.createDataFrame([("Zameret", True), ("SR", None), ("HPP", False)], "d string, unlikely_food_item boolean")
    assert [r[0] for r in df.select(priority("d", ["Zameret", "HPP"])).collect()] == [1, 2, 1]
    assert sorted(r.d for r in drop_flagged(df).collect()) == ["HPP", "SR"]


def test_nan_and_distance(spark):
    df = spark.createDataFrame([(float("nan"), 1.2), (0.5, -0.3)], "x double, s double")
    assert nan_to_null(df).first().x is None
    d = [r[0] for r in df.select(similarity_to_distance("s", 2.0)).collect()]
    assert d == [0.0, 0.5]


def test_simplify_with_mask_and_spec(spark):
    df = spark.createDataFrame([("h1", "desc", "hint", True), ("h2", "d2", "h2", False)],
                               "hebrew_name string, short_description string, category_hint string, flag boolean")
    out = {r.hebrew_name: r for r in simplify(df, ["short_description"], F.col("flag")).collect()}
    assert out["h1"].short_description is None and out["h2"].short_description == "d2"
    allnull = simplify_items(df, SPECS["HPP"]).first()
    assert allnull.short_description is None and allnull.category_hint is None and allnull.hebrew_name == "h1"


def test_checks_and_union(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    with pytest.raises(ValueError, match="missing"):
        require_columns(df, ["k", "z"])
    r = uniqueness_counts(df, "k").first()
    assert (r.n_rows, r.n_distinct) == (3, 2)
    u = union_all([df, spark.createDataFrame([(1,)], "v int")])
    assert sorted(u.columns) == ["k", "v"] and u.count() == 4


def test_array_and_vector_helpers(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], ["x"]), ([0.0, 0.0], [1.0, 1.0], [])],
                               "a array<double>, b array<double>, l array<string>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [0.0, 0.0]
    assert [r[0] for r in df.select(non_empty("l")).collect()] == [True, False]


def test_paths():
    p = Paths("s3a://bucket/base", "HPP", "SR_Legacy")
    assert p.items == "s3a://bucket/base/HPP/FoodItems"
    assert p.embeddings == "s3a://bucket/base/HPP/SR_Legacy/Embeddings"
    assert p.top_n("SR_Legacy", 3).endswith("AggregatedMap/SR_Legacy/top_3")
    with pytest.raises(ValueError):
        Paths("/x", "HPP").top_match
