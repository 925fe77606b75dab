from pyspark.sql import Window
from pyspark.sql import functions as F

from catalign.operators.checks import column_profile, duplicate_keys
from catalign.operators.reshape import match_lists, melt_match_lists, pivot_first
from catalign.operators.tables import markdown_cells, promote_header, rank_within, row_slice, transpose_rows


def test_rank_within_matches_window_with_a_hot_group(spark):
    df = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 1000).alias("score"), F.col("id"))
    df = df.repartition(16)
    got = rank_within(df, ["g"], [F.desc("score"), "id"]).select("id", "rank")
    w = Window.partitionBy("g").orderBy(F.desc("score"), "id")
    exp = df.withColumn("rank", F.row_number().over(w)).select("id", "rank")
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_markdown_cells_rules(spark):
    text = "| a | b | c |\n|---|:--:|---|\n| 1 |  | x |\n| 2 |  | y |\n\n"
    df = spark.createDataFrame([(7, text)], "doc int, text string")
    out = sorted(tuple(r) for r in markdown_cells(df, "doc", "text").collect())
    assert out == [(7, 1, 1, "a", "1"), (7, 1, 3, "c", "x"), (7, 2, 1, "a", "2"), (7, 2, 3, "c", "y")]


def test_promote_header_and_transpose(spark):
    rows = spark.createDataFrame([(0, "t", None), (1, "Na\nme", "Val"), (2, "tag", "V"), (3, "u", "g"), (4, "x", "1")],
                                 "_idx long, a string, b string")
    table = promote_header(rows, "_idx", 1, ["a", "b"])
    assert table.columns == ["_idx", "Name", "Val"]
    meta = {r.column_name: (r.tag, r.unit) for r in transpose_rows(table, "_idx", [2, 3], ["Val"], ["tag", "unit"]).collect()}
    assert meta == {"Val": ("V", "g")}


def test_row_slice_positions(spark):
    df = spark.range(0, 1000).repartition(7).withColumn("v", (F.col("id") * 37) % 1000)
    out = row_slice(df, ["v", "id"], 10, 20).orderBy("position").collect()
    assert [r.position for r in out] == list(range(10, 20))
    assert [r.v for r in out] == list(range(10, 20))


def test_pivot_first_respects_order_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (1, "a", 5.0, 2), (1, "a", 7.0, 3), (1, None, 9.0, 0)],
                               "k int, n string, v double, o int")
    out = pivot_first(df, ["k"], "n", "v", ["o"])
    assert out.columns == ["k", "a"] and out.first().a == 5.0


def test_match_list_round_trip(spark):
    top = spark.createDataFrame([("d", 1, "x", 10, 0.5), ("d", 1, "x", 11, 0.9), ("d", 1, "y", 12, 0.1)],
                                "dataset string, item int, target string, match int, score double")
    wide = match_lists(top, ["dataset", "item"], "target", "match", "score", ["x", "y", "z"])
    r = wide.first()
    assert [p.name for p in r.x] == [11, 10] and r.z is None
    long = melt_match_lists(wide, ["dataset", "item"], ["x", "y", "z"])
    assert sorted((x.matched_dataset, x.matched_name) for x in long.collect()) == [("x", 10), ("x", 11), ("y", 12)]


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in duplicate_keys(df, ["k"]).collect()] == [("a", 2)]
    prof = {r.column_name: (r.non_null, r.has_values) for r in column_profile(df).collect()}
    assert prof == {"k": (3, True), "v": (2, True)}
