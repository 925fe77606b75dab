import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from catalign.sources.readers import (literal_table, read_binary_files, read_chunk_files, read_csv, read_nested_json, read_parquet,
                                      read_sheet_rows)
from catalign.sources.sinks import (commit_output, dedupe_names, output_exists, process_new_keys, read_committed,
                                    read_manifest, replace_rows, run_chunks, run_unless_exists, wide_matrix, write_csv, write_parquet)
from catalign.streaming.incremental import image_payloads, process_new_files


def test_parquet_dir_and_pruning(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, "b", 1.5)], "id long, s string, x double")
    write_parquet(df, f"{tmp_dir}/t", partition_by=["s"])
    back = read_parquet(spark, f"{tmp_dir}/t", columns=["id", "x"])
    assert back.columns == ["id", "x"]
    assert sorted((r.id, r.x) for r in back.collect()) == [(1, None), (2, 1.5)]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,x:double>" in plan


def test_csv_keep_empty_and_nulls(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.csv")
    with open(p, "w") as f:
        f.write("id,name,cat\n1,milk,\n2,,dairy\n")
    d = read_csv(spark, p, "id long, name string, cat string")
    assert sorted(tuple(r) for r in d.collect()) == [(1, "milk", None), (2, None, "dairy")]
    k = read_csv(spark, p, "id long, name string, cat string", keep_empty_strings=True)
    assert sorted(tuple(r) for r in k.collect()) == [(1, "milk", ""), (2, "", "dairy")]
    write_csv(k, f"{tmp_dir}/out")
    assert spark.read.option("header", True).csv(f"{tmp_dir}/out").count() == 2


def test_nested_json(spark, tmp_dir):
    doc = {"SurveyFoods": [
        {"description": "tea", "foodNutrients": [{"nutrient": {"name": "Fat"}, "amount": 1.0},
                                                {"nutrient": {"name": "Fat"}, "amount": 3.0}]},
        {"description": "water", "foodNutrients": []}]}
    p = os.path.join(tmp_dir, "f.json")
    with open(p, "w") as f:
        json.dump(doc, f)
    rows = read_nested_json(spark, p, "SurveyFoods")
    assert sorted(r.description for r in rows.collect()) == ["tea", "water"]


def test_sheet_rows_keep_order(spark, tmp_dir):
    p = os.path.join(tmp_dir, "s.csv")
    with open(p, "w") as f:
        f.write("title,,\n,,\nh1,h2,h3\n1,a,\n2,b,x\n")
    rows = read_sheet_rows(spark, p, 3)
    got = [(r["_idx"], r["_c0"]) for r in rows.orderBy("_idx").collect()]
    assert got == [(0, "title"), (1, ""), (2, "h1"), (3, "1"), (4, "2")]


def test_binary_files(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/img")
    for n in ["p1.jpg", "p2.png"]:
        with open(f"{tmp_dir}/img/{n}", "wb") as f:
            f.write(b"\x00\x01" + n.encode() * 100)
    out = read_binary_files(spark, f"{tmp_dir}/img").collect()
    assert [r.name for r in out] == ["p1.jpg"]
    assert out[0].payload_b64 == base64.b64encode(b"\x00\x01" + b"p1.jpg" * 100).decode()


def test_literal_dimension(spark):
    d = literal_table(spark, [("01", "Grains"), ("02", "Potatoes and Starches")], "code string, category string")
    assert d.filter(F.col("code") == "01").first().category == "Grains"


def test_skip_if_exists(spark, tmp_dir):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)
    path = f"{tmp_dir}/once"
    assert run_unless_exists(spark, path, compute) is True
    assert output_exists(spark, path)
    assert run_unless_exists(spark, path, compute) is False
    assert run_unless_exists(spark, path, compute, overwrite=True) is True
    assert len(calls) == 2


def test_chunked_restart(spark, tmp_dir):
    items = spark.range(10).withColumnRenamed("id", "k")
    path = f"{tmp_dir}/chunks"
    seen = []

    def compute(df):
        seen.append(sorted(r.chunk for r in df.select("chunk").distinct().collect()))
        return df.withColumn("v", F.col("k") * 2)
    ids = lambda df: sorted(r[0] for r in df.collect())
    all_ids = ids(items.select(F.pmod(F.xxhash64("k"), F.lit(4)).cast("long").alias("chunk")).distinct())  # 10 rows by 3 are 4 chunks
    assert ids(run_chunks(spark, items, ["k"], 3, path, compute, chunk_end=2)) == [c for c in all_ids if c < 2]
    assert ids(run_chunks(spark, items, ["k"], 3, path, compute)) == [c for c in all_ids if c >= 2]
    assert ids(run_chunks(spark, items, ["k"], 3, path, compute)) == []
    assert spark.read.parquet(path).count() == 10
    # a lost chunk alone is redone
    import shutil
    shutil.rmtree(f"{path}/chunk={all_ids[0]}")
    assert ids(run_chunks(spark, items, ["k"], 3, path, compute)) == all_ids[:1]
    assert ids(run_chunks(spark, items, ["k"], 3, path, compute, chunk_start=all_ids[-1], overwrite=True)) == all_ids[-1:]
    assert spark.read.parquet(path).count() == 10


def test_chunks_follow_an_input_that_grows_changes_and_shrinks(spark, tmp_dir):
    path, asked = f"{tmp_dir}/chunks", []
    frame = lambda rows: spark.createDataFrame(rows, "k long, x string")

    def compute(df):
        asked.append(sorted((r.k if r.k is not None else -1) for r in df.collect()))
        return df.withColumn("y", F.upper("x"))
    first = [(k, f"a{k}") for k in range(10, 20)]
    second = [(k, f"a{k}") for k in range(5, 20)] + [(None, "n")]
    third = [(k, "new" if k == 12 else f"a{k}") for k in range(5, 18)] + [(None, "n")]
    for rows in (first, second, second, third):
        run_chunks(spark, frame(rows), ["k"], 5, path, compute)
    assert asked == [list(range(10, 20)), [-1, *range(5, 10)], [12]]
    got = sorted(((r.k, r.y) for r in spark.read.parquet(path).collect()), key=str)
    assert got == sorted(((k, x.upper()) for k, x in third), key=str)
    # rows that left a chunk empty take its folder with them
    run_chunks(spark, frame([(12, "new")]), ["k"], 5, path, compute)
    assert [(r.k, r.y) for r in spark.read.parquet(path).collect()] == [(12, "NEW")] and len(asked) == 3
    with pytest.raises(ValueError):
        run_chunks(spark, frame([(1, "a"), (1, "b")]), ["k"], 5, path, compute)


def test_chunk_run_that_breaks_off_is_repeated(spark, tmp_dir):
    items, path, asked = spark.range(20).withColumnRenamed("id", "k"), f"{tmp_dir}/chunks", []

    def compute(df):
        asked.append(df.count())
        return df.filter("k % 4 <> 0")  # some rows have no output

    def broken(*_):
        raise RuntimeError("stopped")
    with pytest.raises(RuntimeError):
        run_chunks(spark, items, ["k"], 5, path, compute, then=broken)
    run_chunks(spark, items, ["k"], 5, path, compute)
    run_chunks(spark, items, ["k"], 5, path, compute)
    assert asked == [20, 20] and spark.read.parquet(path).count() == 15


def test_only_a_published_output_counts(spark, tmp_dir):
    path, ran = f"{tmp_dir}/out", []
    os.makedirs(f"{path}/_temporary/0")
    spark.range(3).write.parquet(f"{path}/data-left")
    work = lambda n: lambda: ran.append(n) or spark.range(n)
    assert read_manifest(spark, path) is None
    assert run_unless_exists(spark, path, work(5)) and not run_unless_exists(spark, path, work(6))
    assert read_committed(spark, path, verify=True).count() == 5 and not os.path.exists(f"{path}/data-left")
    # readers keep the old version until the new one is published
    with pytest.raises(RuntimeError):
        run_unless_exists(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("stopped")), overwrite=True)
    assert read_committed(spark, path).count() == 5
    assert run_unless_exists(spark, path, work(7), overwrite=True)
    manifest = read_manifest(spark, path)
    assert (manifest["rows"], read_committed(spark, path).count(), ran) == (7, 7, [5, 7])
    data = f"{path}/data-{manifest['version']}"
    os.remove(next(f"{data}/{f}" for f in sorted(os.listdir(data)) if f.startswith("part-") and spark.read.parquet(f"{data}/{f}").count()))
    with pytest.raises(ValueError):
        read_committed(spark, path, verify=True)
    with pytest.raises(FileNotFoundError):
        read_committed(spark, f"{tmp_dir}/nothing")


def test_partitioned_and_empty_outputs_are_published(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, p string")
    commit_output(df, f"{tmp_dir}/p", ["p"])
    assert sorted((r.k, r.p) for r in read_committed(spark, f"{tmp_dir}/p", verify=True).collect()) == [(1, "a"), (2, None)]
    assert commit_output(df.limit(0), f"{tmp_dir}/e")["rows"] == 0
    assert read_committed(spark, f"{tmp_dir}/e", verify=True).schema == df.schema


def test_null_keys_are_processed_once(spark, tmp_dir):
    items = spark.createDataFrame([(1, "a"), (None, "b"), (None, None)], "k long, s string")
    new = [process_new_keys(spark, items, ["k", "s"], f"{tmp_dir}/log", lambda d: d, f"{tmp_dir}/out") for _ in range(3)]
    assert new == [3, 0, 0] and spark.read.parquet(f"{tmp_dir}/out").count() == 3


def test_processed_log(spark, tmp_dir):
    items = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "name string")
    out, log = f"{tmp_dir}/out", f"{tmp_dir}/log"
    assert process_new_keys(spark, items, "name", log, lambda d: d, out) == 2
    assert process_new_keys(spark, items, "name", log, lambda d: d, out) == 0
    more = items.unionByName(spark.createDataFrame([("c.jpg",)], "name string"))
    assert process_new_keys(spark, more, "name", log, lambda d: d, out) == 1
    assert spark.read.parquet(out).count() == 3


def test_incremental_file_stream(spark, tmp_dir):
    src = f"{tmp_dir}/pages"
    os.makedirs(src)
    for n in ["a.jpg", "b.jpg"]:
        with open(f"{src}/{n}", "wb") as f:
            f.write(n.encode())
    out, ck = f"{tmp_dir}/payloads", f"{tmp_dir}/ck"
    process_new_files(spark, src, out, ck, image_payloads, glob="*.jpg")
    assert spark.read.parquet(out).count() == 2
    process_new_files(spark, src, out, ck, image_payloads, glob="*.jpg")
    assert spark.read.parquet(out).count() == 2
    with open(f"{src}/c.jpg", "wb") as f:
        f.write(b"c")
    process_new_files(spark, src, out, ck, image_payloads, glob="*.jpg")
    assert sorted(r.name for r in spark.read.parquet(out).collect()) == ["a.jpg", "b.jpg", "c.jpg"]


def test_wide_matrix_with_duplicate_names(spark):
    pairs = spark.createDataFrame([("x", "m", 1, 0.5), ("x", "m", 2, 0.7), ("y", "n", 3, 0.1)],
                                  "row string, col string, ord int, v double")
    named = dedupe_names(pairs, "col", ["ord"])
    w = wide_matrix(named, "row", "col", "v")
    assert sorted(w.columns) == ["m", "m_1", "n", "row"]
    r = {x.row: x for x in w.collect()}
    assert r["x"].m == 0.5 and r["x"].m_1 == 0.7 and r["y"].n == 0.1


def test_chunk_files_of_several_generations(spark, tmp_dir):
    path = f"{tmp_dir}/chunks"
    spark.sql("select 1 as k, 2 as v, 'a' as s").write.parquet(f"{path}/1")
    spark.sql("select 2L as k, 2.5d as v").write.parquet(f"{path}/2")
    spark.sql("select float(0.5) as v, date'2020-01-02' as d, 3L as k, 'NaN' as s").write.parquet(f"{path}/3")
    out = read_chunk_files(spark, path)
    assert dict(out.dtypes) == {"k": "bigint", "v": "double", "s": "string", "d": "date"}
    got = sorted((r.k, r.v, r.s, str(r.d)) for r in out.collect())
    assert got == [(1, 2.0, "a", "None"), (2, 2.5, None, "None"), (3, 0.5, "NaN", "2020-01-02")]
    plan = read_chunk_files(spark, path, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:int>" in plan and "struct<k:int,v" not in plan
    spark.sql("select 'x' as v").write.parquet(f"{path}/4")
    with pytest.raises(ValueError, match="/4/"):
        read_chunk_files(spark, path)


def test_wider_types():
    from catalign.sources.readers import wider_type
    assert [wider_type(*p) for p in (("int", "bigint"), ("int", "double"), ("bigint", "double"), ("float", "int"), ("date", "timestamp"), ("void", "string"), ("string", "int"))] == [
        "bigint", "double", "double", None, "timestamp", "string", None]


def test_bucketed_tables_join_without_an_exchange(spark):
    from catalign.queries.facts import fact_transfer_bucketed
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan is fixed before it runs
    try:
        plan = fact_transfer_bucketed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 3
    lines = [x.lstrip(" :+-*()0123456789") for x in plan.splitlines()]
    assert sum(x.startswith("Exchange") for x in lines) == 1  # of the aggregate between the two joins


def test_more_chunks_than_folders_share_them(spark, tmp_dir, monkeypatch):
    from catalign.sources import sinks
    monkeypatch.setattr(sinks, "MAX_FOLDERS", 4)
    path, asked = f"{tmp_dir}/chunks", []
    frame = lambda rows: spark.createDataFrame(rows, "k long, x string")

    def compute(df):
        asked.append(sorted(r.k for r in df.collect()))
        return df.withColumn("y", F.upper("x"))
    first = [(k, f"a{k}") for k in range(40)]
    second = [(k, "new" if k == 12 else f"a{k}") for k in range(2, 45)]
    for rows in (first, second, second, [(12, "new")]):
        run_chunks(spark, frame(rows), ["k"], 2, path, compute)
        got = spark.read.parquet(path)
        assert sorted((r.k, r.y) for r in got.collect()) == sorted((k, x.upper()) for k, x in rows)
        folders = [f for f in os.listdir(path) if "=" in f]
        assert len(folders) <= 4 and all(sum(f.endswith(".parquet") for f in os.listdir(f"{path}/{d}")) == 1 for d in folders)
    assert asked == [list(range(40)), [12, *range(40, 45)]]
    assert got.select("chunk").distinct().count() == 1


def test_chunk_generations_takes_keys_of_any_size(spark, tmp_dir):
    from catalign.queries.flows import chunk_generations
    keys = [3, 4, 5, 32_768, 32_769, 32_770, 40_001, 3 * 2 ** 32, 2 + 3 * 2 ** 32, None]
    c = spark.createDataFrame([(k, 7, 1.25, "s", f"c{k}") for k in keys], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string, c_name string")
    c.write.parquet(f"{tmp_dir}/customer.parquet")
    got = {r.k: (r.v, r.note, r.name) for r in chunk_generations(spark, tmp_dir).collect()}
    assert got == {k: (7.0 if k % 3 == 0 else 1.25, "s" if k % 3 else None, f"c{k}" if k % 3 < 2 else None) for k in keys if k is not None}


def test_folders_that_are_not_there_are_written_without_a_checkpoint(spark, tmp_dir, monkeypatch):
    import catalign.session as session
    kept, real, path = [], session.materialize, f"{tmp_dir}/out"
    monkeypatch.setattr(session, "materialize", lambda df: kept.append(df) or real(df))
    table = lambda *rows: spark.createDataFrame(rows, "k long, v string, chunk long")
    put = lambda new, current: replace_rows(spark, path, new, ["k"], new, current, new.select("chunk").distinct(), "chunk")
    rows = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "chunk").collect())
    first, other = table((1, "a", 0), (2, "b", 0)), table((3, "c", 1))
    put(first, first)
    put(other, first.union(other))
    assert not kept and rows() == [(1, "a", 0), (2, "b", 0), (3, "c", 1)]
    put(table((2, "new", 0)), first.union(other))  # a folder that is there keeps its other rows
    assert kept and rows() == [(1, "a", 0), (2, "new", 0), (3, "c", 1)]
