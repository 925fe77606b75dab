import os

import pytest
from pyspark.sql import functions as F

from catalign.operators.modelcall import hashed_token_embedding, model_map, model_map_distinct, token_overlap_judge
from catalign.plans.align import align, two_pass_translate
from catalign.plans.ingest import (canonical_facts, fill_categories, near_east_items, nested_json_facts,
                                   sheet_with_offset_header, sr_style)
from catalign.plans.mapping import collect_embeddings, cross_dataset_mapping, match_in_shared_space, validate_mappings
from catalign.plans.transfer import best_name, choose_source_model, impute_all, registry_with_sources, transfer_from_lists
from catalign.specs import SPECS, prepare_items


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_sr_style_ingest(spark, tmp_dir):
    d = os.path.join(tmp_dir, "sr_legacy")
    _write(f"{d}/food.csv", "fdc_id,data_type,description,food_category_id,publication_date\n"
           "1,sr,Milk,10,2019\n2,sr,Tea,11,2019\n")
    _write(f"{d}/food_category.csv", "id,code,description\n10,0100,Dairy and Egg Products\n11,1400,Beverages\n")
    _write(f"{d}/food_attribute.csv", "id,fdc_id,seq_num,food_attribute_type_id,name,value\n"
           "5,1,1,1000,Common Name,cow milk\n6,2,1,999,Other,x\n")
    _write(f"{d}/food_nutrient.csv", "fdc_id,nutrient_id,amount\n1,100,60\n1,101,300\n2,101,4.184\n1,200,3.2\n1,200,9.9\n")
    _write(f"{d}/nutrient.csv", "id,name,unit_name\n100,Energy,KCAL\n101,Energy,kJ\n200,Protein,G\n")
    out = sr_style(spark, tmp_dir)
    items = {r.description: r for r in out["items"].collect()}
    assert items["Milk"].food_category == "Dairy and Egg Products" and items["Milk"].common_name == "cow milk"
    assert items["Tea"].common_name is None
    facts = {r.description: r for r in out["facts"].collect()}
    assert facts["Milk"].Energy == 60.0 and facts["Milk"].Protein == 3.2  # first in file order
    assert abs(facts["Tea"].Energy - 1.0) < 1e-12
    assert sorted(tuple(r) for r in out["units"].collect()) == [("Energy", "KCAL"), ("Protein", "G")]


def test_sr_style_first_amount_by_file_name(spark, tmp_dir):
    d = os.path.join(tmp_dir, "sr_legacy")
    _write(f"{d}/food.csv", "fdc_id,data_type,description,food_category_id,publication_date\n1,sr,Milk,10,2019\n")
    _write(f"{d}/food_category.csv", "id,code,description\n10,0100,Dairy and Egg Products\n")
    _write(f"{d}/food_attribute.csv", "id,fdc_id,seq_num,food_attribute_type_id,name,value\n")
    _write(f"{d}/nutrient.csv", "id,name,unit_name\n200,Protein,G\n")
    _write(f"{d}/food_nutrient.csv/part-0.csv", "fdc_id,nutrient_id,amount\n1,200,\n1,200,3.5\n1,200,3.2\n")
    # a larger file, which Spark reads before the smaller one
    _write(f"{d}/food_nutrient.csv/part-1.csv", "fdc_id,nutrient_id,amount\n" + "1,200,9.9\n" * 2000)
    assert [r.Protein for r in sr_style(spark, tmp_dir)["facts"].collect()] == [3.5]


def test_sr_style_rejects_duplicates(spark, tmp_dir):
    d = os.path.join(tmp_dir, "sr_legacy")
    _write(f"{d}/food.csv", "fdc_id,data_type,description,food_category_id,publication_date\n1,a,Milk,1,x\n2,a,Milk,1,x\n")
    for n, h in [("food_category", "id,code,description\n1,a,b\n"), ("food_attribute", "id,fdc_id,seq_num,food_attribute_type_id,name,value\n"),
                 ("food_nutrient", "fdc_id,nutrient_id,amount\n"), ("nutrient", "id,name,unit_name\n")]:
        _write(f"{d}/{n}.csv", h)
    import pytest
    with pytest.raises(ValueError, match="duplicate"):
        sr_style(spark, tmp_dir)


def test_nested_json_pivot_mean(spark, tmp_dir):
    import json
    p = f"{tmp_dir}/fndds.json"
    _write(p, json.dumps({"SurveyFoods": [
        {"description": "tea", "foodNutrients": [{"nutrient": {"name": "Fat"}, "amount": 1.0},
                                                {"nutrient": {"name": "Fat"}, "amount": 3.0},
                                                {"nutrient": {"name": "Sugar"}, "amount": 5.0}]},
        {"description": "water", "foodNutrients": []}]}))
    out = nested_json_facts(spark, p)
    rows = {r.description: r for r in out["facts"].collect()}
    assert rows["tea"].Fat == 2.0 and rows["tea"].Sugar == 5.0 and "water" not in rows


def test_sheet_offset_header(spark, tmp_dir):
    p = f"{tmp_dir}/mext.csv"
    _write(p, "Standard tables,,,,,\n,,,,,\n,,,,,\n,,,,,\n"
              "Food Group,Item No.,Index,Food and Description,Energy\\n(kcal),Water\n"
              ",,,,ENERC,WATER\n,,,,kcal,g\n"
              "01,1001,1,Amaranth,358,13.5\n02,2001,2,Konjac,5,97\n")
    # the newline inside a header cell is written as a literal \n escape by some exports; strip both forms
    out = sheet_with_offset_header(spark, p, n_columns=6)
    items = {r["Item No."]: (r.food_category, r.food_item) for r in out["items"].collect()}
    assert items == {"1001": ("Grains", "Amaranth"), "2001": ("Potatoes and Starches", "Konjac")}
    meta = {r.descriptions: (r.tag_names, r.unit) for r in out["meta"].collect()}
    assert meta["Water"] == ("WATER", "g")


def test_flat_table_ingest(spark):
    ne = spark.createDataFrame([("Bread", "white", "CEREALS AND GRAIN PRODUCTS"), ("Rice", None, "X")],
                               "FOOD string, VARIANT string, CATEGORY string")
    got = {tuple(r) for r in near_east_items(ne).collect()}
    assert got == {("CEREALS AND GRAIN PRODUCTS", "Bread, white"), ("X", None)}
    bh = spark.createDataFrame([("a", None, "Raw", "x")], "food string, food_category string, food_subcategory string, extra string")
    assert fill_categories(bh, ["food_category", "food_subcategory"], ["food", "food_category"]).first().food_category == "Unclassified"
    z = spark.createDataFrame([("k1", "milk", 1.0, 2.0)], "shmmitzrach string, english_name string, protein double, fat double")
    c = canonical_facts(z, {"shmmitzrach": "id", "english_name": "name"}, {"fat": "Total lipid (fat)", "protein": "Protein"}, ["name"])
    assert c.columns == ["name", "id", "Total lipid (fat)", "Protein"]


def test_prepare_items_domains_and_render(spark):
    raw = spark.createDataFrame([("Dog  Milk", "Dairy Products", "x"), ("Tea", "Bogus", "y")],
                                "description string, food_category string, food_subcategory string")
    items, rej = prepare_items(raw, SPECS["FNDDS"])
    rows = {r.description: r for r in items.collect()}
    assert rows["tea"].food_category == "Unclassified"
    assert rows["dog milk"].text == "Description: dog milk.\nfood_category: Dairy Products.\nfood_sub_category: x."
    sr = spark.createDataFrame([("milk", "Beverages", None), ("tea", "Nope", None)],
                               "description string, food_category string, common_name string")
    ok, bad = prepare_items(sr, SPECS["SR_Legacy"])
    assert [r.description for r in ok.collect()] == ["milk"] and [r.description for r in bad.collect()] == ["tea"]


def test_model_map_retry_null_and_validate(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, "c")], "id int, t string")
    attempts = {}

    def fn(row):
        if row["t"] == "boom":
            raise RuntimeError("down")
        return {"u": row["t"].upper()}
    out = {r.id: (r.u, r._error) for r in model_map(df, fn, ["t"], "u string", keep_cols=["id"], retries=2, wait_s=0).collect()}
    assert out[1] == ("A", None) and out[2][0] is None and "down" in out[2][1]
    v = model_map(df, lambda r: {"u": "zz"}, ["t"], "u string", keep_cols=["id"], retries=2, wait_s=0,
                  validate=lambda row, o: o["u"] == row["t"].upper())
    assert all(r.u is None and "rejected" in r._error for r in v.collect())
    d = model_map_distinct(df.unionByName(df), lambda r: {"n": len(r["t"])}, ["t"], "n int", retries=1, wait_s=0)
    assert d.count() == 6


def test_two_pass_translate(spark):
    src = spark.createDataFrame([("h1", "milk", "dairy"), ("h2", "xx tea", "oil")],
                                "hebrew_name string, short_description string, category_hint string")

    def fn(row):
        bad = row["category_hint"] == "oil"
        return {"description": (row["short_description"] or "unknown item"), "food_category": "Beverages",
                "common_name": None, "food_item_discrepancy": "not same food item" if bad else "same food item"}
    final, phase1, redone = two_pass_translate(src, SPECS["HPP"], SPECS["SR_Legacy"], fn, retries=1, wait_s=0)
    assert redone.count() == 1 and redone.first().description == "unknown item"
    f = {r.hebrew_name: r.description for r in final.collect()}
    assert f == {"h1": "milk", "h2": "unknown item"}


def test_align_resumes_by_chunk(spark, tmp_dir):
    src = spark.createDataFrame([(f"h{i}", f"item {i} milk", None) for i in range(5)],
                                "hebrew_name string, short_description string, category_hint string")
    tgt = spark.createDataFrame([("milk whole",), ("tea black",), ("item 3 milk",)], "description string")
    emb = hashed_token_embedding(16)
    tgt_emb = model_map(tgt.withColumnRenamed("description", "text"), emb, ["text"], "embedding array<double>",
                        keep_cols=["text"], retries=1, wait_s=0).withColumnRenamed("text", "description")
    fn = lambda r: {"description": r["short_description"], "food_category": "Beverages",
                    "food_item_discrepancy": "same food item"}
    ran = align(spark, src, SPECS["HPP"], SPECS["SR_Legacy"], tgt_emb, fn, emb, f"{tmp_dir}/al", chunk_size=2,
                chunk_end=2, retries=1, wait_s=0)
    first = {r.chunk for r in ran.collect()}
    assert first <= {0, 1}
    again = align(spark, src, SPECS["HPP"], SPECS["SR_Legacy"], tgt_emb, fn, emb, f"{tmp_dir}/al", chunk_size=2,
                  retries=1, wait_s=0)
    assert first.isdisjoint(r.chunk for r in again.collect())
    top = spark.read.parquet(f"{tmp_dir}/al/top_match")
    assert top.count() == 5
    assert top.filter("hebrew_name = 'h3'").first().description == "item 3 milk"


def test_cross_mapping_partitioned_and_validated(spark, tmp_dir):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    tables = {f"D{l}": emb.filter(F.col("label") == l).withColumn("name", F.concat(F.lit("n"), F.col("vec_id").cast("string")))
              for l in range(3)}
    keys = {k: "vec_id" for k in tables}
    out = cross_dataset_mapping(spark, tables, "D0", keys, "name", 2, out_path=f"{tmp_dir}/map")
    parts = {(r.dataset, r.target) for r in out.select("dataset", "target").distinct().collect()}
    assert len(parts) == 9
    assert os.path.isdir(f"{tmp_dir}/map/dataset=D0/target=D1")
    assert cross_dataset_mapping(spark, tables, "D0", keys, "name", 2, out_path=f"{tmp_dir}/map") is None
    texts = out.select("dataset", "item", F.col("space_name").alias("text")).distinct()
    val = validate_mappings(out, token_overlap_judge(0.5), texts=texts, only=[("D0", "D1")], retries=1, wait_s=0)
    assert val.filter(F.col("same_item").isNotNull()).select("dataset").distinct().first().dataset == "D0"


def test_collect_and_shared_space(spark):
    a = spark.createDataFrame([("x", [1.0, 0.0], "final"), ("y", [0.0, 1.0], "first_phase_discrepancy")],
                              "hebrew_name string, emb array<double>, phase string")
    b = spark.createDataFrame([("p", [0.9, 0.1]), ("q", [None, 1.0])], "description string, emb array<double>")
    allv = collect_embeddings({"HPP": a, "SR": b}, {"HPP": {"hebrew_name": "food_name", "emb": "embedding"},
                                                    "SR": {"description": "food_name", "emb": "embedding"}})
    assert sorted(r.food_name for r in allv.collect()) == ["p", "q", "x"]
    m = match_in_shared_space(a, b.filter("description = 'p'"), "hebrew_name", "description", "emb").collect()
    assert {(r.hebrew_name, r.description) for r in m} == {("x", "p"), ("y", "p")}


def test_registry_choice_and_names(spark):
    base = spark.createDataFrame([("a",), ("b",)], "k string")
    s1 = spark.createDataFrame([("a", "m1", 0.9), ("a", "m2", 0.95)], "k string, match string, similarity_score double")
    s2 = spark.createDataFrame([("b", "n1", 0.4)], "k string, match string, similarity_score double")
    reg = {r.k: r for r in registry_with_sources(base, "k", {"S1": s1, "S2": s2}).collect()}
    assert reg["a"].S1__match == "m2" and reg["a"].S2__match is None and reg["b"].S2__match == "n1"
    choice, rejected = choose_source_model(base, lambda r: {"database_choice": "S1" if r["k"] == "a" else "bad", "reason": "r"},
                                           ["k"], ["S1", "S2"], "k", retries=1, wait_s=0)
    assert [r.k for r in choice.collect()] == ["a"] and [r.k for r in rejected.collect()] == ["b"]
    items = spark.createDataFrame([(1, "milk", "x1", "", None, "x2"), (2, "tea", "", "", "", "")],
                                  "id int, food string, a1 string, a2 string, a3 string, arabic_name string")
    out = best_name(items, "id", ["a1", "a2", "a3", "arabic_name"], lambda r: {"best_name": r["candidates"][-1], "suggested_name": "s"},
                    ["food"], retries=2, wait_s=0)
    assert {r.id: r.arabic_name for r in out.collect()} == {1: "x2", 2: ""}


def test_transfer_from_lists_and_impute_all(spark):
    lists = spark.createDataFrame(
        [("H", "h1", [("z1", 0.9)], [("s1", 0.8)]), ("H", "h2", [], None)],
        "dataset string, item string, Z array<struct<name:string,score:double>>, S array<struct<name:string,score:double>>")
    facts = spark.createDataFrame([("Z", "z1", 1.0), ("S", "s1", 2.0)], "dataset string, item string, fat double")
    spine = spark.createDataFrame([("H", "h1"), ("H", "h2"), ("Z", "z1"), ("S", "s1")], "dataset string, item string")
    full = {(r.dataset, r.item): r.fat for r in transfer_from_lists(lists, facts, ["fat"], ["Z", "S"], "H", ["Z"], spine).collect()}
    assert full == {("H", "h1"): 2.0, ("H", "h2"): None, ("Z", "z1"): 1.0, ("S", "s1"): 2.0}
    table = spark.createDataFrame([("h1", 1.0, 5.0), ("h2", None, 7.0), ("h3", 3.0, None)], "k string, fat double, matched_score double")
    vec = spark.createDataFrame([("h1", [1.0, 0.0]), ("h2", [0.9, 0.1]), ("h3", [0.0, 1.0])], "k string, embedding array<double>")
    filled = {r.k: r.fat for r in impute_all(table, vec, "k", ["fat", "matched_score"]).collect()}
    assert filled == {"h1": 1.0, "h2": 1.0, "h3": 3.0}


def test_model_map_bounded_in_flight(spark):
    import threading
    import time as _time

    def make():
        state = {"now": 0, "peak": 0}

        def fn(row):
            lock = state.setdefault("lock", threading.Lock())  # created in the worker (locks do not pickle)
            with lock:
                state["now"] += 1
                state["peak"] = max(state["peak"], state["now"])
            _time.sleep(0.02)
            with lock:
                state["now"] -= 1
                return {"peak": state["peak"]}
        return fn
    df = spark.range(0, 60, numPartitions=1).withColumnRenamed("id", "k")
    out = model_map(df, make(), ["k"], "peak int", keep_cols=["k"], max_in_flight=3, retries=1, wait_s=0)
    peak = max(r.peak for r in out.collect())
    assert 2 <= peak <= 3


def _hpp_items(spark, n):
    return spark.createDataFrame([(f"h{i}", f"item {i}", "oil" if i in (3, 8) else "dairy") for i in range(n)],
                                 "hebrew_name string, short_description string, category_hint string")


def test_each_record_is_translated_once_per_pass(spark):
    calls = spark.sparkContext.accumulator(0)

    def fn(row):
        calls.add(1)
        bad = row["category_hint"] == "oil"
        return {"description": row["short_description"] or "none", "food_category": "Beverages",
                "food_item_discrepancy": "not same food item" if bad else "same food item"}
    lazy = model_map(_hpp_items(spark, 20), fn, ["category_hint", "short_description"], "description string", keep_cols=["hebrew_name"], retries=1, wait_s=0)
    assert lazy.columns and calls.value == 0
    final, phase_1, redone = two_pass_translate(_hpp_items(spark, 20), SPECS["HPP"], SPECS["SR_Legacy"], fn, retries=1, wait_s=0)
    assert final.count() == 20 and phase_1.count() == 20 and redone.count() == 2
    assert calls.value == 22


def test_failed_and_rejected_records_stay(spark):
    def fn(row):
        if row["hebrew_name"] == "h1":
            raise RuntimeError("down")
        category = "Nonsense" if row["hebrew_name"] == "h2" else "Beverages"
        return {"description": row["short_description"] or "none", "food_category": category, "food_item_discrepancy": "same food item"}
    final, _, _ = two_pass_translate(_hpp_items(spark, 20), SPECS["HPP"], SPECS["SR_Legacy"], fn, retries=1, wait_s=0)
    got = {r.hebrew_name: r.status for r in final.collect()}
    assert len(got) == 20 and got["h1"] == "failed" and got["h2"] == "rejected" and got["h0"] == "ok"


def test_align_resumes_after_a_crash_between_its_outputs(spark, tmp_dir, monkeypatch):
    from catalign.plans import align as plan
    emb = hashed_token_embedding(16)
    tgt = model_map(spark.createDataFrame([("item 3",), ("tea",)], "text string"), emb, ["text"], "embedding array<double>",
                    keep_cols=["text"], retries=1, wait_s=0).withColumnRenamed("text", "description")
    fn = lambda r: {"description": r["short_description"] or "none", "food_category": "Beverages", "food_item_discrepancy": "same food item"}
    run = lambda: align(spark, _hpp_items(spark, 6), SPECS["HPP"], SPECS["SR_Legacy"], tgt, fn, emb, f"{tmp_dir}/al", chunk_size=3, retries=1, wait_s=0)
    whole = plan.top_matches

    def crash(*a, **k):
        raise RuntimeError("stopped")
    monkeypatch.setattr(plan, "top_matches", crash)
    with pytest.raises(RuntimeError, match="stopped"):
        run()
    assert spark.read.parquet(f"{tmp_dir}/al/embeddings").count() >= 6
    monkeypatch.setattr(plan, "top_matches", whole)
    assert run().count() >= 1
    assert spark.read.parquet(f"{tmp_dir}/al/top_match").count() == 6
    assert run().count() == 0


def test_update_writes_nulls_and_ranks_null_groups(spark):
    from catalign.operators.joins import keyed_update
    from catalign.operators.tables import rank_within
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    upd = spark.createDataFrame([(1, None)], "k int, v string")
    assert sorted(tuple(r) for r in keyed_update(df, upd, "k", ["v"]).collect()) == [(1, None), (2, "b")]
    g = spark.createDataFrame([(None, 1), (None, 2), ("x", 3), ("x", 4)], "g string, o int")
    assert sorted(((r.g, r.o), r["rank"]) for r in rank_within(g, ["g"], ["o"]).collect() if r.g) == [(("x", 3), 1), (("x", 4), 2)]
    assert sorted((r.o, r["rank"]) for r in rank_within(g, ["g"], ["o"]).collect() if r.g is None) == [(1, 1), (2, 2)]


def test_keyed_update_of_null_and_repeated_keys(spark):
    from catalign.operators.joins import keyed_update
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, v string")
    upd = spark.createDataFrame([(None, "new")], "k long, v string")
    assert sorted((r.v for r in keyed_update(df, upd, "k", ["v"]).collect())) == ["a", "b", "new"]
    with pytest.raises(Exception, match="several updates"):
        keyed_update(df, upd.union(upd), "k", ["v"]).collect()


def test_mapping_computes_missing_pairs_only(spark, tmp_dir, monkeypatch):
    import catalign.plans.mapping as plan
    emb = lambda d, n: spark.createDataFrame([(f"{d}{i}", [float(i + 1), float(d)]) for i in range(n)], "name string, embedding array<double>")
    tables = {f"D{d}": emb(d, 4 + d) for d in range(4)}
    keys, path, seen = {d: "name" for d in tables}, f"{tmp_dir}/map", []
    real = plan.top_matches
    monkeypatch.setattr(plan, "top_matches", lambda left, right, **kw: seen.append(tuple(sorted({r[0] for r in x.select("dataset").distinct().collect()}) for x in (left, right))) or real(left, right, **kw))
    run = lambda which, **kw: cross_dataset_mapping(spark, {d: tables[d] for d in which}, "D0", keys, "name", 2, out_path=path, **kw)
    rows = lambda df: sorted(tuple(r) for r in df.select("dataset", "item", "target", "match", "rank").collect())
    run(["D0", "D1", "D2"])
    assert run(["D0", "D2"]) is None and not seen
    got = run(["D0", "D1", "D2", "D3"])
    assert sorted(seen) == [(["D0", "D1", "D2"], ["D3"]), (["D3"], ["D0", "D1", "D2", "D3"])]
    want = rows(got)
    assert want == rows(cross_dataset_mapping(spark, tables, "D0", keys, "name", 2))
    # a pair whose folder was written but not entered is computed again
    import shutil
    shutil.rmtree(f"{path}__pairs/d=D1/t=D2")
    seen.clear()
    assert rows(run(["D0", "D1", "D2", "D3"])) == want and seen == [(["D1"], ["D2"])]
    assert rows(run(["D0", "D1"], overwrite=True)) == want


def test_validation_judges_pairs_newly_asked_for(spark, tmp_dir):
    rows = [(a, f"{a}{i}", b, f"{b}{i}", 0.1 * i) for a in "AB" for b in "AB" for i in range(6)]
    mapping = spark.createDataFrame(rows, "dataset string, item string, target string, match string, similarity_score double")
    high = lambda row: {"same_item": row["similarity_score"] >= 0.3}
    never = lambda row: {"same_item": None}
    how = dict(out_path=f"{tmp_dir}/checked", retries=1, wait_s=0)
    judged = lambda df: {(r.dataset, r.target): r.n for r in df.groupBy("dataset", "target").agg(F.count("same_item").alias("n")).collect()}
    assert judged(validate_mappings(mapping, high, only=[("A", "B")], **how)) == {("A", "A"): 0, ("A", "B"): 6, ("B", "A"): 0, ("B", "B"): 0}
    assert validate_mappings(mapping, never, only=[("A", "B")], **how) is None
    out = validate_mappings(mapping, high, **how)
    assert set(judged(out).values()) == {6} and out.count() == len(rows)
    assert validate_mappings(mapping, never, **how) is None
    assert judged(validate_mappings(mapping, never, only=[("B", "B")], overwrite=True, **how))[("B", "B")] == 0



def test_unscored_match_loses_and_tied_list_is_in_name_order(spark):
    from catalign.operators.reshape import match_lists
    base = spark.createDataFrame([("a",)], "k string")
    s = spark.createDataFrame([("a", "m1", None), ("a", "m2", 0.1)], "k string, match string, similarity_score double")
    assert registry_with_sources(base, "k", {"S": s}).first().S__match == "m2"
    top = spark.createDataFrame([("d", 1, "x", n, 0.5) for n in (12, 10, 11)], "dataset string, item int, target string, match int, score double")
    assert [p.name for p in match_lists(top, ["dataset", "item"], "target", "match", "score").first().x] == [10, 11, 12]


def test_sheet_header_with_a_line_end(spark, tmp_dir):
    p = f"{tmp_dir}/sheet.csv"
    _write(p, 't,,\n,,\n,,\n,,\nFood Group,Item No.,"Food and\n Description"\n,,TAG\n,,g\n01,1,Rice\n')
    from catalign.sources.readers import read_sheet_rows
    rows = read_sheet_rows(spark, p, 3).orderBy("_idx").collect()
    assert len(rows) == 8 and rows[4]["_c2"] == "Food and\n Description"


def test_name_outside_the_column_list_is_an_error(spark):
    import pytest
    from catalign.operators.reshape import pivot_mean
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "k int, n string, v double")
    with pytest.raises(Exception, match="value without a column"):
        pivot_mean(df, ["k"], "n", "v", ["a"]).collect()


def test_processed_log_survives_a_crash_between_its_writes(spark, tmp_dir):
    import shutil
    from catalign.sources.sinks import process_new_keys
    items = spark.createDataFrame([("a",), ("b",)], "name string")
    args = ("name", f"{tmp_dir}/log", lambda d: d, f"{tmp_dir}/out")
    process_new_keys(spark, items, *args)
    shutil.rmtree(f"{tmp_dir}/log")  # as if the run had stopped before the log was written
    process_new_keys(spark, items, *args)
    assert spark.read.parquet(f"{tmp_dir}/out").count() == 2


def test_matrix_blocks_hold_any_number_of_columns(spark):
    from catalign.sources.sinks import matrix_blocks
    pairs = spark.range(2500).select((F.col("id") % 3).alias("r"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("c"), F.col("id").alias("v"))
    rows = matrix_blocks(pairs, "r", "c", "v", width=400).collect()
    got = {(r.row, n): v for r in rows for n, v in zip(r.names, r["values"]) if v is not None}
    assert got == {(i % 3, f"c{i:05d}"): i for i in range(2500)} and len(rows) == 21


def test_matrix_blocks_make_names_once_a_block(spark):
    from catalign.sources.sinks import matrix_blocks
    pairs = spark.range(90).select((F.col("id") % 4).alias("r"), F.format_string("c%02d", F.col("id") % 30).alias("c"), F.col("id").alias("v"))
    out = matrix_blocks(pairs.dropDuplicates(["r", "c"]), "r", "c", "v", width=8)
    top = out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Project") and top.count("transform(") == 1  # the values'; the names come with the block
    assert all(r.names == [f"c{i:02d}" for i in range(8 * r.block, min(30, 8 * r.block + 8))] and len(r["values"]) == len(r.names) for r in out.collect())


def test_two_pass_calls_run_on_all_cores(spark):
    def fn(row):
        from pyspark import TaskContext
        return {"description": f"part {TaskContext.get().partitionId()} milk", "food_category": "Beverages", "food_item_discrepancy": "same food item"}
    items = _hpp_items(spark, 200).coalesce(1)
    final, _, _ = two_pass_translate(items, SPECS["HPP"], SPECS["SR_Legacy"], fn, retries=1, wait_s=0)
    assert final.select("description").distinct().count() == spark.sparkContext.defaultParallelism
    assert final.count() == 200


def test_align_resume_embeds_the_target_once(spark, tmp_dir, monkeypatch):
    from catalign.queries import flows
    names = ["red bolt", "blue ring", None, "old plate", "red bolt", "hot pin"]
    parts = spark.createDataFrame([(i, n, "STANDARD" if i % 2 else "SMALL") for i, n in enumerate(names)], "p_partkey long, p_name string, p_type string")
    parts.write.parquet(f"{tmp_dir}/part.parquet")
    calls, real = spark.sparkContext.accumulator(0), flows.model_map

    def counted(fn):
        def call(row):
            calls.add(1)
            return fn(row)
        return call
    monkeypatch.setattr(flows, "model_map", lambda df, fn, *a, **k: real(df, counted(fn), *a, **k))
    got = {r.p_partkey: r.description for r in flows.align_resume(spark, tmp_dir).collect()}
    assert calls.value == 5  # four names and the null
    # flagged parts are done again without their name
    assert sorted(got) == [str(i) for i in range(6)] and got["1"] == "blue ring item" and got["3"] == "old plate item"
