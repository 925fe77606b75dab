"""Driver queries over whole jobs: ingest from files, two-pass alignment,
mapping with validation, source and name choice, transfer, imputation, and
the sinks with their skip and resume rules.

Where a job reads or writes files, a given table is first written in that
format to a fresh folder under the checkpoint folder."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import (columns_first, copy_key, drop_flagged, nan_to_null, rename, rename_strict, replace_text,
                                 similarity_to_distance, tag)
from ..functions.vectors import cosine
from ..operators.checks import require_columns, uniqueness_counts
from ..operators.impute import facts_long, facts_wide
from ..operators.joins import left_join_all
from ..operators.modelcall import model_map
from ..operators.reshape import match_lists
from ..operators.similarity import as_items, top_matches
from ..operators.tables import transpose_rows
from ..plans.align import align, two_pass_translate
from ..plans.ingest import canonical_facts, fill_categories, near_east_items, nested_json_facts, sheet_with_offset_header, sr_style
from ..plans.mapping import collect_embeddings, cross_dataset_mapping, match_in_shared_space, validate_mappings
from ..plans.transfer import best_name, choose_source_model, impute_all, registry_with_sources, transfer_from_lists
from ..session import ensure_checkpoint_dir, materialize, read_table
from ..sources.readers import read_binary_files, read_chunk_files, read_csv, read_parquet
from ..sources.sinks import dedupe_names, matrix_blocks, process_new_keys, read_committed, run_chunks, run_unless_exists, write_csv, write_parquet
from ..specs import MEXT_FOOD_GROUPS, SPECS, Paths


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/flow-{uuid.uuid4().hex}"


# --- ingest ---------------------------------------------------------------------------------

def ingest_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP1 + SRC4 + AGG2: parts as foods, return flags as nutrients, through
    CSV files: items with their category and common name, and of the amounts
    of a part and flag (one a line item, some null) the first in the files."""
    out = _folder(spark)
    part, li = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "lineitem")
    put = lambda df, name: write_csv(df, f"{out}/sr_legacy/{name}.csv")
    put(part.select(F.col("p_partkey").alias("fdc_id"), F.lit("sr").alias("data_type"),
                    F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("description"),
                    F.length("p_type").alias("food_category_id"), F.lit("2019").alias("publication_date")), "food")
    put(part.select(F.length("p_type").alias("id")).distinct().select("id", F.lit("x").alias("code"), F.concat(F.lit("Category "), F.col("id").cast("string")).alias("description")), "food_category")
    put(part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("fdc_id"), F.lit(1).alias("seq_num"),
                    F.when(F.col("p_size") > 25, 1000).otherwise(999).alias("food_attribute_type_id"), F.lit("n").alias("name"), F.col("p_brand").alias("value")), "food_attribute")
    flag = F.col("l_returnflag")
    number = F.when(flag == "A", 100).when(flag == "N", 101).otherwise(200)
    in_order = li.orderBy("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")  # numbered files, each a range
    put(in_order.select(F.col("l_partkey").alias("fdc_id"), number.alias("nutrient_id"), F.when(F.col("l_discount") < 0.09, F.col("l_quantity")).alias("amount")), "food_nutrient")
    put(spark.createDataFrame([(100, "Energy", "KCAL"), (101, "Energy", "kJ"), (200, "Protein", "G")], "id int, name string, unit_name string"), "nutrient")
    got = sr_style(spark, out)
    return got["items"].join(got["facts"].drop("description"), "fdc_id", "left").select(
        F.col("fdc_id").alias("p_partkey"), "description", "food_category", "common_name", F.round("Energy", 6).alias("energy"), F.round("Protein", 6).alias("protein"))


def ingest_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP2 + SRC5: the events as JSON documents with nested nutrient lists
    (amounts in hundredths), read back and averaged by description.  A user's
    events are dealt over documents of about a hundred, however many there are."""
    out = _folder(spark)
    ev = read_table(spark, sf_dir, "events")
    fact = F.struct(F.struct(F.concat(F.lit("n_"), F.col("event_type")).alias("name")).alias("nutrient"), F.round(F.col("value") * 100).cast("long").alias("amount"))
    foods = ev.groupBy("user_id", F.floor(F.col("event_id") / 100).alias("document")).agg(F.collect_list(fact).alias("foodNutrients")).select(
        F.struct(F.concat(F.lit("user "), F.pmod("user_id", F.lit(50)).cast("string")).alias("description"), "foodNutrients").alias("food"))
    foods.select(F.array("food").alias("SurveyFoods")).write.json(f"{out}/foods")
    got = nested_json_facts(spark, f"{out}/foods", multiline=False)["facts"]
    return got.select("description", *sorted(set(got.columns) - {"description"}))


def ingest_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP3 + SRC6 + PRJ9: customers as a sheet whose header is in its fifth
    row and holds line ends, with two metadata rows below it."""
    out = _folder(spark)
    c = read_table(spark, sf_dir, "customer")
    top = [(0, "Standard tables", "", "", "", ""), (1, "", "", "", "", ""), (2, "", "", "", "", ""), (3, "", "", "", "", ""),
           (4, "Food\n Group", "Item\n No.", "Index", "Food and\n Description", "Energy\n(kcal)"), (5, "", "", "", "", "ENERC"), (6, "", "", "", "", "kcal")]
    sheet = spark.createDataFrame(top, "i long, a string, b string, c string, d string, e string").unionByName(
        c.select((F.col("c_custkey") + 7).alias("i"), F.lpad((F.col("c_nationkey") % 18 + 1).cast("string"), 2, "0").alias("a"),
                 F.col("c_custkey").cast("string").alias("b"), F.lit("1").alias("c"), "c_name", "c_acctbal").withColumnsRenamed(
                     {"c_name": "d", "c_acctbal": "e"}).withColumn("e", F.col("e").cast("string")))
    # range-sorted numbered files, the header in the first
    sheet.orderBy("i").drop("i").write.option("escape", '"').csv(f"{out}/sheet")
    got = sheet_with_offset_header(spark, f"{out}/sheet", n_columns=5)
    meta = got["meta"].select(F.lit("meta").alias("kind"), F.col("descriptions").alias("key"), F.col("tag_names").alias("a"), F.col("unit").alias("b"))
    items = got["items"].select(F.lit("item").alias("kind"), F.col("`Item No.`").alias("key"), F.col("food_category").alias("a"), F.col("food_item").alias("b"))
    return items.unionByName(meta)


def chunk_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: a folder of chunk files by three generations of a writer -- whole
    numbers first, then doubles and a new column, then a column that is gone
    -- read as one table; a fourth whose types clash is refused by name.  A
    generation with narrow keys writes those too large for them in wide files
    of its own."""
    out, c = _folder(spark), read_table(spark, sf_dir, "customer")
    part = lambda i: c.filter(F.col("c_custkey") % 3 == i)
    key = F.col("c_custkey")
    def write(df, kind, name):
        narrow, wide = F.col("k").try_cast(kind).alias("k"), F.col("k").try_cast(kind).isNull() & F.col("k").isNotNull()
        write_parquet(df.filter(~wide).select(*[narrow if x == "k" else x for x in df.columns]), f"{out}/chunks/{name}")
        write_parquet(df.filter(wide), f"{out}/chunks/{name}_wide")
    write(part(0).select(key.alias("k"), F.col("c_nationkey").cast("int").alias("v"), F.lit(None).alias("note"), F.col("c_name").alias("name")), "int", "a")
    write_parquet(part(1).select(key.alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("note"), F.col("c_name").alias("name")), f"{out}/chunks/b")
    write(part(2).select(F.col("c_mktsegment").alias("note"), F.col("c_acctbal").cast("float").alias("v"), key.alias("k")), "smallint", "c")
    got = read_chunk_files(spark, f"{out}/chunks")
    write_parquet(got.select(F.col("k").cast("string").alias("k")), f"{out}/chunks/d")
    try:
        read_chunk_files(spark, f"{out}/chunks")
        raise AssertionError("types that clash were read")
    except ValueError as e:
        assert "/chunks/d/" in str(e)
    return got.select("k", F.round("v", 2).alias("v"), "note", "name")


def binary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7 + SRC9: every page written as a binary file under the resolver's
    raw-data path, found there by its name's pattern and read back as base64."""
    raw = Paths(_folder(spark), "Pages").raw
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("string").alias("html"))

    def write(batches):
        store, base = pafs.FileSystem.from_uri(raw if "://" in raw else "file://" + raw.replace("file:", "", 1))
        store.create_dir(base, recursive=True)
        for pdf in batches:
            for k, html in zip(pdf["page_id"], pdf["html"]):
                for ending, body in (("page", (html or "\0").encode()), ("skip", b"x")):
                    with store.open_output_stream(f"{base}/{k}.{ending}") as f:
                        f.write(body)
            yield pdf[["page_id"]]
    pages.mapInPandas(write, "page_id long").write.format("noop").mode("overwrite").save()
    found = read_binary_files(spark, raw, "*.page")
    return found.select(F.substring_index("name", ".", 1).cast("long").alias("page_id"), "payload_b64")


def ingest_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP4 + SRC4 + PRJ3 + PRJ4 + PRJ5 + PRJ8 + PRJ13 + PRJ14 + PRJ15: two
    flat catalogues read from CSV and brought to one vocabulary."""
    out = _folder(spark)
    part, cust = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "customer")
    write_csv(part.select(F.col("p_name").alias("FOOD"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("VARIANT"), F.col("p_type").alias("CATEGORY"), F.col("p_partkey").alias("ID")), f"{out}/a")
    write_csv(cust.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("food"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("food_category"),
                          F.when(F.col("c_acctbal") < 0, F.lit("NaN")).otherwise(F.col("c_acctbal").cast("string")).alias("amount")), f"{out}/b")
    a = near_east_items(read_csv(spark, f"{out}/a", "FOOD string, VARIANT string, CATEGORY string, ID long"))
    a = tag(rename(a, {"ID": "id", "absent": "x"}), "a").withColumn("amount", F.lit(None).cast("double"))
    b = fill_categories(read_csv(spark, f"{out}/b", "id long, food string, food_category string, amount double"), ["food_category"])
    b = tag(b.withColumn("food", replace_text("food", "Customer#", "c")), "b")
    b = canonical_facts(nan_to_null(b), {"id": "id", "food": "description", "dataset": "dataset"}, {"amount": "amount", "food_category": "food_category"}, ["description"])
    b = rename_strict(b, {c: c for c in ("description", "id", "food_category", "dataset", "amount")})
    return columns_first(a, ["dataset", "id"]).unionByName(require_columns(b, ["description", "dataset"]))


def sheet_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10: two rows of a sheet made of the whole customer table become
    columns, one output row per input column."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_idx"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("the segment"), F.col("c_nationkey").alias("nation.key"))
    return transpose_rows(c, "_idx", [0, 1], ["name", "the segment", "nation.key"], ["first", "second"])


# --- model calls and alignment --------------------------------------------------------------

def _translate(row: dict) -> dict:
    """Stand-in model: part types become categories; two kinds of parts are
    flagged until simplified, one kind fails, one answers outside the domain."""
    name, hint = row["short_description"], row["category_hint"]
    if hint == "promo":
        raise RuntimeError("no answer")
    bad = hint in ("small", "large")
    category = {"medium": "Nonsense"}.get(hint, "Beverages")
    return {"description": (name or "plain") + " item", "food_category": category, "common_name": None if hint is None else hint,
            "unlikely_food_item": False, "food_item_discrepancy": "not same food item" if bad else "same food item"}


def _source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part", spread=True)
    return part.select(F.col("p_partkey").cast("string").alias("hebrew_name"), F.col("p_name").alias("short_description"), F.lower("p_type").alias("category_hint"))


def align_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MDL1 + MDL2 + MDL7 + PRJ18 + JN11: flagged records are simplified and
    redone, failed and rejected ones stay with their status."""
    final, _, _ = two_pass_translate(_source_items(spark, sf_dir), SPECS["HPP"], SPECS["SR_Legacy"], _translate, retries=1, wait_s=0)
    return final.select(F.col("hebrew_name").alias("p_partkey"), "status", "description", "food_category", "common_name", "food_item_discrepancy", "text", F.col("_error").isNotNull().alias("has_error"))


def align_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MDL2 + JN11 where keys repeat and are null: every record is one record
    of the result, and flagged ones get their second pass whatever their key."""
    items = _source_items(spark, sf_dir)
    key = F.when(F.col("hebrew_name").cast("long") % 5 != 0, (F.col("hebrew_name").cast("long") % 40).cast("string"))
    final, _, redone = two_pass_translate(items.withColumn("hebrew_name", key), SPECS["HPP"], SPECS["SR_Legacy"], _translate, retries=1, wait_s=0)
    done = redone.select("_row", F.lit(True).alias("again"))
    return final.join(done, "_row", "left").select(F.col("hebrew_name").alias("key"), "status", "description", "food_item_discrepancy", F.coalesce("again", F.lit(False)).alias("again"))


def _embed(row: dict) -> dict:
    return {"embedding": [float(row["text"].count(c)) for c in "abcdefghijklmnopqrst"]}


def align_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP5 + SNK3 + SNK4: alignment of the parts in two runs of chunks into
    the top match per record; the second run does what the first left out."""
    out = _folder(spark)
    items = materialize(_source_items(spark, sf_dir))
    target = read_table(spark, sf_dir, "part").select(F.lower(F.concat("p_name", F.lit(" item"))).alias("text")).distinct()
    emb = model_map(target, _embed, ["text"], "embedding array<double>", keep_cols=["text"], retries=1, wait_s=0).withColumnRenamed("text", "description")
    emb = materialize(emb)  # the target is embedded once for both runs
    n = items.count()
    how = dict(chunk_size=max(1, n // 3), retries=1, wait_s=0)
    align(spark, items, SPECS["HPP"], SPECS["SR_Legacy"], emb, _translate, _embed, f"{out}/run", chunk_end=1, **how)
    align(spark, items, SPECS["HPP"], SPECS["SR_Legacy"], emb, _translate, _embed, f"{out}/run", **how)
    top = spark.read.parquet(f"{out}/run/top_match")
    return top.select(F.col("hebrew_name").alias("p_partkey"), "description", F.round("similarity_score", 6).alias("score"))


def failing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MDL7 + MDL8: a call that fails for some keys gives a null and the error."""
    def fn(row):
        if row["c_nationkey"] % 5 == 0:
            raise ValueError(f"nation {row['c_nationkey']}")
        return {"twice": row["c_nationkey"] * 2}
    c = read_table(spark, sf_dir, "customer")
    out = model_map(c, fn, ["c_nationkey"], "twice long", keep_cols=["c_custkey"], retries=2, wait_s=0)
    return out.select("c_custkey", "twice", F.col("_error").alias("error"))


def registry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP8 + JN4 + MDL5 + CHK4: the best match per source joined onto a
    registry, then one source chosen per item; unscored matches lose, choices
    outside the list are quarantined."""
    part = read_table(spark, sf_dir, "part")
    li = read_table(spark, sf_dir, "lineitem")
    base = part.select(F.col("p_partkey").alias("k"))
    source = lambda flag: li.filter(F.col("l_returnflag") == flag).select(
        F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("match"), F.when(F.col("l_discount") < 0.09, F.col("l_quantity")).alias("similarity_score"))
    reg = registry_with_sources(base, "k", {"A": source("A"), "R": source("R")})

    def choose(row):
        a, r = row["A__similarity_score"], row["R__similarity_score"]
        a, r = (-1.0 if x is None or x != x else x for x in (a, r))
        best = "none" if max(a, r) < 0 else "A" if a >= r else "R"
        return {"database_choice": {"none": "no_relevant_match"}.get(best, best) if max(a, r) < 50 else "elsewhere", "reason": best}
    chosen, rejected = choose_source_model(reg, choose, ["A__similarity_score", "R__similarity_score"], ["A", "R"], "k", retries=1, wait_s=0)
    both = chosen.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))
    return both.join(reg.select("k", F.col("A__match").alias("a_match"), F.col("R__match").alias("r_match")), "k").select(
        F.col("k").alias("p_partkey"), "database_choice", "reason", "accepted", "a_match", "r_match")


def name_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MDL6 + ARR1 + ARR4 + JN11: the best of the non-empty candidate names is
    written back; an answer that is no candidate is asked again and then nulls."""
    c = read_table(spark, sf_dir, "customer")
    c = c.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("n1"),
                 F.when(F.col("c_nationkey") < 20, F.col("c_mktsegment")).alias("n2"), F.lit("old").alias("name"))

    def pick(row):
        options = [str(x) for x in row["candidates"]]
        return {"best_name": "nobody" if options[0].endswith("7") else options[-1], "suggested_name": "s"}
    return best_name(c, "c_custkey", ["n1", "n2"], pick, ["n1"], write_col="name", retries=2, wait_s=0).select("c_custkey", "name")


# --- mapping, transfer, imputation ----------------------------------------------------------

def _dataset_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    emb = read_table(spark, sf_dir, "embeddings")
    phase = F.when(F.col("vec_id") % 11 == 0, "first_phase_discrepancy").otherwise("final")
    return {f"D{i}": emb.filter(F.col("label") % 3 == i).select("vec_id", F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("name"), "embedding", phase.alias("phase")) for i in range(3)}


def mapping_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP6 + PIP7 + PRJ7 + SNK3: the mapping of three datasets written by
    pair of datasets, then validated for one pair; each is skipped when there."""
    out, tables = _folder(spark), _dataset_tables(spark, sf_dir)
    keys = {d: "vec_id" for d in tables}
    how = dict(out_path=f"{out}/map", n=2)
    mapping = cross_dataset_mapping(spark, tables, "D0", keys, "name", **how)
    assert cross_dataset_mapping(spark, tables, "D0", keys, "name", **how) is None
    judge = lambda row: {"same_item": row["similarity_score"] >= 0.25}
    checked = validate_mappings(mapping, judge, only=[("D0", "D1")], out_path=f"{out}/checked", retries=1, wait_s=0)
    assert validate_mappings(mapping, judge, only=[("D0", "D1")], out_path=f"{out}/checked", retries=1, wait_s=0) is None
    return checked.select("dataset", F.col("item").cast("long").alias("item"), "target", F.col("match").cast("long").alias("match"), "rank", "match_space_name", F.round("similarity_score", 6).alias("score"), "same_item")


def mapping_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP6 + PIP7 + SIM6 by pair ledger: three datasets are mapped and one
    pair is judged, a fourth dataset joins; the files of the nine old pairs
    stay, seven pairs are computed, and only pairs newly asked for are judged."""
    out = _folder(spark)
    emb = read_table(spark, sf_dir, "embeddings")
    tables = {f"D{i}": emb.filter(F.col("label") % 4 == i).select("vec_id", F.col("vec_id").alias("name"), "embedding") for i in range(4)}
    keys = {d: "vec_id" for d in tables}
    judge = lambda row: {"same_item": row["similarity_score"] >= 0.25}
    files = lambda: {r[0] for r in spark.read.parquet(f"{out}/map").select(F.input_file_name()).distinct().collect()}
    how = dict(out_path=f"{out}/map", n=1)
    old = {d: tables[d] for d in ("D0", "D1", "D2")}
    mapping = cross_dataset_mapping(spark, old, "D0", keys, "name", **how)
    validate_mappings(mapping, judge, only=[("D0", "D1")], out_path=f"{out}/checked", retries=1, wait_s=0)
    before = files()
    assert cross_dataset_mapping(spark, old, "D0", keys, "name", **how) is None
    mapping = cross_dataset_mapping(spark, tables, "D0", keys, "name", **how)
    assert before <= files()
    no_more = lambda row: {"same_item": None}
    assert validate_mappings(mapping, no_more, only=[("D0", "D1")], out_path=f"{out}/checked", retries=1, wait_s=0) is None
    checked = validate_mappings(mapping, judge, only=[("D0", "D1"), ("D3", "D2")], out_path=f"{out}/checked", retries=1, wait_s=0)
    return checked.select("dataset", F.col("item").cast("long").alias("item"), "target", F.col("match").cast("long").alias("match"), F.round("similarity_score", 6).alias("score"), "same_item")


def shared_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP9 + PIP12 + SRC2 + FLT1: embeddings collected from a folder per
    dataset, final phase only, and the best match between two of them."""
    out, tables = _folder(spark), _dataset_tables(spark, sf_dir)
    for d, t in tables.items():
        write_parquet(t.withColumn("chunk", F.col("vec_id") % 4), f"{out}/{d}", partition_by=["chunk"])
    back = {d: read_parquet(spark, f"{out}/{d}", ["vec_id", "embedding", "phase"]) for d in tables}
    allv = collect_embeddings(back, {d: {"vec_id": "food_name"} for d in back})
    side = lambda d, key: allv.filter(F.col("dataset") == d).select(F.col("food_name").alias(key), "embedding")
    got = match_in_shared_space(side("D1", "a"), side("D2", "b"), "a", "b")
    return got.select(F.col("a").alias("vec_id"), F.col("b").alias("match_vec_id"), F.round("similarity_score", 6).alias("score"))


_FLAGS = ["A", "N", "R"]


def _wide_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, item, A, N, R): mean quantity per return flag over all line
    items of every embedded item.  A mean whose whole part is divisible by 3
    counts as missing, so that every fact has gaps."""
    li = read_table(spark, sf_dir, "lineitem")
    mean = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    per = [F.when(F.floor(mean(f)) % 3 != 0, mean(f)).alias(f) for f in _FLAGS]
    emb = read_table(spark, sf_dir, "embeddings").select((F.col("label") % 3).cast("string").alias("dataset"), F.col("vec_id").alias("item"))
    return emb.join(li.groupBy(F.col("l_partkey").alias("item")).agg(*per), "item", "left").select("dataset", "item", *_FLAGS)


def transfer_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP10 + PIP11 + RSH1 + RSH2 + RSH3: dataset 0 takes facts from its
    match lists in the others, then every gap is filled from the nearest donor."""
    emb = read_table(spark, sf_dir, "embeddings")
    items = as_items(emb, (F.col("label") % 3).cast("string"), "vec_id")
    top = top_matches(items.filter("dataset = '0'"), items.filter("dataset <> '0'"), k=2, per_target=True, exclude_self=False)
    lists = match_lists(top, ["dataset", "item"], "target", "match", "score", ["1", "2"])
    full = transfer_from_lists(lists, _wide_facts(spark, sf_dir), _FLAGS, ["1", "2"], "0", ["2"], items.select("dataset", "item"))
    vec = items.select("item", "embedding")
    filled = impute_all(full.select("item", *_FLAGS), vec, "item", _FLAGS)
    return filled.select(F.col("item").alias("vec_id"), *[F.round(f, 6).alias(f"qty_{f}") for f in _FLAGS])


def fact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH3 + PRJ15: wide facts to long and back."""
    wide = _wide_facts(spark, sf_dir).withColumn("A", F.when(F.col("item") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("A")))
    back = facts_wide(facts_long(wide, "item", _FLAGS), _FLAGS)
    return back.select(F.col("item").alias("vec_id"), *[F.round(f, 6).alias(f"qty_{f}") for f in _FLAGS])


def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM1 + PRJ17 as expressions: every vector with its successor."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    score = cosine("embedding", "other")
    return e.join(nxt, "vec_id").select("vec_id", F.round(score, 6).alias("score"), F.round(similarity_to_distance(score), 6).alias("distance"))


# --- sinks and small operators --------------------------------------------------------------

def chunk_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1 + SNK4: customers processed in chunks by two runs; the first does
    two chunks, the second the rest; the output holds every row once."""
    out = f"{_folder(spark)}/chunks"
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    size = max(1, c.count() // 5)
    work = lambda df: df.withColumn("v", F.col("c_nationkey") * 2)
    run_chunks(spark, c, ["c_custkey"], size, out, work, chunk_end=2)
    run_chunks(spark, c, ["c_custkey"], size, out, work)
    return spark.read.parquet(out).select("c_custkey", "v")


def chunk_growing_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4 over an input that changes: between three runs rows are added in
    front, changed and removed.  Every row carries the run that computed it."""
    out = f"{_folder(spark)}/chunks"
    c = read_table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") != 1, F.col("c_custkey")).alias("k"), "c_nationkey", "c_name")
    later = c.filter(F.coalesce("k", F.lit(1)) % 3 != 0)
    changed = c.withColumn("c_nationkey", F.when(F.col("c_nationkey") == 7, -1).otherwise(F.col("c_nationkey"))).filter(F.coalesce(F.col("k") % 10 != 4, F.lit(True)))
    for run, part in enumerate((later, c, changed, changed)):
        run_chunks(spark, part, ["k"], 200, out, lambda d, run=run: d.withColumn("v", F.col("c_nationkey") * 2).withColumn("run", F.lit(run)))
    return spark.read.parquet(out).select(F.col("k").alias("c_custkey"), "c_name", "v", "run")


def half_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1 + SNK3: what a broken write left behind is not taken for an
    output; a published output is read and not computed again."""
    out, runs = f"{_folder(spark)}/out", []
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    s.limit(3).write.parquet(f"{out}/data-left-over")   # files without a manifest
    s.limit(5).write.parquet(f"{out}/_temporary/0/part")
    work = lambda n: lambda: runs.append(n) or s.withColumn("run", F.lit(n))
    for n in (1, 2):
        run_unless_exists(spark, out, work(n))
    s.limit(4).write.parquet(f"{out}/data-broken-off")  # a later version that never got as far as its manifest
    run_unless_exists(spark, out, work(3))
    assert runs == [1]
    return read_committed(spark, out, verify=True)


def null_key_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5 with null keys: three runs over customers some of whose keys are
    null give every key once."""
    out = _folder(spark)
    c = read_table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey")).alias("k"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("n")).distinct()
    for part in (c.filter("k % 2 = 0 or k is null"), c, c):
        process_new_keys(spark, part, ["k", "n"], f"{out}/log", lambda d: d, f"{out}/out")
    return spark.read.parquet(f"{out}/out").select("k", "n", "batch")


def processed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2 + SNK3 + SNK5: new keys only, run three times over growing input."""
    out = _folder(spark)
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    some = s.filter(F.col("s_suppkey") % 3 == 0)
    for part in (some, some, s):
        process_new_keys(spark, part, "s_suppkey", f"{out}/log", lambda d: d.withColumn("n", F.length("s_name")), f"{out}/out")
    run_unless_exists(spark, f"{out}/once", lambda: spark.read.parquet(f"{out}/out"))
    run_unless_exists(spark, f"{out}/once", lambda: s.limit(0))
    write_csv(read_committed(spark, f"{out}/once"), f"{out}/csv")
    return read_csv(spark, f"{out}/csv", "s_suppkey long, s_name string, n long, batch long").select("s_suppkey", "s_name", "n", "batch")


def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6: the quantities of all parts by order, in blocks of part columns
    whose names repeat and are numbered apart."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = dedupe_names(part, "p_name", ["p_partkey"])
    li = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    pairs = li.join(named, li["l_partkey"] == named["p_partkey"])
    blocks = matrix_blocks(pairs, "l_orderkey", "p_name", "q", width=64)
    text = F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("long").cast("string"), F.lit("-"))), " ")
    return blocks.select(F.col("row").alias("l_orderkey"), F.col("block").cast("long").alias("block"), F.get("names", F.lit(0)).alias("first_name"), text.alias("quantities"))


def item_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7 + FLT5 + PRJ6 + PRJ7 + JN4: flagged rows dropped, then row and
    distinct counts of two keys, as one row per table."""
    part = read_table(spark, sf_dir, "part").withColumn("unlikely_food_item", F.when(F.col("p_size") < 45, F.col("p_size") > 40))
    part = copy_key(drop_flagged(part), "p_name", "space", True)
    cust = read_table(spark, sf_dir, "customer")
    one = tag(uniqueness_counts(part, "space"), "part").unionByName(tag(uniqueness_counts(cust, "c_nationkey"), "customer"))
    size = tag(part.agg(F.sum("p_size").alias("size")), "part")
    return left_join_all(one, [size], "dataset")


_REL = """
WITH f AS (SELECT l_partkey, l_returnflag AS flag, arg_min(l_quantity, (l_orderkey, l_linenumber, l_shipdate, l_quantity)) AS v
           FROM lineitem WHERE l_discount < 0.09 GROUP BY 1, 2),
li AS (SELECT l_partkey, max(v) FILTER (WHERE flag = 'A') AS a, max(v) FILTER (WHERE flag = 'N') AS n, max(v) FILTER (WHERE flag = 'R') AS r FROM f GROUP BY 1)
SELECT p_partkey, p_name || ' ' || p_partkey AS description, 'Category ' || length(p_type) AS food_category,
       CASE WHEN p_size > 25 THEN p_brand END AS common_name, round(coalesce(a, n / 4.184), 6) AS energy, round(r, 6) AS protein
FROM part LEFT JOIN li ON l_partkey = p_partkey
"""

# the closed categories that the oracle needs of the food-group codes, in code order
_GROUPS_SQL = "['" + "', '".join(name.replace("'", "''") for _, name in MEXT_FOOD_GROUPS) + "']"

_TWO_PASS = """
WITH p AS (SELECT p_partkey, p_name, lower(p_type) AS hint, lower(p_type) IN ('small', 'large') AS redo FROM part),
a AS (SELECT *, CASE WHEN redo THEN 'plain' ELSE p_name END || ' item' AS d, CASE WHEN redo THEN NULL ELSE hint END AS h FROM p)
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey,
  CASE WHEN hint = 'promo' THEN 'failed' WHEN hint = 'medium' THEN 'rejected' ELSE 'ok' END AS status,
  CASE WHEN hint <> 'promo' THEN d END AS description,
  CASE WHEN hint = 'medium' THEN 'Nonsense' WHEN hint <> 'promo' THEN 'Beverages' END AS food_category,
  CASE WHEN hint <> 'promo' THEN h END AS common_name,
  CASE WHEN hint <> 'promo' THEN 'same food item' END AS food_item_discrepancy,
  CASE WHEN hint NOT IN ('promo', 'medium') THEN concat_ws(chr(10), 'Description: ' || d || '.', 'Category: Beverages.', 'Common Name: ' || h || '.') END AS text,
  hint = 'promo' AS has_error
FROM a
"""

_LETTERS = "abcdefghijklmnopqrst"
_vec = lambda col: "[" + ", ".join(f"CAST(length({col}) - length(replace({col}, '{c}', '')) AS DOUBLE)" for c in _LETTERS) + "]"

_DATASETS = """
e AS (SELECT 'D' || (label % 3) AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v, vec_id % 11 <> 0 AS final FROM embeddings),
p AS (
  SELECT a.dataset, a.item, a.final AS af, b.dataset AS target, b.item AS match, b.final AS bf,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0 ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM e a JOIN e b ON NOT (a.dataset = b.dataset AND a.item = b.item)
)"""

_FACTS = """
e AS (SELECT CAST(label % 3 AS VARCHAR) AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
w AS (SELECT e.dataset, e.item, CASE WHEN floor(q.A) % 3 <> 0 THEN q.A END AS A, CASE WHEN floor(q.N) % 3 <> 0 THEN q.N END AS N,
             CASE WHEN floor(q.R) % 3 <> 0 THEN q.R END AS R FROM e LEFT JOIN (
  SELECT l_partkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS A, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS N,
         avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY 1) q ON l_partkey = item)"""

ORACLES = {
    "ingest_relational": _REL,
    "ingest_sheet": f"""
SELECT 'item' AS kind, CAST(c_custkey AS VARCHAR) AS key, ({_GROUPS_SQL})[CAST(c_nationkey % 18 + 1 AS INTEGER)] AS a, c_name AS b FROM customer
UNION ALL SELECT 'meta', 'Energy(kcal)', 'ENERC', 'kcal'
""",
    "ingest_flat": """
SELECT 'a' AS dataset, p_partkey AS id, p_type AS food_category, p_name || ', ' || CASE WHEN p_size > 10 THEN p_brand END AS description, CAST(NULL AS DOUBLE) AS amount FROM part
UNION ALL
SELECT 'b', c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'Unclassified'), replace(c_name, 'Customer#', 'c'), CASE WHEN c_acctbal >= 0 THEN c_acctbal END FROM customer
""",
    "chunk_generations": """
SELECT c_custkey AS k, round(CASE c_custkey % 3 WHEN 0 THEN c_nationkey ELSE c_acctbal END, 2) AS v,
       CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS note, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name FROM customer
""",
    "binary_pages": "SELECT page_id, to_base64(encode(CASE WHEN coalesce(html, '') = '' THEN chr(0) ELSE html END)) AS payload_b64 FROM pages",
    "sheet_meta": """
WITH a AS (SELECT * FROM customer WHERE c_custkey = 0), b AS (SELECT * FROM customer WHERE c_custkey = 1)
SELECT 'name' AS column_name, a.c_name AS first, b.c_name AS second FROM a, b
UNION ALL SELECT 'the segment', a.c_mktsegment, b.c_mktsegment FROM a, b
UNION ALL SELECT 'nation.key', CAST(a.c_nationkey AS VARCHAR), CAST(b.c_nationkey AS VARCHAR) FROM a, b
""",
    "align_two_pass": _TWO_PASS,
    "align_resume": f"""
WITH r AS ({_TWO_PASS}), t AS (SELECT DISTINCT lower(p_name) || ' item' AS d FROM part),
p AS (SELECT r.p_partkey, t.d, list_cosine_similarity({_vec('r.text')}, {_vec('t.d')}) AS s FROM r CROSS JOIN t WHERE r.status = 'ok'),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, d) = 1)
SELECT r.p_partkey, b.d AS description, round(b.s, 6) AS score FROM r LEFT JOIN b USING (p_partkey)
""",
    "align_repeated_keys": f"""
SELECT CASE WHEN CAST(p_partkey AS BIGINT) % 5 <> 0 THEN CAST(CAST(p_partkey AS BIGINT) % 40 AS VARCHAR) END AS key, status, r.description, r.food_item_discrepancy, lower(p_type) IN ('small', 'large') AS again
FROM ({_TWO_PASS}) r JOIN (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_type FROM part) p USING (p_partkey)
""",
    "failing_calls": """
SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey * 2 END AS twice, CASE WHEN c_nationkey % 5 = 0 THEN 'ValueError: nation ' || c_nationkey END AS error FROM customer
""",
    "registry_choice": """
WITH m AS (SELECT l_partkey AS k, l_returnflag AS f, l_orderkey AS match, CASE WHEN l_discount < 0.09 THEN l_quantity END AS s FROM lineitem),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k, f ORDER BY s IS NULL, s DESC, match) = 1),
j AS (SELECT p_partkey, a.match AS a_match, r.match AS r_match, coalesce(a.s, -1) AS sa, coalesce(r.s, -1) AS sr
      FROM part LEFT JOIN o a ON a.k = p_partkey AND a.f = 'A' LEFT JOIN o r ON r.k = p_partkey AND r.f = 'R'),
c AS (SELECT *, CASE WHEN greatest(sa, sr) < 0 THEN 'none' WHEN sa >= sr THEN 'A' ELSE 'R' END AS reason FROM j)
SELECT p_partkey, CASE WHEN greatest(sa, sr) >= 50 THEN 'elsewhere' WHEN reason = 'none' THEN 'no_relevant_match' ELSE reason END AS database_choice,
       reason, greatest(sa, sr) < 50 AS accepted, a_match, r_match FROM c
""",
    "name_choice": """
WITH c AS (SELECT c_custkey, list_filter([CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END, CASE WHEN c_nationkey < 20 THEN c_mktsegment END], lambda x: x IS NOT NULL AND x <> '') AS o FROM customer)
SELECT c_custkey, CASE WHEN len(o) = 0 THEN 'old' WHEN NOT ends_with(o[1], '7') THEN o[-1] END AS name FROM c
""",
    "mapping_validated": f"""
WITH {_DATASETS}
SELECT dataset, item, target, match, CAST(row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, CAST(match AS VARCHAR)) AS INTEGER) AS rank,
       CASE WHEN target = 'D0' THEN CAST(match AS VARCHAR) ELSE 'n' || match END AS match_space_name,
       round(s, 6) AS score, CASE WHEN dataset = 'D0' AND target = 'D1' THEN s >= 0.25 END AS same_item
FROM p QUALIFY row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, CAST(match AS VARCHAR)) <= 2
""",
    "mapping_incremental": """
WITH e AS (SELECT 'D' || (label % 4) AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
             CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0 ELSE list_cosine_similarity(a.v, b.v) END AS s
      FROM e a JOIN e b ON NOT (a.dataset = b.dataset AND a.item = b.item))
SELECT dataset, item, target, match, round(s, 6) AS score,
       CASE WHEN (dataset = 'D0' AND target = 'D1') OR (dataset = 'D3' AND target = 'D2') THEN s >= 0.25 END AS same_item
FROM p QUALIFY row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, CAST(match AS VARCHAR)) = 1
""",
    "shared_space": f"""
WITH {_DATASETS}
SELECT item AS vec_id, match AS match_vec_id, round(s, 6) AS score FROM p WHERE dataset = 'D1' AND target = 'D2' AND af AND bf
QUALIFY row_number() OVER (PARTITION BY item ORDER BY s DESC, match) = 1
""",
    "transfer_impute": f"""
WITH {_FACTS},
p AS (SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
             CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0 ELSE list_cosine_similarity(a.v, b.v) END AS s
      FROM e a JOIN e b ON a.item <> b.item),
top AS (SELECT * FROM p WHERE dataset = '0' AND target <> '0' QUALIFY row_number() OVER (PARTITION BY item, target ORDER BY s DESC, match) <= 2),
moved AS (SELECT top.item, """ + ", ".join(f"coalesce(avg(w.{f}) FILTER (WHERE target <> '2'), avg(w.{f}) FILTER (WHERE target = '2')) AS {f}" for f in _FLAGS) + """
          FROM top LEFT JOIN w ON w.dataset = target AND w.item = match GROUP BY top.item),
f AS (SELECT item, A, N, R FROM moved UNION ALL SELECT item, A, N, R FROM w WHERE dataset <> '0'),
""" + ",\n".join(f"""d{f} AS (SELECT f.item, f2.{f} AS v FROM f JOIN f f2 ON f.{f} IS NULL AND f2.{f} IS NOT NULL JOIN p ON p.item = f.item AND p.match = f2.item
          QUALIFY row_number() OVER (PARTITION BY f.item ORDER BY p.s DESC, f2.item) = 1)""" for f in _FLAGS) + """
SELECT f.item AS vec_id, """ + ", ".join(f"round(coalesce(f.{f}, d{f}.v), 6) AS qty_{f}" for f in _FLAGS) + """
FROM f """ + " ".join(f"LEFT JOIN d{f} ON d{f}.item = f.item" for f in _FLAGS) + """
""",
    "fact_round_trip": f"""
WITH {_FACTS}
SELECT item AS vec_id, round(CASE WHEN item % 7 <> 0 THEN A END, 6) AS qty_A, round(N, 6) AS qty_N, round(R, 6) AS qty_R FROM w
""",
    "pair_cosine": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0 ELSE list_cosine_similarity(a.v, b.v) END AS s FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(s, 6) AS score, round(least(1.0, greatest(0.0, 1.0 - s)), 6) AS distance FROM p
""",
    "chunk_resume": "SELECT c_custkey, c_nationkey * 2 AS v FROM customer",
    "chunk_growing_input": """
WITH c AS (SELECT CASE WHEN c_custkey <> 1 THEN c_custkey END AS k, c_nationkey AS n, c_name FROM customer)
SELECT k AS c_custkey, c_name, CASE WHEN n = 7 THEN -1 ELSE n END * 2 AS v, CASE WHEN n = 7 THEN 2 WHEN coalesce(k, 1) % 3 = 0 THEN 1 ELSE 0 END AS run
FROM c WHERE coalesce(k % 10 <> 4, true)
""",
    "half_written": "SELECT s_suppkey, s_name, 1 AS run FROM supplier",
    "null_key_log": """
SELECT DISTINCT CASE WHEN c_custkey % 50 <> 0 THEN c_custkey END AS k, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS n,
       CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS batch FROM customer
""",
    "processed_log": "SELECT s_suppkey, s_name, length(s_name) AS n, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS batch FROM supplier",
    "score_matrix": """
WITH n AS (SELECT p_partkey, p_name || CASE WHEN row_number() OVER w > 1 THEN '_' || (row_number() OVER w - 1) ELSE '' END AS name FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)),
q AS (SELECT l_orderkey, name, sum(l_quantity) AS q FROM lineitem JOIN n ON l_partkey = p_partkey GROUP BY ALL),
c AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS pos FROM (SELECT DISTINCT name FROM q)),
b AS (SELECT DISTINCT l_orderkey, pos // 64 AS block FROM q JOIN c USING (name)),
f AS (SELECT b.l_orderkey, b.block, c.pos, c.name, q.q FROM b JOIN c ON c.pos // 64 = b.block LEFT JOIN q ON q.l_orderkey = b.l_orderkey AND q.name = c.name)
SELECT l_orderkey, block, arg_min(name, pos) AS first_name, string_agg(coalesce(CAST(CAST(q AS BIGINT) AS VARCHAR), '-'), ' ' ORDER BY pos) AS quantities FROM f GROUP BY l_orderkey, block
""",
    "item_profile": """
WITH p AS (SELECT * FROM part WHERE NOT coalesce(CASE WHEN p_size < 45 THEN p_size > 40 END, false))
SELECT 'part' AS dataset, count(*) AS n_rows, count(DISTINCT p_name) AS n_distinct, sum(p_size) AS size FROM p
UNION ALL SELECT 'customer', count(*), count(DISTINCT c_nationkey), NULL FROM customer
""",
}
# the event types are the columns of the wide form
ORACLES["ingest_nested_json"] = "SELECT 'user ' || (user_id % 50) AS description, " + ", ".join(
    f"avg(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1"

QUERIES = {f.__name__: f for f in (
    ingest_relational, ingest_nested_json, ingest_sheet, chunk_generations, binary_pages, ingest_flat, sheet_meta, align_two_pass, align_resume, failing_calls,
    registry_choice, name_choice, mapping_validated, shared_space, transfer_impute, fact_round_trip, pair_cosine,
    align_repeated_keys, mapping_incremental, chunk_resume, chunk_growing_input, half_written, null_key_log, processed_log, score_matrix, item_profile)}
