"""Ingest jobs (PIP1-PIP4): heterogeneous raw files -> item and fact tables.

Facts stay long ``(item, nutrient, unit, amount)`` inside; a wide table is
produced once at the end with an explicit column list.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import KJ_PER_KCAL, columns_first, concat_strict, fill_null, rename, rename_strict
from ..operators.checks import assert_unique
from ..operators.joins import join_dim
from ..operators.reshape import pivot_first, pivot_mean, pivot_names
from ..operators.tables import promote_header, quoted, transpose_rows
from ..sources.readers import read_csv, read_nested_json, read_sheet_rows
from ..specs import mext_groups

SR_FOOD = "fdc_id long, data_type string, description string, food_category_id long, publication_date string"
SR_CATEGORY = "id long, code string, description string"
SR_ATTRIBUTE = "id long, fdc_id long, seq_num int, food_attribute_type_id int, name string, value string"
SR_FOOD_NUTRIENT = "fdc_id long, nutrient_id long, amount double"
SR_NUTRIENT = "id long, name string, unit_name string"

# fixed values of the relational catalogue: the common-name attribute type and the energy units
COMMON_NAME_TYPE = 1000
ENERGY = "Energy"
KCAL, KJ = "KCAL", "kJ"


def sr_style(spark: SparkSession, main_dir: str) -> dict[str, DataFrame]:
    """PIP1: relational CSVs -> ``items``, long ``facts_long``, wide ``facts``
    and ``units``.  Descriptions and category ids must be unique.  Of several
    amounts of one food and nutrient the first counts: by file name, then by
    place in the file (Spark reads a folder's larger files first)."""
    d = os.path.join(main_dir, "sr_legacy")
    food = read_csv(spark, os.path.join(d, "food.csv"), SR_FOOD).drop("data_type", "publication_date")
    cat = (read_csv(spark, os.path.join(d, "food_category.csv"), SR_CATEGORY)
           .withColumnsRenamed({"id": "food_category_id", "description": "food_category"}).drop("code"))
    assert_unique(food, ["description"])
    assert_unique(cat, ["food_category_id"])
    attr = (read_csv(spark, os.path.join(d, "food_attribute.csv"), SR_ATTRIBUTE)
            .filter(F.col("food_attribute_type_id") == COMMON_NAME_TYPE)
            .select("fdc_id", F.col("value").alias("common_name")))
    items = join_dim(food, cat, "food_category_id").drop("food_category_id").join(attr, "fdc_id", "left")

    fn = (read_csv(spark, os.path.join(d, "food_nutrient.csv"), SR_FOOD_NUTRIENT)
          .withColumns({"_file": F.input_file_name(), "_mono": F.monotonically_increasing_id()}))
    nut = read_csv(spark, os.path.join(d, "nutrient.csv"), SR_NUTRIENT).withColumnRenamed("id", "nutrient_id")
    long = join_dim(fn, nut, "nutrient_id").select("fdc_id", "name", "unit_name", "amount", "_file", "_mono")
    long = long.filter(F.col("name").isNotNull() & F.col("unit_name").isNotNull())
    headers = long.withColumn("_h", F.concat_ws("|", "name", "unit_name"))
    names = pivot_names(headers.filter(F.col("amount").isNotNull()), "_h")
    wide = pivot_first(headers, ["fdc_id"], "_h", "amount", ["_file", "_mono"], names)
    kcal, kj = f"{ENERGY}|{KCAL}", f"{ENERGY}|{KJ}"
    if kcal in names and kj in names:
        wide = wide.withColumn(kcal, F.coalesce(F.col(kcal), F.col(kj) / F.lit(KJ_PER_KCAL))).drop(kj)
    elif kj in names:
        wide = wide.withColumn(kcal, F.col(kj) / F.lit(KJ_PER_KCAL)).drop(kj)
    kept = [h for h in names if h != kj] + ([kcal] if kcal not in names and kj in names else [])
    wide = wide.select("fdc_id", *[F.col(f"`{h}`").alias(h.split("|", 1)[0]) for h in kept])
    units = spark.createDataFrame([tuple(h.split("|", 1)) for h in kept], "name string, unit string")
    facts = wide.join(items.select("fdc_id", "description"), "fdc_id", "left")
    return {"items": items, "facts_long": long.drop("_file", "_mono"), "facts": facts, "units": units}


def nested_json_facts(spark: SparkSession, path: str, array_field: str = "SurveyFoods",
                      nutrients: Sequence[str] | None = None, multiline: bool = True) -> dict[str, DataFrame]:
    """PIP2: JSON array of foods with nested nutrient lists -> long facts and
    a mean pivot per description.  A food with an empty list gives no row."""
    foods = read_nested_json(spark, path, array_field, multiline=multiline)
    long = (foods.select("description", F.explode("foodNutrients").alias("n"))
            .select("description", F.col("n.nutrient.name").alias("nutrient"), F.col("n.amount").alias("amount")))
    wide = pivot_mean(long, ["description"], "nutrient", "amount", nutrients)
    return {"facts_long": long, "facts": wide}


def sheet_with_offset_header(spark: SparkSession, path: str, header_row: int = 4, n_meta: int = 2,
                             n_columns: int | None = None, meta_from: int = 4,
                             name_map: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """PIP3: sheet rows whose header sits in ``header_row`` and whose next
    ``n_meta`` rows are metadata -> ``items`` (with the food-group category
    joined) and ``meta`` (column, tag, unit for columns from ``meta_from``)."""
    rows = read_sheet_rows(spark, path, n_columns)
    cols = [c for c in rows.columns if c != "_idx"]
    table = promote_header(rows, "_idx", header_row, cols)
    names = [c for c in table.columns if c != "_idx"]
    meta_rows = [header_row + 1 + i for i in range(n_meta)]
    meta = transpose_rows(table, "_idx", meta_rows, names[meta_from:], ["tag_names", "unit"][:n_meta])
    meta = meta.withColumnRenamed("column_name", "descriptions")
    data = table.filter(F.col("_idx") > header_row + n_meta)
    data = rename(data, dict(name_map or {"Food and Description": "food_item"}))
    groups = mext_groups(spark).withColumnRenamed("food_group", "Food Group")
    items = data.join(F.broadcast(groups), "Food Group", "left")  # 18 literal rows
    items = items.select(quoted("Item No."), "food_category", "food_item", "_idx")
    return {"items": items, "meta": meta, "table": data}


def near_east_items(df: DataFrame) -> DataFrame:
    """PIP4: description = FOOD || ', ' || VARIANT (null when either is)."""
    out = df.withColumn("description", concat_strict("FOOD", "VARIANT")).drop("FOOD", "VARIANT")
    return rename(out, {"CATEGORY": "food_category"})


def fill_categories(df: DataFrame, cols: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """PIP4 (sheet catalogues): empty categories -> ``Unclassified``, keep the relevant columns."""
    out = fill_null(df, {c: "Unclassified" for c in cols})
    return out.select(*keep) if keep else out


def canonical_facts(df: DataFrame, key_map: Mapping[str, str], fact_map: Mapping[str, str],
                    first: Sequence[str]) -> DataFrame:
    """PIP4 (wide fact tables): rename to the canonical vocabulary, keep
    exactly the mapped columns, keys first."""
    out = rename_strict(df, {**key_map, **fact_map})
    return columns_first(out, list(first))
