"""Dataset specifications (SRC9, data model): key column, record fields, text
rules, closed category domains, render template and simplification fields,
plus the path resolver.  A spec turns a raw item table into checked,
normalised items with one rendered text each.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .functions.text import render_lines, with_normalised_text
from .operators.checks import UNCLASSIFIED, coerce_to_domain, require_columns, split_by_domain
from .sources.readers import literal_table

# ---------------------------------------------------------------------------------------------
# Closed category domains of the catalogues, exactly as published
# (value text, in the published order).  Matching is exact and case-sensitive.
# ---------------------------------------------------------------------------------------------
DOMAINS: dict[str, list[str]] = {
    "FNDDS.food_category": [
        "Dairy Products", "Soups and Sauces", "Baby Foods", "Beverages", "Prepared Foods", "Unclassified",
        "Desserts and Sweets", "Mixed Dishes", "Eggs and Egg Dishes", "Whole Meats", "Fast Food Items", "Seafood",
        "Vegetables", "Legumes and Beans", "Snack Foods", "Nuts and Seeds", "Breakfast Items", "Fruits and Juices",
        "Baked Goods", "Grain-Based Snacks", "Fried Foods", "Fats and Oils"],
    "SR_Legacy.food_category": [
        "Dairy and Egg Products", "Spices and Herbs", "Baby Foods", "Fats and Oils", "Poultry Products",
        "Soups, Sauces, and Gravies", "Sausages and Luncheon Meats", "Breakfast Cereals", "Fruits and Fruit Juices",
        "Pork Products", "Vegetables and Vegetable Products", "Nut and Seed Products", "Beef Products", "Beverages",
        "Finfish and Shellfish Products", "Legumes and Legume Products", "Lamb, Veal, and Game Products",
        "Baked Products", "Sweets", "Cereal Grains and Pasta", "Fast Foods", "Meals, Entrees, and Side Dishes",
        "Snacks", "American Indian/Alaska Native Foods", "Restaurant Foods", "Branded Food Products Database",
        "Quality Control Materials", "Alcoholic Beverages", "Dietary Supplements"],
    "NearEast.food_category": [
        "CEREALS AND GRAIN PRODUCTS", "STARCHY ROOTS AND TUBERS", "DRY GRAIN LEGUMES AND LEGUME PRODUCTS",
        "NUTS AND SEEDS", "VEGETABLES", "FRUITS", "SUGARS, STRUPS AND SWEETS", "MEAT AND POULTRY", "EGGS",
        "FISH AND SHELLFISH", "MILK AND MILK PRODUCTS", "OILS AND FATS", "BEVERAGES", "MISCELLANEOUS",
        "Unclassified"],
    "UAEChatGPT.category": [
        "MEAT, POULTRY & EGG", "MILK & DAIRY PRODUCTS", "BREAD & BREAD PRODUCTS", "FRUIT", "VEGETABLES", "LEGUMES",
        "NUTS & SEEDS", "FISH", "FATS & OILS", "HERBS & SPICES", "BEVERAGES", "LOCAL FAST FOOD",
        "WESTERN FAST FOOD", "Unclassified"],
    "Bahrain.food_category": [
        "Cereal and Cereal Products", "Bread and Bread Products", "Fruit", "Vegetables", "Legumes",
        "Nuts and Seeds", "Meat Poultry and Egg", "Fish", "Milk and Dairy Products", "Fats and Oils",
        "Herbs and Spices", "Beverages", "Local Fast Food", "Western Fast Food", "Miscellaneous",
        "Ready To Eat Food", "Bakery Products", "Local and Western Fast Food", "Traditional Confections", "Pizzas",
        "Raw and Cooked Fish", "Unclassified"],
    "Bahrain.food_subcategory": [
        "Fast foods of local origin", "Fast foods of western origin", "Raw", "Grilled", "Curried", "Fried",
        "Cooked in rice", "Unclassified"],
    "MEXT2015.food_category": [
        "Grains", "Fish and Shellfish", "Meat", "Eggs", "Dairy Products", "Fats and Oils", "Vegetables", "Fruit",
        "Nuts and Seeds", "Sugars and Sweeteners", "Seasonings and Spices", "Prepared and Processed Foods",
        "Beverages", "Confectioneries", "Mushrooms", "Algae", "Potatoes and Starches", "Pulses"],
    "FooDB.food_group": [
        "Herbs and Spices", "Vegetables", "Fruits", "Nuts", "Cereals and cereal products", "Pulses", "Teas",
        "Gourds", "Coffee and coffee products", "Soy", "Cocoa and cocoa products", "Beverages", "Aquatic foods",
        "Animal foods", "Milk and milk products", "Eggs", "Confectioneries", "Baking goods", "Dishes",
        "Snack foods", "Baby foods", "Unclassified", "Fats and oils", "Herbs and spices", "Other seeds"],
    "FooDB.food_subgroup": [
        "Herbs", "Cabbages", "Tropical fruits", "Onion-family vegetables", "Nuts", "Spices", "Root vegetables",
        "Shoot vegetables", "Cereals", "Leaf vegetables", "Oilseed crops", "Peas", "Teas", "Fruit vegetables",
        "Gourds", "Citrus", "Coffee", "Pomes", "Berries", "Other fruits", "Soy", "Tubers", "Lentils",
        "Other pulses", "Beans", "Drupes", "Stalk vegetables", "Cocoa", "Fermented beverages", "Other breads",
        "Cereal products", "Soy products", "Doughs", "Distilled beverages", "Fortified wines",
        "Alcoholic beverages", "Mollusks", "Seaweed", "Crustaceans", "Fishes", "Cetaceans", "Bovines", "Swine",
        "Other seeds", "Other vegetables", "Poultry", "Venison", "Equines", "Other aquatic foods", "Pinnipeds",
        "Lagomorphs", "Ovis", "Caprae", "Mushrooms", "Amphibians", "Fermented milk products", "Unfermented milks",
        "Eggs", "Frozen desserts", "Other confectioneries", "Candies", "Seasonings", "Desserts", "Other dishes",
        "Snack foods", "Flat breads", "Dressings", "Sauces", "Other milk products", "Substitutes", "Sugars",
        "Ground meat", "Condiments", "Baking goods", "Fruit products", "Waters", "Fish products",
        "Other beverages", "Baby foods", "Vegetable products", "Unclassified", "Animal fats", "Spreads",
        "Herb and spice mixtures", "Cocoa products", "Fermented milks", "Leavened breads", "Roe",
        "Nutritional beverages", "Tex-Mex cuisine", "Sandwiches", "Milk desserts", "Asian cuisine",
        "Herbal teas", "Pasta dishes", "Berber cuisine", "Coffee products", "Mexican cuisine", "Potato dishes",
        "American cuisine", "Wrappers", "Vegetable fats", "Latin American cuisine", "Bread products",
        "Sweet breads", "Jewish cuisine", "Levantine cuisine", "Brassicas", "Cereals and cereal products",
        "Cocoa and cocoa products", "Coffee and coffee products", "Milk and milk products", "Fats and oils",
        "Herbs and Spices", "Pulses", "Beverages", "Fruits", "Green vegetables", "Bivalvia"],
    "HPP.serving_unit": [
        "gram", "very small unit", "large bottle", "small portion", "long", "Italian tomato", "small",
        "cup chopped or sliced", "bottle", "cherry tomato", "cup", "large carton", "tablespoon", "medium",
        "small unit", "cup of cherry tomatoes", "large portion", "grams", "cup mashed", "carton", "medium portion",
        "thin slice", "slice", "large unit", "medium unit", "teaspoon", "half cup slices", "kilogram",
        "small carton", "bag", "not_relevant"],
    "FoodItem.food_item_discrepancy": [
        "not same food item", "likely not same food item", "likely same food item", "same food item"],
}

# MEXT food-group codes (zero-padded strings) and their categories, in code order.
MEXT_FOOD_GROUPS = [
    ("01", "Grains"), ("02", "Potatoes and Starches"), ("03", "Sugars and Sweeteners"), ("04", "Pulses"),
    ("05", "Nuts and Seeds"), ("06", "Vegetables"), ("07", "Fruit"), ("08", "Mushrooms"), ("09", "Algae"),
    ("10", "Fish and Shellfish"), ("11", "Meat"), ("12", "Eggs"), ("13", "Dairy Products"), ("14", "Fats and Oils"),
    ("15", "Confectioneries"), ("16", "Beverages"), ("17", "Seasonings and Spices"),
    ("18", "Prepared and Processed Foods"),
]

# Discrepancy values that send a record to the second pass
SECOND_PASS_FLAGS = ["not same food item", "likely not same food item"]


@dataclass(frozen=True)
class DatasetSpec:
    """One catalogue: its key, record fields and rules.

    ``template`` lines are ``(label, field, mode)`` (see ``render_lines``);
    ``coerce`` fields fall back to ``Unclassified`` outside their domain,
    ``strict`` fields reject rows outside it.
    """
    name: str
    key: str
    fields: tuple[str, ...]
    text_fields: tuple[str, ...] = ()
    coerce: tuple[str, ...] = ()
    strict: tuple[str, ...] = ()
    template: tuple[tuple[str, str, str], ...] = ()
    simplify: tuple[str, ...] = ()

    def domain(self, fld: str) -> list[str]:
        return DOMAINS[f"{self.name}.{fld}"]


# The published record layouts (fields, validated text fields, domains,
# text templates with their labels, fields cleared by simplification).
SPECS: dict[str, DatasetSpec] = {s.name: s for s in [
    DatasetSpec("FNDDS", "description", ("description", "food_category", "food_subcategory"),
                text_fields=("description",), coerce=("food_category",),
                template=(("Description", "description", "required"), ("food_category", "food_category", "required"),
                          ("food_sub_category", "food_subcategory", "none")),
                simplify=("food_category",)),
    DatasetSpec("SR_Legacy", "description", ("description", "food_category", "common_name"),
                text_fields=("description", "common_name"), strict=("food_category",),
                template=(("Description", "description", "required"), ("Category", "food_category", "required"),
                          ("Common Name", "common_name", "optional")),
                simplify=("food_category", "common_name")),
    DatasetSpec("FooDB", "name", ("name", "food_group", "food_subgroup"),
                text_fields=("name",), coerce=("food_group", "food_subgroup"),
                template=(("Name", "name", "required"), ("Food_group", "food_group", "required"),
                          ("Food_sub_group", "food_subgroup", "required")),
                simplify=("food_group", "food_subgroup")),
    DatasetSpec("HPP", "hebrew_name", ("hebrew_name", "short_description", "category_hint"),
                text_fields=("short_description", "category_hint"),
                template=(("Name in Hebrew", "hebrew_name", "required"),
                          ("Short Description", "short_description", "optional"),
                          ("Category Hint", "category_hint", "optional")),
                simplify=("short_description", "category_hint")),
    DatasetSpec("Zameret", "hebrew_name", ("hebrew_name", "english_name"),
                text_fields=("hebrew_name", "english_name"),
                template=(("hebrew_name", "hebrew_name", "required"), ("english_name", "english_name", "required")),
                simplify=("english_name",)),
    DatasetSpec("NearEast", "description", ("description", "food_category"),
                text_fields=("description",), coerce=("food_category",),
                template=(("Description", "description", "required"), ("food_category", "food_category", "required")),
                simplify=("food_category",)),
    DatasetSpec("MEXT2015", "food_item", ("food_item", "food_category"),
                text_fields=("food_item",), strict=("food_category",),
                template=(("Food Item", "food_item", "required"), ("Category", "food_category", "required")),
                simplify=("food_category",)),
    DatasetSpec("UAEChatGPT", "food", ("food", "category"),
                text_fields=("food",), coerce=("category",),
                template=(("Description", "food", "required"), ("food_category", "category", "required")),
                simplify=("category",)),
    DatasetSpec("Bahrain", "food", ("food", "food_category", "food_subcategory", "local_name", "scientific_name",
                                    "arabic_name"),
                text_fields=("food",), coerce=("food_category", "food_subcategory"),
                template=(("Food", "food", "required"), ("Food_category", "food_category", "required"),
                          ("Food_subcategory", "food_subcategory", "required"), ("Local_name", "local_name", "none"),
                          ("Scientific_name", "scientific_name", "none"), ("Arabic_name", "arabic_name", "none")),
                simplify=("food_category", "food_subcategory", "local_name", "scientific_name", "arabic_name")),
    DatasetSpec("Aus", "food_name", ("food_name",), text_fields=("food_name",),
                template=(("Description", "food_name", "required"),)),
]}


def prepare_items(df: DataFrame, spec: DatasetSpec, text_col: str = "text", mode: str = "quarantine"):
    """Check and normalise raw items, render one text per item.

    CHK1 required fields; TXT1 on the text fields; CHK3 coercion;
    CHK4 strict domains (rejected rows returned apart); TXT2 rendering.
    Returns ``(items, rejected)``.
    """
    require_columns(df, spec.fields)
    out = df
    for f in spec.text_fields:
        out = with_normalised_text(out, f)
    out = out.withColumns({f: coerce_to_domain(f, spec.domain(f), UNCLASSIFIED) for f in spec.coerce})
    rejected = None
    for f in spec.strict:
        out, bad = split_by_domain(out, f, spec.domain(f), mode)
        rejected = bad if rejected is None else rejected.unionByName(bad)
    out = out.withColumn(text_col, render_lines(spec.template))
    return out, rejected


def simplify_items(df: DataFrame, spec: DatasetSpec, mask=None) -> DataFrame:
    """PRJ18 with the spec's field list."""
    from .functions.columns import simplify
    return simplify(df, list(spec.simplify), mask)


@dataclass(frozen=True)
class Paths:
    """SRC9: table locations of one dataset (and of a dataset pair) under a base path."""
    base: str
    dataset: str
    other: str | None = None
    extra: dict = field(default_factory=dict)

    def _p(self, *parts) -> str:
        return posixpath.join(self.base, *parts)

    @property
    def raw(self) -> str:
        return self._p(self.dataset, "RawData")

    @property
    def items(self) -> str:
        return self._p(self.dataset, "FoodItems")

    @property
    def facts(self) -> str:
        return self._p(self.dataset, "Nutrients")

    @property
    def portions(self) -> str:
        return self._p(self.dataset, "FoodPortions")

    def _pair(self, what: str) -> str:
        if self.other is None:
            raise ValueError("pair path needs the other dataset")
        return self._p(self.dataset, self.other, what)

    @property
    def embeddings(self) -> str:
        return self._pair("Embeddings")

    @property
    def pair_scores(self) -> str:
        return self._pair("DistanceMatrix")

    @property
    def top_match(self) -> str:
        return self._pair("TopMatch")

    @property
    def comparison(self) -> str:
        return self._pair("DatabaseComparison")

    def top_n(self, space: str, n: int) -> str:
        return self._p("AggregatedMap", space, f"top_{n}")

    def validated(self, space: str, n: int, kind: str) -> str:
        return self._p("AggregatedMap", space, f"top_{n}_validated_{kind}")


def mext_groups(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(c, n) for c, n in MEXT_FOOD_GROUPS], "food_group string, food_category string")
