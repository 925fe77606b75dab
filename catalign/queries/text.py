"""Driver queries for text, rendering, checks, projections and array helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import is_member, pack_non_empty
from ..functions.columns import concat_strict, energy_kcal, fill_null
from ..functions.text import property_value, render_lines, render_properties, with_normalised_text
from ..operators.checks import coerce_to_domain, column_profile, duplicate_keys, split_by_domain
from ..operators.matching import top_k
from ..operators.tables import markdown_cells, promote_header, row_slice
from ..session import read_table

# closed category set used by the domain queries (p_type has six values)
PART_TYPE_DOMAIN = ["ECONOMY", "LARGE", "MEDIUM", "PROMO"]


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", spread=True).select(F.lit("documents").alias("src"), F.col("doc_id").alias("key"), F.col("text").alias("t"))
    pages = read_table(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("key"), F.col("url").alias("t"))
    part = read_table(spark, sf_dir, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("key"), F.col("p_name").alias("t"))
    return with_normalised_text(docs.unionByName(pages).unionByName(part), "t", "norm_text").drop("t")


def turn_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT1 over whole conversation turns and benchmark passages."""
    conv = read_table(spark, sf_dir, "conversations", spread=True).select(
        F.lit("conversations").alias("src"), F.col("conv_id").alias("key"), F.col("turn").alias("sub"),
        F.col("text").alias("t"))
    bench = read_table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("src"), F.col("item_id").alias("key"), F.lit(0).cast("long").alias("sub"),
        F.col("text").alias("t"))
    return with_normalised_text(conv.unionByName(bench), "t", "norm_text").drop("t")


def _part_lines():
    return [("Name", "p_name", "required"),
            ("Brand", F.when(F.col("p_size") <= 40, F.col("p_brand")), "optional"),
            ("Type", F.when(F.col("p_size") <= 45, F.col("p_type")), "required"),
            ("Size", "p_size", "required")]


def item_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select(
        F.lit("part").alias("src"), F.col("p_partkey").alias("key"), render_lines(_part_lines()).alias("rendered"))
    cust = read_table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("src"), F.col("c_custkey").alias("key"),
        render_properties([
            ("name", property_value(F.col("c_name"))),
            ("segment", property_value(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(F.lit("")))),
            ("nation", property_value(F.col("c_nationkey"), "number")),
        ]).alias("rendered"))
    return part.unionByName(cust)


def domain_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select("p_partkey", coerce_to_domain("p_type", PART_TYPE_DOMAIN).alias("p_type"))


def domain_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    _, rejected = split_by_domain(part, "p_type", PART_TYPE_DOMAIN)
    return rejected


def required_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(read_table(spark, sf_dir, "part"), ["p_name"])


def events_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    # a column with gaps: value only for purchases
    ev = ev.withColumn("purchase_value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return column_profile(ev)


def fill_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    seg = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    out = c.select("c_custkey", seg.alias("segment"), concat_strict("c_name", seg).alias("name_segment"))
    return fill_null(out, {"segment": "Unclassified"})


def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    kcal = F.when(F.col("l_discount") >= 0.05, F.col("l_extendedprice"))
    kj = F.col("l_quantity") * F.lit(100.0)
    return li.select("l_orderkey", "l_linenumber", F.round(energy_kcal(kcal, kj), 6).alias("energy_kcal"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    cands = pack_non_empty([F.col("c_name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(F.lit("")),
                            F.when(F.col("c_nationkey") < 10, F.col("c_mktsegment"))])
    return c.select("c_custkey", F.array_join(cands, "|").alias("candidates"), F.size(cands).alias("n_candidates"),
                    is_member(F.col("c_mktsegment"), cands).alias("chosen_valid"))


def _customer_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", spread=True)
    text = F.concat(F.lit("| c_custkey | c_name | c_mktsegment | note |\n|---|---|---|---|\n| "),
                    F.col("c_custkey").cast("string"), F.lit(" | "), F.col("c_name"), F.lit(" | "),
                    F.col("c_mktsegment"), F.lit(" |  |"))
    return c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


def md_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_cells(_customer_markdown(spark, sf_dir), "doc_id", "text")


def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3: one markdown table an order, one line a line item: a column that
    is empty in every line of some orders, one that is empty in all, and a
    last cell that only odd line numbers have."""
    li = read_table(spark, sf_dir, "lineitem")
    line = F.struct("l_linenumber", F.floor("l_quantity").alias("qty"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise("").alias("flag"))
    orders = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    body = F.transform("_lines", lambda r: F.concat(
        F.lit("| "), r["qty"].cast("string"), F.lit(" | "), r["flag"], F.lit(" |  |"),
        F.when(r["l_linenumber"] % 2 == 1, F.concat(F.lit(" x"), r["l_linenumber"].cast("string"), F.lit(" |"))).otherwise("")))
    head = F.lit("| qty | flag | gap | note |\n|---|:--|---|---|\n")
    return markdown_cells(orders.select("doc_id", F.concat(head, F.array_join(body, "\n")).alias("text")), "doc_id", "text")


def sheet_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6 + PRJ9: sheet rows whose header sits in row 4 and two metadata rows
    follow it; data rows are the customer table."""
    c = read_table(spark, sf_dir, "customer")
    cols = ["a", "b", "c"]
    top = spark.createDataFrame(
        [(0, "Standard tables", None, None), (1, None, None, None), (2, None, None, None), (3, None, None, None),
         (4, "Cust\nKey", "Customer name", "Market\nsegment"), (5, "KEY", "NAME", "SEG"), (6, "-", "-", "-")],
        "_idx long, a string, b string, c string")
    data = c.select((F.col("c_custkey") + 7).alias("_idx"), F.col("c_custkey").cast("string").alias("a"),
                    F.col("c_name").alias("b"), F.col("c_mktsegment").alias("c"))
    rows = top.unionByName(data)
    promoted = promote_header(rows, "_idx", 4, cols)
    return promoted.filter(F.col("_idx") > 6).drop("_idx")


def part_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    out = row_slice(part, [F.desc("p_retailprice"), F.asc("p_partkey")], 100, 200)
    return out.select("p_partkey", "p_retailprice", F.col("position").cast("long").alias("position"))


def part_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return top_k(part, 10, [F.desc("p_retailprice"), F.asc("p_partkey")])


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# the oracle's own statement of the rule: the white space of the text rule, the
# characters not counted, the longest word and the bounds of the length
_WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}-\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP_PATTERN, SPLIT_PATTERN = rf"\A{_WS}+|{_WS}+\z", f"{_WS}+"
CLEAN_DROP_CHARS = ",\"'()\t _"
MAX_WORD_CHARS, MIN_CLEAN_CHARS, MAX_CLEAN_CHARS = 20, 2, 200
_TAB, _NL = "chr(9)", "chr(10)"
_DROP = " || ".join(_TAB if ch == "\t" else _sql_str(ch) for ch in CLEAN_DROP_CHARS)
_TXT1_SQL = f"""
s0 AS (SELECT src, key{{extra}}, lower(regexp_replace(replace(replace(replace(t, {_NL}, ''), {_TAB}, ' '), '-', ' '),
                                             {_sql_str(STRIP_PATTERN)}, '', 'g')) AS s FROM raw),
s1 AS (SELECT src, key{{extra}}, replace(replace(replace(replace(replace(s, '\\', ' '), '/', ' '), '  ', ' '), '":', ''), ',', ' ') AS s FROM s0)
SELECT src, key{{extra}},
  CASE WHEN len(list_filter(regexp_split_to_array(s, {_sql_str(SPLIT_PATTERN)}), lambda w: length(w) > {MAX_WORD_CHARS})) > 0 THEN NULL
       WHEN length(regexp_replace(translate(s, {_DROP}, ''), {_sql_str(STRIP_PATTERN)}, '', 'g')) < {MIN_CLEAN_CHARS} THEN NULL
       WHEN length(regexp_replace(translate(s, {_DROP}, ''), {_sql_str(STRIP_PATTERN)}, '', 'g')) > {MAX_CLEAN_CHARS} THEN NULL
       ELSE s END AS norm_text
FROM s1
"""

_DOMAIN_SQL = ", ".join(_sql_str(v) for v in PART_TYPE_DOMAIN)

ORACLES = {
    "text_normalise": """
WITH raw AS (
  SELECT 'documents' AS src, doc_id AS key, text AS t FROM documents
  UNION ALL SELECT 'pages', page_id, url FROM pages
  UNION ALL SELECT 'part', p_partkey, p_name FROM part),
""" + _TXT1_SQL.replace("{extra}", ""),
    "turn_normalise": """
WITH raw AS (
  SELECT 'conversations' AS src, conv_id AS key, turn AS sub, text AS t FROM conversations
  UNION ALL SELECT 'benchmark', item_id, CAST(0 AS BIGINT), text FROM benchmark),
""" + _TXT1_SQL.replace("{extra}", ", sub"),
    "item_render": """
SELECT 'part' AS src, p_partkey AS key,
  concat_ws(chr(10), 'Name: ' || coalesce(p_name, 'None') || '.',
            CASE WHEN p_size <= 40 THEN 'Brand: ' || p_brand || '.' END,
            'Type: ' || coalesce(CASE WHEN p_size <= 45 THEN p_type END, 'None') || '.',
            'Size: ' || coalesce(CAST(p_size AS VARCHAR), 'None') || '.') AS rendered
FROM part
UNION ALL
SELECT 'customer', c_custkey,
  concat_ws(chr(10), CASE WHEN c_name <> '' THEN 'name: ' || c_name END,
            CASE WHEN c_acctbal > 0 AND c_mktsegment <> '' THEN 'segment: ' || c_mktsegment END,
            CASE WHEN c_nationkey <> 0 THEN 'nation: ' || CAST(c_nationkey AS VARCHAR) END)
FROM customer
""",
    "domain_coerce": f"""
SELECT p_partkey, CASE WHEN p_type IN ({_DOMAIN_SQL}) THEN p_type ELSE 'Unclassified' END AS p_type FROM part
""",
    "domain_reject": f"""
SELECT p_partkey, p_type FROM part WHERE p_type IS NULL OR p_type NOT IN ({_DOMAIN_SQL})
""",
    "required_unique": """
SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1
""",
    "events_profile": """
WITH ev AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS purchase_value FROM events),
c AS (SELECT count(event_id) AS event_id, count(ts) AS ts, count(user_id) AS user_id, count(event_type) AS event_type,
             count(value) AS value, count(props) AS props, count(purchase_value) AS purchase_value FROM ev)
SELECT column_name, non_null, non_null > 0 AS has_values
FROM (UNPIVOT c ON event_id, ts, user_id, event_type, value, props, purchase_value INTO NAME column_name VALUE non_null)
""",
    "fill_concat": """
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'Unclassified') AS segment,
       c_name || ', ' || CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS name_segment
FROM customer
""",
    "unit_convert": """
SELECT l_orderkey, l_linenumber,
       round(coalesce(CASE WHEN l_discount >= 0.05 THEN l_extendedprice END, l_quantity * 100.0 / 4.184), 6) AS energy_kcal
FROM lineitem
""",
    "candidates": """
WITH c AS (
  SELECT c_custkey, c_mktsegment,
         list_filter([c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END,
                      CASE WHEN c_nationkey < 10 THEN c_mktsegment END], lambda x: x IS NOT NULL AND x <> '') AS cands
  FROM customer)
SELECT c_custkey, array_to_string(cands, '|') AS candidates, CAST(len(cands) AS INTEGER) AS n_candidates,
       list_contains(cands, c_mktsegment) AS chosen_valid
FROM c
""",
    "md_cells": """
SELECT c_custkey AS doc, 1 AS row, CAST(col AS INTEGER) AS col, header, value
FROM (
  SELECT c_custkey, 1 AS col, 'c_custkey' AS header, CAST(c_custkey AS VARCHAR) AS value FROM customer
  UNION ALL SELECT c_custkey, 2, 'c_name', c_name FROM customer
  UNION ALL SELECT c_custkey, 3, 'c_mktsegment', c_mktsegment FROM customer)
""",
    "md_tables": """
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, CAST(floor(l_quantity) AS BIGINT) AS qty, CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE '' END AS flag FROM lineitem),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY n, qty, flag) AS INTEGER) AS row, max(flag) OVER (PARTITION BY doc) AS any_flag FROM l)
SELECT doc, row, 1 AS col, 'qty' AS header, CAST(qty AS VARCHAR) AS value FROM r
UNION ALL SELECT doc, row, 2, 'flag', flag FROM r WHERE any_flag <> ''
UNION ALL SELECT doc, row, 4, 'note', 'x' || n FROM r WHERE n % 2 = 1
""",
    "sheet_promote": """
SELECT CAST(c_custkey AS VARCHAR) AS CustKey, c_name AS "Customer name", c_mktsegment AS Marketsegment FROM customer
""",
    "part_slice": """
SELECT p_partkey, p_retailprice, CAST(pos AS BIGINT) AS position FROM (
  SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS pos FROM part)
WHERE pos >= 100 AND pos < 200
""",
    "part_top_k": """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10
""",
}

QUERIES = {
    "text_normalise": text_normalise,
    "turn_normalise": turn_normalise,
    "item_render": item_render,
    "domain_coerce": domain_coerce,
    "domain_reject": domain_reject,
    "required_unique": required_unique,
    "events_profile": events_profile,
    "fill_concat": fill_concat,
    "unit_convert": unit_convert,
    "candidates": candidates,
    "md_cells": md_cells,
    "md_tables": md_tables,
    "sheet_promote": sheet_promote,
    "part_slice": part_slice,
    "part_top_k": part_top_k,
}
