"""Driver queries for joins, pivots, dedup, reshaping and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import drop_matching, flag_in, join_dim, keep_matching, keyed_update, reindex, to_record, with_prefix
from ..operators.matching import cross_dataset_top_n
from ..operators.reshape import (composite_name, first_per_key, match_lists, melt_match_lists,
                                 pivot_first, pivot_mean, unit_table)
from ..operators.similarity import as_items
from ..session import read_table

RETURN_FLAGS = ["A", "N", "R"]
FLAG_STATUS = ["A|F", "A|O", "N|F", "N|O", "R|F", "R|O"]


def pivot_mean_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    wide = pivot_mean(li, ["l_partkey"], "l_returnflag", "l_quantity", RETURN_FLAGS)
    return wide.select("l_partkey", *[F.round(F.col(f), 6).alias(f"qty_{f}") for f in RETURN_FLAGS])


def pivot_first_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    li = li.withColumn("name_unit", composite_name("l_returnflag", "l_linestatus")).withColumn(
        "amount", F.when(F.col("l_discount") < 0.09, F.col("l_quantity")))
    wide = pivot_first(li, ["l_partkey"], "name_unit", "amount",
                       ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"], FLAG_STATUS)
    return wide


def unit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3: distinct (name, unit) pairs, one unit excluded (as kJ is)."""
    li = read_table(spark, sf_dir, "lineitem")
    return unit_table(li, "l_returnflag", "l_linestatus", exclude_units=["F"])


def melt_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-3 long -> wide match lists per target dataset -> back to ranked long."""
    items = as_items(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")
    top = cross_dataset_top_n(items, 3)
    wide = match_lists(top, ["dataset", "item"], "target", "match", "score")
    long = melt_match_lists(wide, ["dataset", "item"], [c for c in wide.columns if c not in ("dataset", "item")])
    return long.select(F.col("item").alias("vec_id"), F.col("matched_dataset").cast("int").alias("matched_dataset"),
                       F.col("matched_name").alias("matched_vec_id"), F.round("matched_score", 6).alias("matched_score"))


def json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR2 + ARR3 + AGG1: a JSON column read once, its fields and the value
    column lifted to (name, amount) rows, then a mean pivot by description."""
    ev = read_table(spark, sf_dir, "events")
    props = ev.select(F.col("event_type").alias("description"), "value", F.from_json("props", "k double").alias("p"))
    entry = lambda name, amount: F.struct(F.lit(name).alias("nutrient"), amount.alias("amount"))
    rows = props.select("description", F.explode(F.array(entry("k", F.col("p.k")), entry("value", F.col("value")))).alias("n"))
    wide = pivot_mean(rows.select("description", "n.*"), ["description"], "nutrient", "amount", ["k", "value"])
    return wide.select("description", F.round("k", 6).alias("k"), F.round("value", 6).alias("value"))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_retailprice", "p_brand")
    return first_per_key(part, ["p_name"], ["p_retailprice", "p_partkey"])


def dim_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    supp = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    supp_geo = join_dim(join_dim(supp, nation, "s_nationkey"), region, "n_regionkey")
    out = li.join(part, "l_partkey", "inner")
    out = join_dim(out, supp_geo, "l_suppkey")
    return out.select("l_orderkey", "l_linenumber", "p_name", "s_name", "n_name", "r_name")


def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7 + JN8: rows with and without a partner in the labels, told apart by
    one left join with a marker; the two sides apart are ``keep_matching``
    and ``drop_matching`` (``doc_sides``)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    marks = read_table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return docs.join(marks, "doc_id", "left").select("doc_id", "lang", F.coalesce("_hit", F.lit(False)).alias("labelled"))


def doc_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7 + JN8 + SET3: counts per language of the documents kept by a semi
    join and of those kept by an anti join."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = read_table(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, side: df.groupBy("lang").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    return count(keep_matching(docs, labels, "doc_id"), "with").unionByName(count(drop_matching(docs, labels, "doc_id"), "without"))


def spine_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    return reindex(docs, labels, "doc_id")


def keyed_update_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11 + FLT4: toxic documents get their source replaced and their
    language nulled; all others keep theirs."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = read_table(spark, sf_dir, "labels")
    upd = labels.filter(flag_in(F.col("toxic").cast("string"), ["1"])).select("doc_id").distinct().select(
        "doc_id", F.lit("redacted").alias("source"), F.lit(None).cast("string").alias("lang"))
    return keyed_update(docs, upd, "doc_id", ["source", "lang"])


def phase_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2 + STR1 + STR2: phase-1 records, a redone subset (p_size > 40,
    simplified), the final record = redone where redone else phase 1; phases
    tagged, records expanded with a target prefix.  Whether a record is
    redone depends on its own row, so the phases are one explode."""
    part = read_table(spark, sf_dir, "part")
    fields, redo = ["p_name", "p_brand", "p_type"], F.col("p_size") > 40
    redone = F.when(redo, F.struct("p_name", F.lit(None).cast("string").alias("p_brand"), F.lower("p_type").alias("p_type")))
    rows = to_record(part.withColumn("_redone", redone), fields, keep=["p_partkey", "_redone"])
    phase = lambda name, rec: F.struct(F.lit(name).alias("phase"), rec.alias("record"))
    both = F.array(phase("final", F.coalesce("_redone", "record")), phase("first_phase_discrepancy", F.when(F.col("_redone").isNotNull(), F.col("record"))))
    rows = rows.select("p_partkey", F.explode(both).alias("p")).select("p_partkey", "p.phase", "p.record").filter(F.col("record").isNotNull())
    return with_prefix(rows, "record", "space", ["p_partkey", "phase"])


ORACLES = {
    "pivot_mean": """
SELECT l_partkey,
  round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS qty_A,
  round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS qty_N,
  round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS qty_R
FROM lineitem GROUP BY l_partkey
""",
    "pivot_first": """
WITH li AS (SELECT l_partkey, l_returnflag || '|' || l_linestatus AS nu,
                   CASE WHEN l_discount < 0.09 THEN l_quantity END AS amount,
                   l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem),
f AS (SELECT l_partkey, nu, arg_min(amount, (l_orderkey, l_linenumber, l_shipdate, l_quantity)) AS v
      FROM li WHERE amount IS NOT NULL GROUP BY l_partkey, nu)
SELECT l_partkey,
  max(v) FILTER (WHERE nu = 'A|F') AS "A|F", max(v) FILTER (WHERE nu = 'A|O') AS "A|O",
  max(v) FILTER (WHERE nu = 'N|F') AS "N|F", max(v) FILTER (WHERE nu = 'N|O') AS "N|O",
  max(v) FILTER (WHERE nu = 'R|F') AS "R|F", max(v) FILTER (WHERE nu = 'R|O') AS "R|O"
FROM f GROUP BY l_partkey
""",
    "unit_names": """
SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_linestatus NOT IN ('F')
""",
    "melt_lists": """
WITH e AS (SELECT label AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (
  SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
              ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM e a JOIN e b ON NOT (a.dataset = b.dataset AND a.item = b.item)
)
SELECT item AS vec_id, target AS matched_dataset, match AS matched_vec_id, round(s, 6) AS matched_score
FROM p QUALIFY row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, match) <= 3
""",
    "json_explode": """
SELECT event_type AS description,
       round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k,
       round(avg(value), 6) AS value
FROM events GROUP BY event_type
""",
    "dedupe_first": """
SELECT p_name, p_partkey, p_retailprice, p_brand FROM part
QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice, p_partkey) = 1
""",
    "dim_joins": """
SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name, n.n_name, r.r_name
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
""",
    "semi_anti": """
SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents
""",
    "doc_sides": """
SELECT lang, count(*) AS n, CASE WHEN l.doc_id IS NULL THEN 'without' ELSE 'with' END AS side
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1, 3
""",
    "spine_reindex": """
SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
    "keyed_update": """
SELECT d.doc_id,
       CASE WHEN t.doc_id IS NOT NULL THEN 'redacted' ELSE d.source END AS source,
       CASE WHEN t.doc_id IS NOT NULL THEN NULL ELSE d.lang END AS lang
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON d.doc_id = t.doc_id
""",
    "phase_union": """
SELECT p_partkey, p_name AS space__p_name,
       CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS space__p_brand,
       CASE WHEN p_size > 40 THEN lower(p_type) ELSE p_type END AS space__p_type,
       'final' AS phase
FROM part
UNION ALL
SELECT p_partkey, p_name, p_brand, p_type, 'first_phase_discrepancy' FROM part WHERE p_size > 40
""",
}

QUERIES = {
    "pivot_mean": pivot_mean_q,
    "pivot_first": pivot_first_q,
    "unit_names": unit_names,
    "melt_lists": melt_lists,
    "json_explode": json_explode,
    "dedupe_first": dedupe_first,
    "dim_joins": dim_joins,
    "semi_anti": semi_anti,
    "doc_sides": doc_sides,
    "spine_reindex": spine_reindex,
    "keyed_update": keyed_update_q,
    "phase_union": phase_union,
}
