"""Driver queries for fact transfer and imputation over ``embeddings``.

Items are ``vec_id`` in dataset ``label``.  Two facts with gaps are taken
from the vectors themselves: ``f0`` = element 0 where element 1 > 0,
``f1`` = element 2 where element 3 > 0 (about half of each is missing).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.consolidate import transfer_facts, transfer_facts_long
from ..operators.impute import impute
from ..operators.joins import reindex
from ..operators.reshape import pivot_names
from ..operators.similarity import as_items, top_matches
from ..session import ensure_checkpoint_dir, read_table
from ..sources.sinks import write_bucketed

FACTS = ["f0", "f1"]
# datasets whose matches rank below all others in fact transfer
LOW_PRIORITY = [1, 2]
TRANSFER_TOP_N = 2


def _fact_columns():
    e = F.col("embedding")
    return [F.when(e[1] > 0, e[0].cast("double")).alias("f0"), F.when(e[3] > 0, e[2].cast("double")).alias("f1")]


def _facts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.col("label").alias("dataset"), F.col("vec_id").alias("item"), *_fact_columns())


def fact_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP10: every item takes facts from its best 2 matches in each other
    dataset; matches into labels 1 and 2 are the fallback."""
    items = as_items(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")
    top = top_matches(items, None, k=TRANSFER_TOP_N, per_target=True).filter(F.col("target") != F.col("dataset"))
    matches = top.select("dataset", "item", F.col("target").alias("matched_dataset"),
                         F.col("match").alias("matched_item"), F.col("score").alias("matched_score"))
    out = transfer_facts(matches, _facts_wide(spark, sf_dir), FACTS, low_priority=LOW_PRIORITY)
    return out.select(F.col("item").alias("vec_id"), *[F.round(c, 6).alias(c) for c in FACTS + ["matched_score"]])


def fact_transfer_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP10 with facts kept long ``(dataset, item, fact, value)`` (AGG5 as
    ``max_by`` over the priority); same matches and priorities as
    ``fact_transfer``."""
    items = as_items(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")
    top = top_matches(items, None, k=TRANSFER_TOP_N, per_target=True).filter(F.col("target") != F.col("dataset"))
    matches = top.select("dataset", "item", F.col("target").alias("matched_dataset"),
                         F.col("match").alias("matched_item"))
    long = _facts_wide(spark, sf_dir).unpivot(["dataset", "item"], FACTS, "fact", "value")
    out = transfer_facts_long(matches, long, low_priority=LOW_PRIORITY)
    return out.select(F.col("item").alias("vec_id"), "fact", F.round("value", 6).alias("value"))


BUCKETS = 8


def fact_transfer_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5 + JN9 (PIP10) over bucketed storage: facts, matches and spine are
    written bucketed and sorted by their keys; the facts join the matches, and
    the result the spine, without an exchange of a stored table."""
    out, name = f"{ensure_checkpoint_dir(spark)}/buckets-{uuid.uuid4().hex}", f"b{uuid.uuid4().hex}"
    items = as_items(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")
    top = top_matches(items, None, k=TRANSFER_TOP_N, per_target=True).filter(F.col("target") != F.col("dataset"))
    matches = top.select("dataset", "item", F.col("target").alias("matched_dataset"),
                         F.col("match").alias("matched_item"), F.col("score").alias("matched_score"))
    put = lambda df, what, keys: write_bucketed(df, f"{name}_{what}", f"{out}/{what}", keys, BUCKETS)
    facts = put(_facts_wide(spark, sf_dir), "facts", ["dataset", "item"])
    matches = put(matches, "matches", ["matched_dataset", "matched_item"])
    spine = put(items.select("dataset", "item"), "spine", ["dataset", "item"])
    moved = transfer_facts(matches.hint("merge"), facts, FACTS, low_priority=LOW_PRIORITY)
    full = reindex(spine.hint("merge"), moved, ["dataset", "item"], check_unique=False)
    return full.select(F.col("item").alias("vec_id"), *[F.round(c, 6).alias(c) for c in FACTS + ["matched_score"]])


def _impute(spark, sf_dir, k, weights):
    emb = read_table(spark, sf_dir, "embeddings")
    wide = emb.select(F.col("vec_id").alias("item"), *_fact_columns())
    facts = wide.unpivot(["item"], FACTS, "fact", "value")
    vectors = emb.select(F.col("vec_id").alias("item"), "embedding")
    out = impute(facts, vectors, k=k, weights=weights)
    return out.select(F.col("item").alias("vec_id"), "fact", F.round("value", 6).alias("value"), "imputed")


def impute_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impute(spark, sf_dir, 1, "distance")


def impute_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impute(spark, sf_dir, 3, "distance")


# neighbours listed per item at first
NEIGHBOURS = 32


def _item_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts of every embedded item from its line items: the mean
    quantity per return flag and line number (a fact each), null where the
    item has no such line."""
    li = read_table(spark, sf_dir, "lineitem")
    seen = li.groupBy(F.col("l_partkey").alias("item"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("fact")).agg(
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("value"))
    names = F.array(*[F.lit(f) for f in pivot_names(seen, "fact")])  # 3 flags by 7 line numbers
    spine = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.explode(names).alias("fact"))
    return spine.join(seen, ["item", "fact"], "left")


def impute_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMP1-IMP3 with neighbour lists, which rare facts double several
    times, over the facts of the line items."""
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    out = impute(_item_facts(spark, sf_dir), vectors, k=3, weights="uniform", neighbours=NEIGHBOURS)
    return out.select(F.col("item").alias("vec_id"), "fact", F.round("value", 6).alias("value"), "imputed")


def impute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same weighted by distance."""
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    out = impute(_item_facts(spark, sf_dir), vectors, k=3, weights="distance")
    return out.select(F.col("item").alias("vec_id"), "fact", F.round("value", 6).alias("value"), "imputed")


def impute_k3_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impute(spark, sf_dir, 3, "uniform")


_FACTS_SQL = """
e AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT vec_id AS item, 'f0' AS fact, CASE WHEN embedding[2] > 0 THEN CAST(embedding[1] AS DOUBLE) END AS value FROM embeddings
      UNION ALL
      SELECT vec_id, 'f1', CASE WHEN embedding[4] > 0 THEN CAST(embedding[3] AS DOUBLE) END FROM embeddings),
miss AS (SELECT f.item, f.fact, e.v FROM f JOIN e USING (item) WHERE f.value IS NULL),
don AS (SELECT f.item AS donor, f.fact, f.value, e.v FROM f JOIN e USING (item) WHERE f.value IS NOT NULL),
p AS (SELECT m.item, m.fact, d.donor, d.value,
             CASE WHEN list_dot_product(m.v, m.v) = 0 OR list_dot_product(d.v, d.v) = 0 THEN 0.0
                  ELSE list_cosine_similarity(m.v, d.v) END AS s
      FROM miss m JOIN don d ON m.fact = d.fact)
"""


_LINE_FACTS_SQL = """
e AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
seen AS (SELECT l_partkey AS item, l_returnflag || l_linenumber AS fact, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS value FROM lineitem GROUP BY ALL),
f AS (SELECT e.item, n.fact, seen.value FROM e CROSS JOIN (SELECT DISTINCT fact FROM seen) n LEFT JOIN seen ON seen.item = e.item AND seen.fact = n.fact),
miss AS (SELECT item, fact FROM f WHERE value IS NULL),
don AS (SELECT item AS donor, fact, value FROM f WHERE value IS NOT NULL),
pairs AS MATERIALIZED (SELECT a.item, b.item AS donor,
                 CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
                      ELSE list_cosine_similarity(a.v, b.v) END AS s
          FROM e a JOIN e b ON a.item <> b.item),
p AS (SELECT m.item, m.fact, d.donor, d.value, pairs.s
      FROM pairs JOIN miss m ON m.item = pairs.item JOIN don d ON d.donor = pairs.donor AND d.fact = m.fact)
"""


def _impute_sql(k: int, weights: str, facts: str = _FACTS_SQL) -> str:
    if weights == "uniform":
        pred = "avg(value)"
    else:
        pred = ("CASE WHEN count(*) FILTER (WHERE d = 0) > 0 THEN avg(value) FILTER (WHERE d = 0) "
                "ELSE sum(value / d) / sum(1.0 / d) END")
    return f"""
WITH {facts},
near AS (SELECT item, fact, value, least(1.0, greatest(0.0, 1.0 - s)) AS d FROM p
         QUALIFY row_number() OVER (PARTITION BY item, fact ORDER BY s DESC, donor) <= {k}),
pred AS (SELECT item, fact, {pred} AS imputed FROM near GROUP BY item, fact)
SELECT f.item AS vec_id, f.fact, round(coalesce(f.value, pred.imputed), 6) AS value,
       (f.value IS NULL AND pred.imputed IS NOT NULL) AS imputed
FROM f LEFT JOIN pred ON f.item = pred.item AND f.fact = pred.fact
"""


ORACLES = {
    "fact_transfer": f"""
WITH e AS (SELECT label AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
facts AS (SELECT vec_id AS item, CASE WHEN embedding[2] > 0 THEN CAST(embedding[1] AS DOUBLE) END AS f0,
                 CASE WHEN embedding[4] > 0 THEN CAST(embedding[3] AS DOUBLE) END AS f1 FROM embeddings),
p AS (
  SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
              ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM e a JOIN e b ON a.dataset <> b.dataset
),
top AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, match) <= {TRANSFER_TOP_N}),
j AS (SELECT top.item, CASE WHEN top.target IN ({", ".join(map(str, LOW_PRIORITY))}) THEN 1 ELSE 2 END AS r,
             facts.f0, facts.f1, top.s FROM top LEFT JOIN facts ON top.match = facts.item)
SELECT item AS vec_id,
  round(coalesce(avg(f0) FILTER (WHERE r = 2), avg(f0) FILTER (WHERE r = 1)), 6) AS f0,
  round(coalesce(avg(f1) FILTER (WHERE r = 2), avg(f1) FILTER (WHERE r = 1)), 6) AS f1,
  round(coalesce(avg(s) FILTER (WHERE r = 2), avg(s) FILTER (WHERE r = 1)), 6) AS matched_score
FROM j GROUP BY item
""",
    "fact_transfer_long": f"""
WITH e AS (SELECT label AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
facts AS (
  SELECT vec_id AS item, 'f0' AS fact, CASE WHEN embedding[2] > 0 THEN CAST(embedding[1] AS DOUBLE) END AS value FROM embeddings
  UNION ALL
  SELECT vec_id, 'f1', CASE WHEN embedding[4] > 0 THEN CAST(embedding[3] AS DOUBLE) END FROM embeddings),
p AS (
  SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
              ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM e a JOIN e b ON a.dataset <> b.dataset
),
top AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, match) <= {TRANSFER_TOP_N}),
per AS (
  SELECT top.item, facts.fact, CASE WHEN top.target IN ({", ".join(map(str, LOW_PRIORITY))}) THEN 1 ELSE 2 END AS r,
         avg(facts.value) AS v
  FROM top JOIN facts ON top.match = facts.item WHERE facts.value IS NOT NULL
  GROUP BY ALL)
SELECT item AS vec_id, fact, round(arg_max(v, r), 6) AS value FROM per GROUP BY item, fact
""",
    "impute_k1": _impute_sql(1, "distance"),
    "impute_k3": _impute_sql(3, "distance"),
    "impute_k3_uniform": _impute_sql(3, "uniform"),
    "impute_neighbours": _impute_sql(3, "uniform", _LINE_FACTS_SQL),
    "impute_lines": _impute_sql(3, "distance", _LINE_FACTS_SQL),
}

ORACLES["fact_transfer_bucketed"] = ORACLES["fact_transfer"]

QUERIES = {
    "fact_transfer_bucketed": fact_transfer_bucketed,
    "fact_transfer": fact_transfer,
    "fact_transfer_long": fact_transfer_long,
    "impute_k1": impute_k1,
    "impute_k3": impute_k3,
    "impute_k3_uniform": impute_k3_uniform,
    "impute_neighbours": impute_neighbours,
    "impute_lines": impute_lines,
}
