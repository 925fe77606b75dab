"""Driver queries over the ``embeddings`` table: dataset = ``label``, item = ``vec_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import best_match, choose_source, cross_dataset_top_n
from ..operators.similarity import as_items, top_matches, top_matches_with_range
from ..session import read_table

# one source, one target: all rows of labels 0-4 matched against all rows of labels 5-9
ALIGN_SPLIT = 5
# SIM8 rule: a source is relevant at cosine >= 0.3; ties prefer the smaller label
BEST_SOURCE_THRESHOLD = 0.3


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_items(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")


def cross_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross_dataset_top_n(_items(spark, sf_dir), 3)
    return out.select("dataset", "item", "target", "match",
                      F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("match_rank"))


def cross_top3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``cross_top3`` with cells of at most about 200 rows a side."""
    out = cross_dataset_top_n(_items(spark, sf_dir), 3, cell_rows=200)
    return out.select("dataset", "item", "target", "match",
                      F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("match_rank"))


def _tied_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with planted cases: every 5th occurs under a second key,
    every 17th is zero, every 23rd row is repeated, every 29th has no label."""
    emb = read_table(spark, sf_dir, "embeddings")
    zero = F.transform("embedding", lambda x: (x * F.lit(0.0)).cast("float"))
    emb = emb.select(F.when(F.col("vec_id") % 29 != 0, F.col("label")).alias("label"), "vec_id",
                     F.when(F.col("vec_id") % 17 == 0, zero).otherwise(F.col("embedding")).alias("embedding"))
    copies = F.filter(F.array(F.lit(0), F.when(F.col("vec_id") % 5 == 0, 1_000_000), F.when(F.col("vec_id") % 23 == 0, 0)), lambda x: x.isNotNull())
    emb = emb.withColumn("_add", F.explode(copies)).withColumn("vec_id", F.col("vec_id") + F.col("_add"))
    return as_items(emb.withColumn("label", F.coalesce("label", F.lit(-1))), "label", "vec_id")


def cross_top3_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM5 + SIM6 where vectors are equal, zero or repeated under one key."""
    out = cross_dataset_top_n(_tied_items(spark, sf_dir), 3, cell_rows=300)
    return out.select("dataset", "item", "target", "match",
                      F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("match_rank"))


def space_rank_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM7 where some items have no name in the shared space: those of one
    dataset and target rank together like any other name."""
    items = _items(spark, sf_dir)
    names = items.filter(F.col("item") % 3 != 0).select("dataset", "item", (F.col("item") % 7).alias("space_name"))
    out = cross_dataset_top_n(items, 2, rank_by="space_name", space_name=names)
    return out.select("dataset", "item", "target", "match", "space_name", F.round("score", 6).alias("score"),
                      F.col("rank").cast("int").alias("match_rank"))


def align_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    src = as_items(emb.filter(F.col("label") < ALIGN_SPLIT), F.lit("source"), "vec_id")
    dst = as_items(emb.filter(F.col("label") >= ALIGN_SPLIT), F.lit("target"), "vec_id")
    out = best_match(src, dst)
    return out.select(F.col("item").alias("vec_id"), F.col("match").alias("match_vec_id"),
                      F.round("score", 6).alias("similarity_score"))


def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    best = top_matches(items, None, k=1, per_target=True)
    best = best.filter(F.col("target") != F.col("dataset"))
    labels = list(range(10))
    out = choose_source(best, threshold=BEST_SOURCE_THRESHOLD, priority=labels, items=items)
    return out.select(F.col("item").alias("vec_id"), "database_choice",
                      F.col("chosen_match").alias("chosen_vec_id"),
                      F.round("chosen_score", 6).alias("chosen_score"))


SPACE_DATASET = 0


def rank_by_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM7 with the reference's grouping: matches are ranked per (dataset,
    target, name of the item in the shared space).  Label 0 plays the space
    dataset: its items are their own space name, every other item's space
    name is its best match among label 0 (PRJ7 + SIM4)."""
    items = _items(spark, sf_dir)
    space = items.filter(F.col("dataset") == SPACE_DATASET)
    others = items.filter(F.col("dataset") != SPACE_DATASET)
    named_others = best_match(others, space).select("dataset", "item", F.col("match").alias("space_name"))
    names = space.select("dataset", "item", F.col("item").alias("space_name")).unionByName(named_others)
    out = cross_dataset_top_n(items, 3, rank_by="space_name", space_name=names)
    return out.select("dataset", "item", "target", "match", "space_name", F.round("score", 6).alias("score"),
                      F.col("rank").cast("int").alias("match_rank"))


def distance_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ17 + AGG6: each item's 3 nearest items as distances
    ``clip(1 - s, 0, 1) / max distance over all pairs``."""
    items = _items(spark, sf_dir)
    # one pass gives the 3 nearest and the lowest score over all pairs (a scalar)
    near, lowest, _ = top_matches_with_range(items, None, k=3, per_target=False)
    max_d = min(1.0, max(0.0, 1.0 - lowest)) if lowest is not None else None
    dist = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - F.col("score")))
    return near.select(F.col("item").alias("vec_id"), F.col("match").alias("match_vec_id"),
                       F.round(F.try_divide(dist, F.lit(max_d).cast("double")), 6).alias("distance"),
                       F.col("rank").cast("int").alias("match_rank"))


_TIES_SQL = """
WITH base AS (SELECT coalesce(CASE WHEN vec_id % 29 <> 0 THEN label END, -1) AS dataset, vec_id AS item,
                     CASE WHEN vec_id % 17 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS DOUBLE)) ELSE CAST(embedding AS DOUBLE[]) END AS v
              FROM embeddings),
e AS (SELECT dataset, item, v FROM base
      UNION ALL SELECT dataset, item + 1000000, v FROM base WHERE item % 5 = 0
      UNION ALL SELECT dataset, item, v FROM base WHERE item % 23 = 0),
p AS (
  SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
              ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM e a JOIN e b ON NOT (a.dataset = b.dataset AND a.item = b.item)
)
SELECT dataset, item, target, match, round(s, 6) AS score,
       CAST(row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, match) AS INTEGER) AS match_rank
FROM p
QUALIFY row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, match) <= 3
"""

ORACLES = {
    "cross_top3": """
WITH e AS (SELECT label AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (
  SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
              ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM e a JOIN e b ON NOT (a.dataset = b.dataset AND a.item = b.item)
)
SELECT dataset, item, target, match, round(s, 6) AS score,
       CAST(row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, match) AS INTEGER) AS match_rank
FROM p
QUALIFY row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, match) <= 3
""",
    "align_top1": f"""
WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label < {ALIGN_SPLIT}),
b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label >= {ALIGN_SPLIT}),
p AS (
  SELECT a.vec_id, b.vec_id AS match_vec_id,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
              ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM a CROSS JOIN b
)
SELECT vec_id, match_vec_id, round(s, 6) AS similarity_score
FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, match_vec_id) = 1
""",
    "best_source": f"""
WITH e AS (SELECT label AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (
  SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
              ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM e a JOIN e b ON a.dataset <> b.dataset
),
best AS (
  SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, match) = 1
),
ok AS (
  SELECT * FROM best WHERE s >= {BEST_SOURCE_THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY dataset, item ORDER BY s DESC, target) = 1
)
SELECT e.item AS vec_id, coalesce(CAST(ok.target AS VARCHAR), 'no_relevant_match') AS database_choice,
       ok.match AS chosen_vec_id, round(ok.s, 6) AS chosen_score
FROM e LEFT JOIN ok ON e.dataset = ok.dataset AND e.item = ok.item
""",
    "rank_by_space": f"""
WITH e AS (SELECT label AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (
  SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
              ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM e a JOIN e b ON NOT (a.dataset = b.dataset AND a.item = b.item)
),
names AS (
  SELECT dataset, item, item AS space_name FROM e WHERE dataset = {SPACE_DATASET}
  UNION ALL
  SELECT dataset, item, match FROM p WHERE dataset <> {SPACE_DATASET} AND target = {SPACE_DATASET}
  QUALIFY row_number() OVER (PARTITION BY dataset, item ORDER BY s DESC, match) = 1
),
top AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, match) <= 3)
SELECT top.dataset, top.item, top.target, top.match, names.space_name, round(top.s, 6) AS score,
       CAST(row_number() OVER (PARTITION BY top.dataset, top.target, names.space_name
                               ORDER BY top.s DESC, top.item, top.match) AS INTEGER) AS match_rank
FROM top JOIN names ON top.dataset = names.dataset AND top.item = names.item
""",
    "distance_scale": """
WITH e AS (SELECT label AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (
  SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
              ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM e a CROSS JOIN e b
),
mx AS (SELECT least(1.0, greatest(0.0, 1.0 - min(s))) AS max_d FROM p),
near AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, item ORDER BY s DESC, target, match) AS rn
  FROM p WHERE NOT (dataset = target AND item = match)
  QUALIFY rn <= 3
)
SELECT item AS vec_id, match AS match_vec_id,
       round(least(1.0, greatest(0.0, 1.0 - s)) / max_d, 6) AS distance,
       CAST(rn AS INTEGER) AS match_rank
FROM near, mx
""",
}

ORACLES["cross_top3_grid"] = ORACLES["cross_top3"]
ORACLES["cross_top3_ties"] = _TIES_SQL
ORACLES["space_rank_nulls"] = """
WITH e AS (SELECT label AS dataset, vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (
  SELECT a.dataset, a.item, b.dataset AS target, b.item AS match,
         CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
              ELSE list_cosine_similarity(a.v, b.v) END AS s
  FROM e a JOIN e b ON NOT (a.dataset = b.dataset AND a.item = b.item)
),
top AS (SELECT *, CASE WHEN item % 3 <> 0 THEN item % 7 END AS space_name FROM p
        QUALIFY row_number() OVER (PARTITION BY dataset, item, target ORDER BY s DESC, match) <= 2)
SELECT dataset, item, target, match, space_name, round(s, 6) AS score,
       CAST(row_number() OVER (PARTITION BY dataset, target, space_name ORDER BY s DESC, item, match) AS INTEGER) AS match_rank
FROM top
"""

QUERIES = {
    "cross_top3": cross_top3,
    "cross_top3_grid": cross_top3_grid,
    "cross_top3_ties": cross_top3_ties,
    "space_rank_nulls": space_rank_nulls,
    "align_top1": align_top1,
    "best_source": best_source,
    "distance_scale": distance_scale,
    "rank_by_space": rank_by_space,
}
