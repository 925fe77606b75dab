"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import importance, line_spread, merkle, mix_ipf, pack_bestfit, quality_rules, secret_scan, shard_table, simhash_cover, spotsigs, topk_segments, toxicity, url_graph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark, sf_dir):
    return topk_segments.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_url_filter(spark, sf_dir):
    return url_graph.judge(_table(spark, sf_dir, "pages"))


def op3_simhash_dedup(spark, sf_dir):
    out = simhash_cover.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_source_mix(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("topic", mix_ipf.register(F.col("text")))
    out = mix_ipf.mix(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("topic")}, scale=1.0)
    return out.select("doc_id", "source", "lang", "topic", F.col("mix_tokens").alias("n_tokens"),
                      F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_sampled").alias("sampled"), F.col("mix_copies").alias("copies"))


def op5_shard_table(spark, sf_dir):
    ids = _table(spark, sf_dir, "documents").select("doc_id")
    return shard_table.place(ids, F.col("doc_id"))


def op6_secret_scan(spark, sf_dir):
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"), secret_scan.joined("found").alias("spans"))


def op7_line_dedup(spark, sf_dir):
    out = line_spread.remove_boilerplate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op8_spotsigs(spark, sf_dir):
    out = spotsigs.fingerprint_pairs(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.as_text(F.col("sigs")).alias("fingerprint"),
                      spotsigs.as_text(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next")


def op9_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_rows(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_best_fit(spark, sf_dir):
    return pack_bestfit.pack_documents(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.score_rows(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op12_importance(spark, sf_dir):
    out = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle(spark, sf_dir):
    out = merkle.manifest(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_url_filter, op3_simhash_dedup, op4_source_mix, op5_shard_table, op6_secret_scan, op7_line_dedup, op8_spotsigs, op9_toxicity, op10_best_fit,
                                    op11_quality_rules, op12_importance, op13_merkle)}

#: CRC-32 of a string's UTF-8 bytes in DuckDB: ``{tab}`` is the list of its 256
#: table entries (made by ``_CRC_TABLE``), ``{s}`` the string.
_CRC = """xor(4294967295, list_reduce(list_transform(range(CAST(length(hex(encode({s}))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({s})), 2 * i + 1, 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, {tab}[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)))"""
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b) ORDER BY b) AS tab FROM range(256) t(b)
)"""

ORACLES = {
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0 GROUP BY ALL
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_shard_table": f"""
WITH RECURSIVE names AS (
  SELECT i AS shard, 'shard-' || i AS name FROM range({shard_table.SHARDS}) t(i)
), pref AS (
  SELECT shard, CAST(('0x' || substr(md5(name || ':first'), 1, 15)) AS BIGINT) % {shard_table.SLOTS} AS first,
         CAST(('0x' || substr(md5(name || ':step'), 1, 15)) AS BIGINT) % ({shard_table.SLOTS} - 1) + 1 AS step
  FROM names
), choice AS (
  SELECT shard, list(CAST((first + j * step) % {shard_table.SLOTS} AS INTEGER) ORDER BY j) AS slots
  FROM pref, range({shard_table.SLOTS}) r(j) GROUP BY shard
), fill(n, slot, taken) AS (
  SELECT 0, -1, bitstring('0', {shard_table.SLOTS})
  UNION ALL
  SELECT n + 1, s, set_bit(taken, s, 1) FROM (
    SELECT f.n, f.taken, list_filter(c.slots, lambda x: get_bit(f.taken, x) = 0)[1] AS s
    FROM fill f JOIN choice c ON c.shard = f.n % {shard_table.SHARDS} WHERE f.n < {shard_table.SLOTS})
), owner AS (
  SELECT slot, CAST((n - 1) % {shard_table.SHARDS} AS INTEGER) AS shard FROM fill WHERE n > 0
)
SELECT d.doc_id, o.slot, o.shard
FROM (SELECT doc_id, CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {shard_table.SLOTS} AS INTEGER) AS slot FROM documents) d
JOIN owner o USING (slot)""",
    "op7_line_dedup": f"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, n_chars, string_split(text, chr(10)) AS lines FROM documents
), occ AS (
  SELECT rid, doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM rows
), long AS (
  SELECT rid, doc_id, source, pos, trim(line, ' ' || chr(9) || chr(13)) AS k FROM occ WHERE length(trim(line, ' ' || chr(9) || chr(13))) >= {line_spread.MIN_CHARS}
), bad AS (
  SELECT k, min({{'doc_id': doc_id, 'pos': pos}}) AS first FROM long GROUP BY k HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}
), cut AS (
  SELECT rid, pos FROM long JOIN bad USING (k) WHERE {{'doc_id': doc_id, 'pos': pos}} IS DISTINCT FROM first
), kept AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM occ ANTI JOIN cut USING (rid, pos)
  WHERE rid IN (SELECT rid FROM cut) GROUP BY rid
), n_cut AS (SELECT rid, count(*) AS n FROM cut GROUP BY rid)
SELECT r.doc_id, CAST(coalesce(len(r.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN c.n IS NULL THEN r.n_chars ELSE length(coalesce(k.text, '')) END AS n_chars,
  CASE WHEN c.n IS NULL THEN sha256(r.text) ELSE sha256(coalesce(k.text, '')) END AS text_sha256
FROM rows r LEFT JOIN n_cut c USING (rid) LEFT JOIN kept k USING (rid)""",
    "op12_importance": f"""
WITH {_CRC_TABLE}, texts AS (
  SELECT row_number() OVER () AS rid, doc_id, true AS own, text FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, false, text FROM benchmark
), words AS (
  SELECT rid, doc_id, own, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) AS w FROM texts
), runs AS (
  SELECT rid, own, unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]),
                                      list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) AS f FROM words
), known AS (
  SELECT f, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM runs GROUP BY f
), hashed AS (
  SELECT f, s, t, {_CRC.format(s="f", tab="tab")} % {importance.BUCKETS} AS bucket FROM known, crc
), totals AS (
  SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS of_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS target_all FROM known
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(sum(t) AS DOUBLE) + 1) * (any_value(of_all) + {importance.BUCKETS}) / ((CAST(sum(s) AS DOUBLE) + 1) * (any_value(target_all) + {importance.BUCKETS})))) AS BIGINT) AS gain
  FROM hashed, totals GROUP BY bucket
), weight AS (
  SELECT rid, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM runs JOIN hashed USING (f) JOIN gain USING (bucket) WHERE own GROUP BY rid
), scored AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weight USING (rid) WHERE own
), ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {importance.MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {importance.SHARE[0]} * n // {importance.SHARE[1]} THEN rank END AS rank FROM scored LEFT JOIN ranked USING (rid)""",
    "op13_merkle": f"""
WITH RECURSIVE {_CRC_TABLE}, fields AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, n_chars, {", ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-') AS f_{c}" for c in ("doc_id", "source", "lang", "text"))}
  FROM documents
), leaf AS (
  SELECT rid, doc_id, lang, sha256(f_doc_id || f_source || f_lang || coalesce(CAST(length(CAST(n_chars AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR), '-') || f_text) AS leaf,
    CASE WHEN {_CRC.format(s="CAST(doc_id AS VARCHAR)", tab="tab")} % 7 = 0
      THEN sha256(f_doc_id || f_source || f_lang || coalesce(CAST(length(CAST(n_chars + 1 AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || f_text) END AS tampered
  FROM fields, crc
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf
), up(level, g, i, n, h) AS (
  SELECT 0, g, pos, n, leaf FROM placed
  UNION ALL
  SELECT level + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY level, g, i // 2, n
), top(level, i, n, h) AS (
  SELECT 0, g, count(*) OVER (), h FROM up WHERE n = 1
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2, n
), height AS (
  SELECT g, level AS height FROM up WHERE n = 1
), steps AS (
  SELECT p.rid, l.level, u.h AS beside, (p.pos >> l.level) % 2 AS side
  FROM placed p JOIN height USING (g) JOIN (SELECT DISTINCT level FROM up) l ON l.level < height LEFT JOIN up u ON u.g = p.g AND u.level = l.level AND u.i = xor(p.pos >> l.level, 1)
  UNION ALL
  SELECT p.rid, height + t.level, u.h, (p.g >> t.level) % 2
  FROM placed p JOIN height USING (g) JOIN (SELECT DISTINCT level FROM top WHERE n > 1) t ON true LEFT JOIN top u ON u.level = t.level AND u.i = xor(p.g >> t.level, 1)
), proof AS (
  SELECT rid, list({{'beside': coalesce(beside, ''), 'side': side}} ORDER BY level) AS steps FROM steps GROUP BY rid
), folded AS (
  SELECT p.rid, sha256(coalesce(list_aggregate(list_transform(steps, lambda s: s.beside), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(coalesce(list_transform(steps, lambda s: s.beside || '|' || CAST(s.side AS VARCHAR)), []),
                lambda node, s: sha256(CASE WHEN split_part(s, '|', 2) = '1' THEN split_part(s, '|', 1) || node ELSE node || split_part(s, '|', 1) END), coalesce(tampered, leaf)) AS folded_root
  FROM placed p LEFT JOIN proof USING (rid)
)
SELECT doc_id, leaf, u.h AS subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified
FROM placed p JOIN folded USING (rid) JOIN (SELECT g, h FROM up WHERE n = 1) u ON u.g = p.g, (SELECT h FROM top WHERE n = 1) r""",
}
