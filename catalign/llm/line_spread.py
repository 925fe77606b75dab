"""Cross-site boilerplate lines by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it occurs on; sketches
merge by aggregation, so a line on every page costs one sketch per task.
Lines whose estimate lies near the threshold are counted exactly.  A line on
``min_sites`` or more sites is boilerplate: its first occurrence (smallest
doc_id, then place) stays, all others are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: Characters (trimmed) from which a line counts: every line that is not blank.
MIN_CHARS = 1
#: Sketch size (2^12 registers: 1.6 % standard error) and the band around
#: the threshold, 15 standard errors wide, that is counted exactly.
LG_K = 12
BAND = 0.25


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, site, pos, h) of every line of ``min_chars`` or more."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"),
                       F.posexplode(split_lines(F.col(text_col).cast("string"))).alias("pos", "line"))
    return rows.where(F.length(F.btrim("line", F.lit(" \t\r"))) >= min_chars).select("id", "site", "pos", line_hash(F.col("line")).alias("h"))


def boilerplate(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (h) of the lines on ``min_sites`` or more distinct sites."""
    seen = lines.groupBy("h").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    # a line with fewer occurrences than min_sites cannot be on so many sites
    guess = scratch.put(seen.where(F.col("n") >= min_sites).select("h", F.hll_sketch_estimate("sketch").alias("sites"))
                        .where(F.col("sites") >= min_sites * (1 - BAND)), "spread")
    near = guess.where(F.col("sites") <= min_sites * (1 + BAND)).select("h")
    exact = (lines.where("site is not null").join(near, "h", "left_semi").select("h", "site").distinct()
             .groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h"))
    far = guess.where(F.col("sites") > min_sites * (1 + BAND)).select("h")
    return scratch.put(far.unionByName(exact), "boilerplate")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES, chars_col: str | None = "n_chars", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, the column
    ``chars_col`` (if present) set to the new length, and two more columns:
    ``n_lines`` (before) and ``n_removed``.  Blank lines all stay, as do
    those shorter than a larger ``min_chars`` (trimmed).

    Every row stays.  A null text stays null with no lines; a null site is no
    site; rows that repeat an id are treated alike; rows with a null id share
    one id, before all others in order; an empty table gives an empty one;
    input columns of the names added are replaced."""
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_removed")
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    found = boilerplate(lines, scratch, min_sites)
    hits = scratch.put(lines.join(found, "h", "left_semi").select("id", "pos", "h"), "hits")
    # a table of its own, so that Spark can split the join's hot lines
    first = scratch.put(hits.groupBy("h").agg(F.min(F.struct("id", "pos")).alias("first")), "first")
    others = hits.join(first, "h").where(~F.struct("id", "pos").eqNullSafe(F.col("first")))
    # one mark per removed (line, place); rows that share an id share the marks
    marks = scratch.put(others.groupBy(F.col("id").alias("_line_id")).agg(F.collect_set(F.xxhash64("h", "pos")).alias("_marks")), "marks")
    # one plan at every size: texts are shuffled once, by id
    joined = docs.join(marks.hint("merge"), docs[id_col].eqNullSafe(marks["_line_id"]), "left")
    all_lines = split_lines(F.col(text_col).cast("string"))
    kept = F.filter(all_lines, lambda line, i: ~F.array_contains(F.col("_marks"), F.xxhash64(line_hash(line), i)))
    out = joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(all_lines)).cast("long"))
    out = out.withColumn("_kept", F.when(F.col("_marks").isNotNull(), kept))
    out = out.withColumn("n_removed", F.when(F.col("_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("n_removed") > 0, F.array_join("_kept", "\n")).otherwise(F.col(text_col)))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col("n_removed") > 0, F.length(text_col).cast("long")).otherwise(F.col(chars_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_removed")
