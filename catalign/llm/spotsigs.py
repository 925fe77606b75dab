"""SpotSigs document fingerprints.

A signature is the chain of content words that follows a common word (or the
start of the text).  A text's fingerprint is its sorted set of signature
hashes; likeness is the Jaccard measure of two sets.

``near_copies`` finds all likenesses of a threshold or more.  Equal sets are one
class.  Classes are partitioned by set length, so that sets whose lengths
allow the threshold are in one partition or in two adjacent ones.  Inside them
classes meet by their rarest signatures alone, of which two sets that reach
the threshold must share one; a meeting counts only if the signatures that
remain after it can still reach the threshold; then the exact likeness decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

CHAIN = 2
THRESHOLD = 0.8
#: Common words of the four languages that anchor a signature.
ANCHORS = tuple("""
a an the of and to in is was for on that with by at from as are be it this or
der die das und den von mit des auf für ist im dem nicht ein eine zu sich
le la les de du des et en un une dans que qui par pour sur est au pas
el los las del y que en un una por con se no su es al
""".split())


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def content_words(w: Column) -> Column:
    """Words that are no anchors, marked by ``^`` where they follow one."""
    anchors = list(dict.fromkeys(ANCHORS))
    marked = F.zip_with(w, F.concat(F.array(F.lit(anchors[0])), w),
                        lambda x, before: F.when(x.isNotNull() & ~x.isin(anchors), F.concat(F.when(before.isin(anchors), "^").otherwise(""), x)))
    return F.filter(marked, lambda x: x.isNotNull())


def chains(content: Column, text: Column) -> Column:
    """Sorted distinct signature hashes; a non-empty text without any chain
    has the hash of itself."""
    n = F.size(content)
    nxt = content
    tail = None
    for i in range(2, CHAIN + 1):
        later = F.transform(F.slice(content, i, n), lambda x: F.ltrim(x, F.lit("^")))
        tail = later if tail is None else F.zip_with(tail, later, lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.zip_with(nxt, tail, lambda a, b: F.when(a.startswith("^"), F.xxhash64(F.concat_ws(" ", a, b))))
    found = F.array_sort(F.array_distinct(F.filter(pairs, lambda x: x.isNotNull())))
    return F.when(F.size(found) > 0, found).when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))


def with_signatures(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the signature set of ``text_col`` (null as empty) in ``out``."""
    df = df.withColumn("_words", words(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn("_content", content_words(F.col("_words")))
    return df.withColumn(out, chains(F.col("_content"), F.coalesce(F.col(text_col), F.lit("")))).drop("_words", "_content")


def as_text(sigs: Column) -> Column:
    """The fingerprint string: sixteen hex digits per signature."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of two signature sets, 0 to 1; 1 for two empty sets."""
    na, nb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return (F.when((na == 0) & (nb == 0), 1.0)
            .otherwise(both / (na + nb - both)))


def neighbours(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, before_id, before_n): for every distinct id, the id that it
    follows in descending order (the first follows the last) and that one's
    length.  Ids are range-partitioned and numbered by partition; only one
    row per partition is ordered as a whole."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n"))
    # the sort keeps ranges of the sampled order; a written table fixes the partition of each row
    part = scratch.put(ids.repartitionByRange(F.desc("doc_id")).withColumn("pid", F.spark_partition_id()), "ordered")
    within = Window.partitionBy("pid").orderBy(F.desc("doc_id"))
    ends = part.groupBy("pid").agg(F.min("doc_id").alias("end_id"), F.min_by("n", "doc_id").alias("end_n"))
    order = Window.orderBy("pid")  # one row per partition
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("pid", *[F.coalesce(F.lag(c).over(order), F.last(c).over(whole)).alias(f"_{c}") for c in ("end_id", "end_n")])
    inner = part.select("pid", "doc_id", F.lag("doc_id").over(within).alias("before_id"), F.lag("n").over(within).alias("before_n"))
    out = inner.join(ends, "pid").select("doc_id", F.coalesce("before_id", "_end_id").alias("before_id"), F.coalesce("before_n", "_end_n").alias("before_n"))
    return scratch.put(out, "neighbours")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, n_chars, text, edited text, the signature sets
    ``sigs`` and ``edited_sigs``, and the likeness of ``sigs`` to the edited
    text's (``near_edited``) and to the next document's (``near_next``).

    The edited text ends in the beginning of the next document, by descending
    id, in place of its own last third; after the last comes the first.
    Null texts count as empty.  Rows that repeat an id share their place; the
    shortest text (of equal lengths, that of the smallest hash) stands for
    the id towards the row before it.  A row without an id has no place in
    the order and is its own next document.

    The texts are shuffled once, by id; of a next document only the part
    that is needed and its signatures travel."""
    scratch = Scratch(docs.sparkSession, "spots")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a plain column where it will do: an alias would keep the two uses below from sharing their exchange
    plain = id_col == "doc_id" and dict(docs.dtypes)[id_col] == "bigint"
    rows = docs.select(F.col("doc_id") if plain else F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    known = rows.where("doc_id is not null")
    order = neighbours(known.withColumn("n", F.length("text")), scratch)
    # both uses of this join read one exchange: they ask it for the same columns
    placed = with_signatures(known.join(order, "doc_id"), "text", "sigs")
    head = F.substring(F.col("text"), F.lit(1), F.floor(F.col("before_n") / 3).cast("int"))
    heads = placed.select(F.col("before_id").alias("to_id"), F.struct(F.length("text"), F.xxhash64("text")).alias("rank"), F.struct(head.alias("head"), "sigs").alias("next"))
    heads = heads.groupBy("to_id").agg(F.min_by("next", "rank").alias("next"))
    out = placed.join(heads, F.col("doc_id") == F.col("to_id")).select("doc_id", "text", "sigs", F.col("next.head").alias("head"), F.col("next.sigs").alias("next_sigs"))
    lost = with_signatures(rows.where("doc_id is null"), "text", "sigs")
    out = out.unionByName(lost.select("doc_id", "text", "sigs", F.col("text").alias("head"), F.col("sigs").alias("next_sigs")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("head"), F.lit(1), third))
    out = with_signatures(out.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "sigs", "next_sigs"), "edited", "edited_sigs")
    return out.withColumn("near_edited", likeness(F.col("sigs"), F.col("edited_sigs"))).withColumn("near_next", likeness(F.col("sigs"), F.col("next_sigs")))


def classes_of(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: (doc_id, class_id) of every row with an id and
    a signature, and (class_id, n, sigs) of every distinct signature set.  The
    id of a class is the smallest doc_id in it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sets = with_signatures(rows, "text", "sigs").where(F.size("sigs") > 0)
    # two unlike hashes and the length stand for a set
    key = [F.xxhash64("sigs").alias("k1"), F.hash("sigs").alias("k2"), F.size("sigs").alias("n")]
    sets = scratch.put(sets.select("doc_id", *key, "sigs"), "sets")
    same = ["k1", "k2", "n"]
    first = scratch.put(sets.groupBy(*same).agg(F.min("doc_id").alias("class_id")), "first")
    members = sets.select("doc_id", *same).join(first, same).select("doc_id", "class_id")
    classes = sets.join(first.select(F.col("class_id").alias("doc_id"), *same), ["doc_id", *same]).dropDuplicates(["doc_id", *same])
    return members.distinct(), scratch.put(classes.select(F.col("doc_id").alias("class_id"), "n", "sigs"), "classes")


def similar_classes(classes: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness), a < b, of all pairs of ``classes`` (class_id, n,
    sigs) whose likeness is ``threshold`` or more (above 0)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold has to be above 0 and at most 1")
    t = F.lit(threshold)
    each = classes.select("class_id", "n", F.explode("sigs").alias("sig"))
    rare = scratch.put(each.groupBy("sig").agg(F.count("*").alias("df")), "df")
    # of n signatures the rarest n - ceil(t * n) + 1 hold one of any set that is alike enough
    eps = 1e-9
    ranked = each.join(rare, "sig").withColumn("pos", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig")))  # one set
    head = ranked.where(F.col("pos") <= F.col("n") - F.ceil(t * F.col("n") - eps) + 1)
    # lengths n and m allow the threshold only if t <= n / m: their partitions are equal or adjacent
    part = F.floor(F.ln(F.col("n").cast("double")) / math.log(1 / threshold) + eps) if threshold < 1 else F.col("n").cast("long")
    head = scratch.put(head.select("sig", "class_id", "n", "pos", part.alias("part")), "heads")
    low = head.select("sig", "part", F.col("class_id").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xp"))
    reach = F.array("part", F.col("part") - 1) if threshold < 1 else F.array("part")
    high = head.select("sig", F.explode(reach).alias("part"), F.col("class_id").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("yp"))
    shorter = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("x") < F.col("y")))
    need = F.ceil((F.col("xn") + F.col("yn")) * t / (1 + t) - eps)
    # at most the earlier places of the nearer one, this signature and what remains after it are common
    most = F.least("xp", "yp") + F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp"))
    meet = low.join(high, ["sig", "part"]).where(shorter & (F.col("xn") >= t * F.col("yn") - eps) & (most >= need))
    pairs = scratch.put(meet.groupBy("x", "y").agg(F.lit(1).alias("one")).drop("one"), "candidates")
    sets = classes.select("class_id", "sigs")
    both = pairs.join(sets.withColumnsRenamed({"class_id": "x", "sigs": "xs"}), "x").join(sets.withColumnsRenamed({"class_id": "y", "sigs": "ys"}), "y")
    out = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), likeness(F.col("xs"), F.col("ys")).alias("likeness"))
    return out.where(F.col("likeness") >= t - eps)


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)`` of ``docs``: the class of every document, and all
    pairs of classes whose likeness is ``threshold`` or more.

    Documents of one class have equal signature sets and are not paired.  Null
    and empty texts have no signature and no class, nor have rows without an
    id; rows that repeat an id may be in several classes; an empty table gives
    two empty ones.  A class is joined by its rarest signatures, so a common
    one brings sets together only where they have nothing rarer."""
    scratch = Scratch(docs.sparkSession, "spots-near")
    members, classes = classes_of(docs, scratch, id_col, text_col)
    return members, similar_classes(classes, scratch, threshold)
