"""Source mixing by iterative proportional fitting.

Token counts per (source, language, topic) cell are raked until the totals of
each dimension meet their target shares; a document is then taken in
proportion to its cell's factor.  With a ``scale`` the expected number of
copies is scale times the factor, so no rare cell sets the scale for the
rest; what exceeds 1 is met by whole copies.  Without one the largest factor
gets probability 1, and the sample has the target mix without copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

#: A category's target is its token share to this power, renormalised: large
#: categories shrink, small ones grow.  Categories below FLOOR keep their share.
POWER = {"source": 0.8, "lang": 0.9, "topic": 0.9}
FLOOR = 0.001
#: Every category's total is met within this share of it.
TOLERANCE = 1e-4
#: Rounds in which the largest miss has to fall by a hundredth; targets that
#: it does not fall for contradict each other on the cells there are.
PATIENCE = 20


def n_tokens(text: Column) -> Column:
    """Words divided by white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def register(text: Column) -> Column:
    """A coarse topic from the make-up of the whole text: the share of
    digits, of symbols and of line ends."""
    size = F.length(text)
    share = lambda chars: F.regexp_count(text, F.lit(chars)) / size
    return (F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
            .when(share("[0-9]") >= 0.05, "numbers")
            .when(share(r"[|#$%&*<>{}\[\]=+_\\/~^@]") >= 0.03, "symbols")
            .when(share("\n") >= 0.02, "lists")
            .when(size >= 8000, "long prose").otherwise("prose"))


def category(col: Column) -> Column:
    """A category's key; null is a category of its own."""
    return F.coalesce(F.concat(F.lit("v:"), col.cast("string")), F.lit("n"))


def power_targets(cells: DataFrame, dim: str, power: float, floor: float = FLOOR) -> DataFrame:
    """(dim, share): smoothed target shares over the categories present; they
    need not sum to 1."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    share = F.sum("tokens") / F.lit(float(total))
    return cells.groupBy(dim).agg(F.when(share >= floor, F.pow(share, F.lit(power))).otherwise(share).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, tolerance: float = TOLERANCE, strict: bool = True) -> DataFrame:
    """``cells`` (one row per cell with ``tokens``) with a column ``weight``:
    raked tokens, whose shares by each dimension meet ``targets`` (dimension
    -> (dimension, share); shares are normalised over the categories present,
    cells of a category without a target leave).  Every step is an
    aggregation by one dimension and a join back, and rounds go on until the
    targets are met within ``tolerance``.  Targets that cannot be met
    together are an error, unless not ``strict``: then the weights of the
    last round are a compromise that meets the last dimension."""
    cur = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, target in targets.items():
        cur = cur.join(target.withColumnRenamed("share", f"_t_{d}"), d)
    cur = scratch.put(cur.withColumn("_off", F.lit(1.0)), "rake")
    total = cur.agg(F.sum("weight")).first()[0] or 1.0
    # target tokens in place of shares: one value per category, summed over the categories present
    sums = [cur.groupBy(d).agg(F.max(f"_t_{d}").alias("t")).agg(F.sum("t")).first()[0] or 1.0 for d in targets]
    best, stuck = float("inf"), 0
    while True:
        nxt = cur.withColumn("_off", F.lit(0.0))
        for d, of in zip(targets, sums):
            want = F.max(f"_t_{d}") / F.lit(of) * F.lit(total)
            factor = nxt.groupBy(d).agg(F.when(F.sum("weight") > 0, want / F.sum("weight")).otherwise(1.0).alias("_f"))
            nxt = nxt.join(factor, d).withColumn("_off", F.greatest("_off", F.abs(F.col("_f") - 1))).withColumn("weight", F.col("weight") * F.col("_f")).drop("_f")
        nxt = scratch.put(nxt, "rake")
        scratch.drop(cur)
        cur = nxt
        off = cur.agg(F.max("_off")).first()[0]
        if off is None or off < tolerance:
            break
        best, stuck = (off, 0) if off < 0.99 * best else (best, stuck + 1)
        if stuck >= PATIENCE:
            if strict:
                raise ValueError(f"the target shares cannot be met together: a category stays off by {off:.3g} of its total")
            break
    return cur.drop("_off", *[f"_t_{d}" for d in targets])


def mix(docs: DataFrame, dims: dict[str, Column] | None = None, text_col: str = "text", id_col: str = "doc_id",
        targets: dict[str, DataFrame] | None = None, seed: int = 7, scale: float | None = None) -> DataFrame:
    """``docs`` with the columns ``mix_tokens``, ``mix_weight`` (factor of the
    document's cell), ``mix_probability`` (of at least one copy),
    ``mix_sampled`` and ``mix_copies``.

    With ``scale`` the expected copies are scale times the factor (1 expects
    as many tokens as the data has): the whole part always, one more by the
    draw.  Without, the largest factor gets probability 1.

    ``dims`` maps dimension names to columns (source, lang and the text's
    register by default); ``targets`` gives target shares by dimension, and a
    dimension without any gets smoothed shares (``POWER``).  Given targets
    that cannot be met together are an error; smoothed ones then meet the
    last dimension.  Every row
    returns.  A null category is one of its own; documents without tokens
    have no weight to mix and are always sampled; rows that repeat id and
    text share one draw, which depends on id, text and ``seed`` only.  Input
    columns of the names added are replaced."""
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop("mix_tokens", "mix_weight", "mix_probability", "mix_sampled", "mix_copies")
    text = F.col(text_col).cast("string")
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": register(text)}
    keyed = docs.select("*", n_tokens(text).alias("mix_tokens"), *[category(c).alias(f"_m_{d}") for d, c in dims.items()])
    names = [f"_m_{d}" for d in dims]
    cells = scratch.put(keyed.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")).where("tokens > 0"), "cells")
    want = {}
    for d in dims:
        given = (targets or {}).get(d)
        want[f"_m_{d}"] = (given.select(category(F.col(d)).alias(f"_m_{d}"), "share") if given is not None
                           else power_targets(cells, f"_m_{d}", POWER.get(d, 1.0)))
    raked = rake(cells, want, scratch, strict=bool(targets)).withColumn("mix_weight", F.col("weight") / F.col("tokens"))
    one = 1.0 / scale if scale else raked.agg(F.max("mix_weight")).first()[0] or 1.0  # the factor of one copy
    factors = scratch.put(raked.select(*names, "mix_weight", (F.col("mix_weight") / F.lit(one)).alias("_copies")), "factors")
    out = keyed.join(factors, names, "left")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(1 << 40)) / F.lit(float(1 << 40))
    weightless = F.col("mix_tokens") == 0
    copies = F.when(weightless, 1.0).otherwise(F.coalesce("_copies", F.lit(0.0)))
    whole = F.floor(copies)
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_tokens",
                     F.when(weightless, 1.0).otherwise(F.coalesce("mix_weight", F.lit(0.0))).alias("mix_weight"),
                     F.least(copies, F.lit(1.0)).alias("mix_probability"),
                     (whole + (draw < copies - whole).cast("long")).alias("mix_copies"))
    return out.withColumn("mix_sampled", F.col("mix_copies") > 0)
