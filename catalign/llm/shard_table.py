"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table
(offset and step from a hash of its name).  Shards take turns claiming their
next free slot, so all get an equal number, and removing one shard moves few
other slots.  The table's size is a parameter; broadcast, it places a key by
one lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHARDS = 16
#: Prime, at least a hundred times the shards.
SLOTS = 2053


def _md5_number(text: Column) -> Column:
    """First 60 bits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def preferences(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(shard, first, step): a shard's j-th choice is (first + j * step) mod ``slots``."""
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("shard", "name"))
    return rows.select("shard", "name", (_md5_number(F.concat("name", F.lit(":first"))) % slots).alias("first"),
                       (_md5_number(F.concat("name", F.lit(":step"))) % (slots - 1) + 1).alias("step"))


def fill(choices: list[tuple[int, int]], slots: int = SLOTS) -> list[int]:
    """Owner of every slot: shards claim in turn, each its next free choice."""
    owner, nxt, left = [-1] * slots, [0] * len(choices), slots
    while left:
        for i, (first, step) in enumerate(choices):
            while owner[(first + nxt[i] * step) % slots] >= 0:
                nxt[i] += 1
            owner[(first + nxt[i] * step) % slots] = i
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): ``slots`` rows, whatever the data's size."""
    names = shard_names() if names is None else names
    if not 0 < len(names) <= slots:
        raise ValueError("between one shard and one per slot are needed")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the table size must be prime")
    choices = [(r["first"], r["step"]) for r in preferences(spark, names, slots).orderBy("shard").collect()]
    text = ",".join(map(str, fill(choices, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def place(df: DataFrame, key: Column, names: list[str] | None = None, slots: int = SLOTS, split: Column | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; a map-side join, no shuffle.

    The slot is a hash of the key's text (null counts as empty), so equal
    keys meet in one shard.  A hot key is split by ``split``, any column that
    divides its rows (a salt); rows of one key and split still meet.
    Input columns named ``slot`` or ``shard`` are replaced."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    if split is not None:
        text = F.concat(text, F.lit("\x1f"), F.coalesce(split.cast("string"), F.lit("")))
    table = lookup_table(df.sparkSession, names, slots)
    df = df.drop("slot", "shard")
    keyed = df.withColumn("slot", (_md5_number(text) % slots).cast("int"))
    return keyed.join(F.broadcast(table), "slot").select(*[keyed[c] for c in df.columns], keyed["slot"], table["shard"])


def hot_salt(df: DataFrame, key: str, row: Column, max_rows: int) -> DataFrame:
    """``df`` with ``salt``: 0 for keys of at most ``max_rows`` rows; the rows
    of a larger key are dealt by a hash of ``row`` over as many salts as it
    takes.  Counts are pre-aggregated; Spark broadcasts the hot keys if they
    are few and otherwise splits their join."""
    hot = df.groupBy(F.col(key).alias("_hot_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows)
    out = df.join(hot, df[key].eqNullSafe(hot["_hot_key"]), "left")
    salt = F.pmod(F.xxhash64(row), F.ceil(F.col("_n") / max_rows))
    return out.select(*[df[c] for c in df.columns if c != "salt"], F.coalesce(salt, F.lit(0)).cast("long").alias("salt"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; the files of a large shard are split by Spark."""
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
