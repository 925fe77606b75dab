"""Merkle manifest of a table, with a proof for every row.

Leaves are grouped by language and ordered by id; the tree has ``FANOUT``
children a node, and the last node of a level may have fewer.  Leaves are
dealt to aligned blocks of ``FANOUT ** BLOCK_LEVELS`` positions, so a block is
a whole subtree.  The block roots then take part in a butterfly exchange: in
round r the ``FANOUT`` blocks whose numbers differ in digit r alone swap the
roots of their subtrees, and each of them hashes the common ancestor itself.
After the last round every block knows the root of its language and the
siblings on its way there, without a pass back down.  Block numbers are filled
up to a power of ``FANOUT``; a number without leaves starts without a node and
learns its neighbours' ancestors, so every exchange is between exactly
``FANOUT`` rows and no block is asked by many.  The roots of the languages go
through the same exchange."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordinal import numbered
from .scratch import Scratch

FANOUT = 2
#: Levels inside a block; 2 ** 12 leaves are one group of a task.
BLOCK_LEVELS = 12
#: Rounds of the exchange between two written tables.
ROUNDS_A_TABLE = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row: per field ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    return F.sha2(F.concat(*[_field(f) for f in fields]), 256)


def tampered_rows(id_col: str = "doc_id") -> Column:
    """Rows whose id's crc32 7 divides; a null id is never one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): ``tampered`` is the leaf after 1 was
    added to n_chars where ``tampered_rows`` holds, else null."""
    cols = {c: F.col(f"`{c}`") for c in FIELDS}
    more = cols | {"n_chars": cols["n_chars"].cast("decimal(20,0)") + 1}
    return docs.select(cols["doc_id"].cast("long").alias("doc_id"), cols["lang"].cast("string").alias("lang"), leaf_of(list(cols.values())).alias("leaf"),
                       F.when(tampered_rows(), leaf_of(list(more.values()))).alias("tampered"))


def levels(nodes: list[str], fanout: int, depth: int) -> list[list[str]]:
    """The nodes of a subtree, level by level up to its root at ``depth``."""
    out = [nodes]
    for _ in range(depth):
        nodes = [digest(nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def depth_of(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes."""
    depth = 0
    while n > 1:
        n, depth = -(-n // fanout), depth + 1
    return depth


def siblings(tree: list[list[str]], at: int, fanout: int) -> list[list[str]]:
    """Per level the nodes before and after the one above leaf ``at``, in its run."""
    out = []
    for level in tree[:-1]:
        start = at - at % fanout
        out.append([level[start:at], level[at + 1:start + fanout]])
        at //= fanout
    return out


def fold(node: str, proof) -> str:
    """The root that ``node`` and its siblings lead to."""
    for before, after in proof:
        node = digest([*before, node, *after])
    return node


def exchange(nodes: DataFrame, group: list[str], fanout: int, scratch: Scratch) -> DataFrame:
    """``nodes`` (group.., at, n, node): node ``at`` of the ``n`` that its group
    has.  Returns (group.., at, root, proof), ``proof`` as in ``siblings``.

    Rounds are digits of ``at``.  A group of fewer nodes than the widest has
    its root early; the rounds above do nothing to it."""
    widest = nodes.agg(F.max("n")).first()[0] or 0
    rounds = depth_of(widest, fanout)
    depth = sum((F.when(F.col("n") > fanout ** r, 1).otherwise(0) for r in range(rounds)), F.lit(0))
    places = nodes.select(*group, "n", depth.alias("depth")).distinct()
    filled = places.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(fanout), F.col("depth")).cast("long") - 1)))
    keys = [*group, "at"]
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    own = nodes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "node")
    state = filled.join(own, same, "left").select(*keys, "n", "depth", "node", F.array().cast("array<array<array<string>>>").alias("proof"))
    state = scratch.put(state, "round-0") if rounds else state
    for r in range(rounds):
        digit = F.pmod(F.floor(F.col("at") / fanout ** r).cast("long"), F.lit(fanout))
        rest = [F.floor(F.col("at") / fanout ** (r + 1)).cast("long"), F.pmod("at", F.lit(fanout ** r))]
        run = F.array_sort(F.collect_list(F.struct(digit.alias("digit"), "node")).over(Window.partitionBy(*group, *rest)))
        known = state.withColumn("_digit", digit).withColumn("_run", F.filter(run, lambda x: x["node"].isNotNull()))
        part = lambda keep: F.transform(F.filter("_run", keep), lambda x: x["node"])
        proof = F.array(part(lambda x: x["digit"] < F.col("_digit")), part(lambda x: x["digit"] > F.col("_digit")))
        ancestor = F.when(F.size("_run") > 0, F.sha2(F.array_join(F.transform("_run", lambda x: x["node"]), ""), 256))
        active = F.col("depth") > r
        state = known.select(*keys, "n", "depth", F.when(active, ancestor).otherwise(F.col("node")).alias("node"),
                             F.when(active, F.concat("proof", F.array(proof))).otherwise(F.col("proof")).alias("proof"))
        if (r + 1) % ROUNDS_A_TABLE == 0 and r + 1 < rounds:
            state = scratch.put(state, f"round-{r + 1}")
    return state.where(F.col("at") < F.col("n")).select(*keys, F.col("node").alias("root"), "proof")


def manifest(docs: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified)
    of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Nulls are a value of every field, a null language is a group of its own
    (the first), null ids come first in their group, and rows of one id follow
    in the order of their leaves, so equal rows change nothing.  Other columns
    are not read.  An empty table gives no row."""
    scratch = Scratch(docs.sparkSession, "merkle")
    block = fanout ** block_levels
    placed = numbered(scratch.put(leaves(docs), "leaves"), ["lang"], [F.asc_nulls_first("doc_id"), "leaf"], scratch)
    placed = scratch.put(placed.withColumn("at", F.floor(F.col("position") / block).cast("long")), "placed")
    sizes = placed.groupBy("lang").agg(F.count("*").alias("n_leaves"))

    def root(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        # a language of one block ends at its own height
        depth = depth_of(rows.num_rows, fanout) if rows["whole"][0].as_py() else block_levels
        node = levels(rows["leaf"].to_pylist(), fanout, depth)[-1][0]
        return rows.slice(0, 1).select(["lang", "at"]).append_column("node", pa.array([node]))

    one = _beside(placed, sizes.select("lang", (F.col("n_leaves") <= block).alias("whole")), ["lang"])
    blocks = one.select("lang", "at", "position", "leaf", "whole").groupBy("lang", "at").applyInArrow(root, "lang string, at long, node string")
    blocks = scratch.put(_beside(blocks, sizes.select("lang", F.ceil(F.col("n_leaves") / block).cast("long").alias("n")), ["lang"]), "blocks")
    upper = exchange(blocks, ["lang"], fanout, scratch)
    upper = scratch.put(upper.withColumnsRenamed({"root": "subroot", "proof": "to_subroot"}), "upper")

    subroots = numbered(upper.where(F.col("at") == 0).select("lang", "subroot"), [], [F.asc_nulls_first("lang")], scratch)
    total = subroots.count()
    tops = exchange(subroots.select(F.col("position").alias("at"), F.lit(total).cast("long").alias("n"), F.col("subroot").alias("node")), [], fanout, scratch)
    tops = subroots.join(tops, F.col("position") == F.col("at")).select("lang", "root", F.col("proof").alias("to_root"))
    upper = _beside(_beside(upper, tops, ["lang"]), sizes.select("lang", (F.col("n_leaves") <= block).alias("whole")), ["lang"])

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, top = rows.sort_by("position"), above.to_pylist()[0]
        leaf = rows["leaf"].to_pylist()
        tree = levels(leaf, fanout, depth_of(len(leaf), fanout) if top["whole"] else block_levels)
        high, sums, folded = [*top["to_subroot"], *top["to_root"]], [], []
        for i, (own, changed) in enumerate(zip(leaf, rows["tampered"].to_pylist())):
            proof = [*siblings(tree, i, fanout), *high]
            sums.append(digest(x for before, after in proof for x in [*before, *after]))
            folded.append(fold(own if changed is None else changed, proof))
        every = lambda x: pa.array([x] * len(leaf), pa.string())
        return pa.table({"doc_id": rows["doc_id"], "lang": rows["lang"], "leaf": rows["leaf"], "subroot": every(top["subroot"]), "root": every(top["root"]),
                         "proof_sha256": sums, "folded_root": folded, "verified": [x == top["root"] for x in folded]})

    return placed.groupBy("lang", "at").cogroup(upper.groupBy("lang", "at")).applyInArrow(
        prove, "doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Join in which a null key meets a null key."""
    other = other.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(keys)], *[c for c in other.columns if c not in keys])
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return df.join(other, same, "left").drop(*[f"_b{i}" for i in range(len(keys))])
