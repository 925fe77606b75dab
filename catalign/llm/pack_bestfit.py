"""Best-fit packing of documents into fixed-length bins under conflicts.

Documents are dealt to independent packs of bounded size by a hash.  Within a
pack, pieces go in by falling length to the bin of least residual that holds
them, found by successor search in the residual-ordered list of open bins.
Each bin carries bitmaps of its sources (one plane per allowed document) and
of its duplicate clusters; an incompatible bin sends the search on to the
next larger residual, until the tightest compatible bin or a new one."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .mix_ipf import n_tokens
from .scratch import Scratch

CAPACITY = 2048
#: Documents of one source that a bin may hold.
PER_SOURCE = 4
#: Pieces that are packed together, on average.
PACK_ROWS = 2048


def pack(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[int]:
    """A bin number for each piece, in the order given (falling length for
    best-fit decreasing)."""
    often = Counter(clusters)
    bit: dict = {}
    cluster_bit = [1 << bit.setdefault(c, len(bit)) if often[c] > 1 else 0 for c in clusters]
    number: dict = {}
    source_bit = [1 << number.setdefault(s, len(number)) for s in sources]
    held: list[int] = []
    planes: list[list[int]] = []
    free: list[tuple[int, int]] = []
    out = []
    for size, cluster, source in zip(lengths, cluster_bit, source_bit):
        for at in range(bisect_left(free, (size, -1)), len(free)):
            left, b = free[at]
            if not held[b] & cluster and not planes[b][-1] & source:
                del free[at]
                break
        else:
            left, b = capacity, len(held)
            held.append(0)
            planes.append([0] * per_source)
        held[b] |= cluster
        for p in planes[b]:
            if not p & source:
                planes[b][planes[b].index(p)] = p | source
                break
        insort(free, (left - size, b))
        out.append(b)
    return out


def text_cluster(text: Column) -> Column:
    """Cluster of texts that are equal but for case and white space."""
    return F.xxhash64(F.lower(F.translate(F.coalesce(text, F.lit("")), " \t\r\n", "")))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None,
                   cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
                   pack_rows: int = PACK_ROWS) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id) of every piece of every row.

    A document longer than ``capacity`` tokens is cut into full pieces and a
    rest; one without tokens is a single empty piece.  No bin exceeds its
    capacity, holds two pieces of one duplicate cluster, or more than
    ``per_source`` pieces of one source.  Null sources are one source; rows
    that repeat an id are packed each, in different bins as one cluster."""
    text = F.col("text").cast("string")
    tokens, cluster = n_tokens(text) if tokens is None else tokens, text_cluster(text) if cluster is None else cluster
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       tokens.cast("long").alias("size"), cluster.cast("long").alias("cluster"))
    scratch = Scratch(docs.sparkSession, "pack")
    # equal rows travel as one with a count and part again under a copy number
    sizes = scratch.put(rows.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("copies")), "sizes")
    full = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1))
    total = sizes.agg(F.sum(F.col("copies") * full)).first()[0] or 0
    packs = max(1, -(-int(total) // pack_rows))
    pieces = (sizes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
              .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), (full - 1).cast("long"))))
              .withColumn("start", F.col("piece") * capacity)
              .withColumn("n_tokens", F.least(F.col("size") - F.col("start"), F.lit(capacity))))
    pieces = pieces.withColumn("pack", F.pmod(F.xxhash64("doc_id", "cluster", "copy", "piece"), F.lit(packs)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece", "cluster", "source", "copy"], ascending=[False] + [True] * 5)
        bins = pack(frame["n_tokens"].tolist(), frame["source"].tolist(), frame["cluster"].tolist(), capacity, per_source)
        frame["bin_id"] = [p * (1 << 24) + b for p, b in zip(frame["pack"].tolist(), bins)]
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame[["doc_id", "source", "piece", "start", "n_tokens", "bin_id"]]

    out = pieces.select("pack", "doc_id", "source", "cluster", "copy", "piece", "start", "n_tokens").groupBy("pack")
    return out.applyInPandas(run, "doc_id long, source string, piece long, start long, n_tokens long, bin_id long")


def bins_of(packed: DataFrame) -> DataFrame:
    """One row per bin: bin_id, n_tokens, and its pieces, largest first."""
    piece = F.struct((-F.col("n_tokens")).alias("order"), "doc_id", "piece", "start", "n_tokens")
    rows = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("p"))
    return rows.select("bin_id", "n_tokens", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
                       F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["start"].alias("start"), x["n_tokens"].alias("n_tokens"))).alias("pieces"))
