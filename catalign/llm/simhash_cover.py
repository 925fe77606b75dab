"""SimHash near-duplicates found by covering locality-sensitive hashing.

A text's fingerprint has one bit per position of its shingles' hashes: the
majority bit.  Two fingerprints link when they differ in at most ``RADIUS``
bits.  For radius r every bit position i gets a vector m(i) of r + 1 bits,
and each non-zero vector v defines a table that keeps the positions with
<m(i), v> = 1 (mod 2).  The r positions in which a pair differs impose r
linear conditions on v, so some v of the 2^(r+1) - 1 is orthogonal to all of
them: in that table the pair has equal keys.  No pair is missed.

Keys held by more than ``MAX_BUCKET`` distinct fingerprints are keyed again by
a second (third) map of the same kind, which keeps the guarantee.  Any three
masks together leave at most 13 positions free at radius 3, so no bucket can
hold more than 2^13 fingerprints, however many copies a group has.  Equal
fingerprints are one node, so exact copies cost nothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .scratch import Scratch

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Distinct fingerprints compared in one bucket; larger buckets are keyed again.
MAX_BUCKET = 2048
_BITS = 64
_CHUNK = 1 << 15


def simhash(data: bytes, k: int = SHINGLE) -> int:
    """Fingerprint of a text's UTF-8 bytes as an unsigned 64-bit number;
    0 for a text without words.  A-Z are lower-cased, words end at ASCII
    white space; fewer than ``k`` words make one shingle."""
    words = data.lower().split()
    if not words:
        return 0
    norm, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = [h(norm, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        start = (end - size + 1)[: len(words) - k + 1].tolist()
        hashes = [h(norm[s:e], SEED) for s, e in zip(start, end[k - 1:].tolist())]
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at:at + _CHUNK], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per input row; null texts count as empty."""
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([simhash(t or b"", k) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, fp long")


def cover_masks(radius: int = RADIUS, level: int = 0) -> list[int]:
    """The 2^(radius+1) - 1 bit masks of one level, as unsigned 64-bit numbers."""
    n = (1 << (radius + 1)) - 1
    vec = [1 + (i, 25 * i * i % 83, 12 * i ** 3 % 83)[level] % n for i in range(_BITS)]
    return [sum(1 << i for i in range(_BITS) if bin(vec[i] & v).count("1") & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, radius: int, level: int) -> DataFrame:
    """(fp, mask, key) of one level; below the first, ``mask`` joins the
    masks of the levels above."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in cover_masks(radius, level)])
    if level == 0:
        out = fps.select("fp", F.explode(masks).alias("mask"))
    else:
        out = fps.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseOR(F.col("mask")))).alias("mask")).distinct()
    return out.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _links(bucket: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one bucket of distinct fingerprints
    (unsigned: bitwise_count takes the absolute value of signed numbers)."""
    left, out = np.sort(bucket), []
    while left.size > 1:
        root, rest = left[0], left[1:]
        front = left[:1]
        while front.size and rest.size:
            near = np.zeros(rest.size, bool)
            for f in front:
                near |= np.bitwise_count(rest ^ f) <= radius
            front, rest = rest[near], rest[~near]
            out += [(int(root.view(np.int64)), x) for x in front.view(np.int64).tolist()]
        left = rest
    return out


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for b in batches:
            found = []
            for fps in b.column(0).to_pylist():
                if len(fps) == 2:
                    if ((fps[0] ^ fps[1]) & (1 << 64) - 1).bit_count() <= radius:
                        found.append((fps[0], fps[1]))
                else:
                    found += _links(np.array(fps, np.int64).view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def near_pairs(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints of ``fps`` (column fp)
    linked at ``radius`` or fewer bits (a spanning forest of each bucket)."""
    cur, found = fps, None
    for level in range(3):
        keyed = _keyed(cur, radius, level)
        sizes = scratch.put(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        multi = scratch.put(keyed.join(sizes, ["mask", "key"]), "buckets")
        last = level == 2
        small = multi if last else multi.where(F.col("n") <= max_bucket)
        pairs = scratch.put(_bucket_links(small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")), radius).distinct(), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        cur = multi.where(F.col("n") > max_bucket).select("fp", "mask")
        if last or cur.isEmpty():
            return found
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is
    the smallest doc_id reachable over links, its own included.

    Null or blank texts have fingerprint 0 and link like any other; a null
    doc_id counts in no minimum (component_id is null where a component has
    no id); repeated rows each return a row; an empty table returns none."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(fingerprints(docs, id_col, text_col, k), "fingerprints")
    nodes = scratch.put(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(near_pairs(nodes.select("fp"), scratch, radius, max_bucket), scratch)
    member = scratch.put(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "members")
    best = scratch.put(member.groupBy("root").agg(F.min("first_id").alias("component_id")), "first")
    label = scratch.put(member.select("fp", "root").join(best, "root").select("fp", "component_id"), "labels")
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (of
    repeated ids the smallest text).  Rows without a doc_id all stay."""
    kept = near_duplicates(docs, k=k, radius=radius).where("doc_id = component_id").select(F.col("doc_id").alias("_keep_id")).distinct()
    kept = Scratch(docs.sparkSession, "simhash-kept").put(kept, "kept")
    cols = docs.columns
    named = docs.join(kept, docs["doc_id"] == kept["_keep_id"], "left_semi")
    whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in cols])
    one = named.groupBy(F.col("doc_id").alias("_keep_id")).agg(F.min_by(whole, F.struct("text")).alias("_row"))
    return one.select("_row.*").unionByName(docs.where(F.col("doc_id").isNull()))
