"""SimHash groups and line removal against brute force."""

import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from catalign.llm import line_spread, simhash_cover as sc
from catalign.llm.graph import components
from catalign.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows], DOCS)


def slow_simhash(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(pairs, radius=3):
    """component id by row position."""
    fps = sorted({f for _, f in pairs})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    low = defaultdict(list)
    for d, f in pairs:
        if d is not None:
            low[root(f)].append(d)
    return [min(low[root(f)], default=None) for _, f in pairs]


def test_simhash_equals_slow_version(spark):
    texts = [None, "", " \t\n", "One", "one two", "A b\u00a0c d\x0be", "É É é ß " * 30, "word " * 400, "a b c a b c", " ".join(map(str, range(9000)))]
    for t in texts:
        assert sc.simhash((t or "").encode()) == slow_simhash(t)


@pytest.mark.parametrize("radius", [1, 3])
def test_every_close_pair_collides_in_some_table(radius):
    rng = random.Random(3)
    for level in range(3):
        masks = sc.cover_masks(radius, level)
        for _ in range(2000):
            bits = rng.sample(range(64), rng.randint(0, radius))
            diff = sum(1 << b for b in bits)
            assert any(diff & m == 0 for m in masks)


def test_three_levels_bound_a_bucket():
    a, b, c = (sc.cover_masks(3, lv) for lv in range(3))
    assert max(64 - (x | y | z).bit_count() for x in a for y in b for z in c) <= 13


def planted(rng, n):
    base = rng.getrandbits(64)
    fps = set()
    for _ in range(n):
        x = rng.choice([base, rng.getrandbits(64)])
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        fps.add(x)
    return sorted(fps)


@pytest.mark.parametrize("max_bucket", [2, 8, 5000])
def test_links_are_whole_whatever_the_bucket_bound(spark, max_bucket):
    fps = planted(random.Random(max_bucket), 400)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    scratch = Scratch(spark, "test")
    edges = sc.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), scratch, max_bucket=max_bucket)
    got = {r["node"]: r["root"] for r in components(edges, scratch).collect()}
    want = slow_groups(list(enumerate(fps)))
    groups = defaultdict(set)
    for i, f in enumerate(signed):
        groups[got.get(f, f)].add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(i for i, w in enumerate(want) if w == x) for x in set(want)}


def corpus(rng):
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = []
    for g in range(12):
        t = text(200)
        rows += [(len(rows) + i, t, f"s{g}") for i in range(3)]
        words = t.split()
        words[rng.randrange(200)] = "edit"
        rows.append((len(rows), " ".join(words), "s0"))
    rows += [(900, None, "s0"), (901, "", None), (902, "  \n", "s1"), (None, rows[0][1], "s1"), (5, rows[5][1], "s9"), (903, text(20000), "s1"), (None, "alone here", "s")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus(random.Random(4))
    out = sc.near_duplicates(frame(spark, rows)).select("doc_id", "fp", "component_id").collect()
    fps = [slow_simhash(t) for _, t, _ in rows]
    want = sorted(map(str, zip((r[0] for r in rows), fps, slow_groups([(r[0], f) for r, f in zip(rows, fps)]))))
    assert sorted(str((r[0], r[1] % (1 << 64), r[2])) for r in out) == want
    assert sc.near_duplicates(frame(spark, [])).count() == 0


def test_keep_one_keeps_one_row_of_each_group(spark):
    rows = corpus(random.Random(5))
    df = frame(spark, rows)
    kept = sc.keep_one(df)
    assert kept.columns == df.columns
    groups = slow_groups([(r[0], slow_simhash(r[1])) for r in rows])
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({g for g in groups if g is not None})
    assert ids.count(None) == 2


def slow_lines(rows, min_sites):
    key = lambda line: line.strip(" \t\r")
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if key(line):
                if s is not None:
                    sites[key(line)].add(s)
                at = (i is not None, i or 0, p)
                first[key(line)] = min(first.get(key(line), at), at)
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        keep = [x for p, x in enumerate(lines) if not key(x) or len(sites[key(x)]) < min_sites or first[key(x)] == (i is not None, i or 0, p)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def test_line_removal_equals_brute_force(spark):
    rng = random.Random(6)
    common = [f"common line of text number {i}" for i in range(8)]
    rows = []
    for d in range(300):
        lines = [f"own line {d} {j} of this document" for j in range(rng.randint(0, 4))] + rng.choices(common, k=rng.randint(0, 3)) + ["short", ""]
        rng.shuffle(lines)
        pick = [common.index(x) for x in lines if x in common]
        rows.append((d, "\n".join(lines), f"s{rng.randrange(3 + 3 * max(pick, default=0))}"))
    rows += [(1000, None, "s1"), (1001, "", "s1"), (None, common[7] + "\n" + common[7], None), (3, "  " + common[6] + "\t\r\n" + common[6], "s2"), (7, rows[7][1], "s30")]
    df = frame(spark, rows)
    out = line_spread.remove_boilerplate(df, min_sites=10)
    assert out.columns == df.columns + ["n_lines", "n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()), key=str)
    assert got == slow_lines(rows, 10) and sum(r[3] for r in got) > 50
    assert all(r["n_chars"] == len(r["text"]) for r in out.where("text is not null").collect())
    assert line_spread.remove_boilerplate(df.limit(0)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(n * 1000 + i, f"a line that is on {n} sites", f"s{i}") for n in (6, 7, 8, 9, 10, 11, 12, 40) for i in range(n)]
    lines = line_spread._lines(frame(spark, rows), "doc_id", "text", "source")
    found = line_spread.boilerplate(lines, Scratch(spark, "test"), 10)
    want = {r["h"] for r in frame(spark, rows).where("doc_id >= 10000").select(line_spread.line_hash(F.col("text")).alias("h")).collect()}
    assert {r["h"] for r in found.collect()} == want


def test_short_lines_are_removed(spark):
    # 'Les.' is on 12 sites, 'Of.' on 9; blank lines are no lines to remove
    rows = [(i, f"Les.\n\nown line {i} of this document\n  Les. " + ("\nOf." if i < 9 else ""), f"s{i}") for i in range(12)]
    out = {r["doc_id"]: r for r in line_spread.remove_boilerplate(frame(spark, rows)).collect()}
    assert out[0]["text"] == "Les.\n\nown line 0 of this document\nOf."
    assert out[11]["text"] == "\nown line 11 of this document"
    assert [out[i]["n_removed"] for i in range(12)] == [1] + [2] * 11
    assert all(r["n_removed"] == 0 for r in line_spread.remove_boilerplate(frame(spark, rows), min_chars=20).collect())


def test_pipeline_removes_short_lines(spark):
    import corpus_pipeline
    rows = [(i, f"Les.\nown line {i} of this document", f"s{i}") for i in range(12)]
    out = corpus_pipeline.drop_boilerplate(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in out.where("text like '%Les.%'").collect()) == [0]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(0, i) for i in range(1, 60)] + [(5, 5), (1, 0)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {**{i: 100 for i in range(101, 181)}, **{i: 0 for i in range(1, 60)}}
