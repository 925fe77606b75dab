"""Raking, sampling and packing against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catalign.llm import mix_ipf, pack_bestfit as pb
from catalign.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, weight string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x") for i, t, lang, s in rows], DOCS)


def corpus(n=3000, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}"
        lang = rng.choices(["en", "de", None], [6, 2, 1])[0] if s == "hot" else rng.choices(["en", "de", "fr"], [3, 2, 2])[0]
        mark = rng.choice(["", "", "12345 678 ", "|#| "])
        out.append((i, " ".join([mark + "word"] * rng.randint(1, 40)), lang, s))
    return out


def brute_rake(cells, targets, rounds=200):
    """cells: {(a, b, c): tokens}; targets: one {category: share} per dimension."""
    w = {k: float(v) for k, v in cells.items()}
    total = sum(w.values())
    for _ in range(rounds):
        for d, t in enumerate(targets):
            sums = defaultdict(float)
            for k, v in w.items():
                sums[k[d]] += v
            norm = sum(t[c] for c in sums)
            w = {k: v * t[k[d]] / norm * total / sums[k[d]] for k, v in w.items()}
    return w


def test_weights_and_sampling_equal_brute_force(spark):
    rows = corpus() + [(9001, None, "en", "hot"), (9002, "", None, None), (9002, "", None, None), (None, "some words", "en", "s1")]
    out = mix_ipf.mix(docs(spark, rows)).withColumn("topic", mix_ipf.register(F.col("text"))).collect()
    assert len(out) == len(rows)
    key = lambda r: (r["source"], r["lang"], r["topic"])
    cells = Counter()
    for r in out:
        assert r["mix_tokens"] == len((r["text"] or "").split())
        if r["mix_tokens"]:
            cells[key(r)] += r["mix_tokens"]
    total, targets = sum(cells.values()), []
    for d, name in enumerate(("source", "lang", "topic")):
        share = Counter()
        for k, v in cells.items():
            share[k[d]] += v / total
        targets.append({c: s ** mix_ipf.POWER[name] if s >= mix_ipf.FLOOR else s for c, s in share.items()})
    want = brute_rake(cells, targets)
    top = max(want[k] / cells[k] for k in cells)
    for r in out:
        if r["mix_tokens"]:
            assert r["mix_weight"] == pytest.approx(want[key(r)] / cells[key(r)], rel=2e-3)
            assert r["mix_probability"] == pytest.approx(want[key(r)] / cells[key(r)] / top, rel=4e-3)
        else:
            assert r["mix_sampled"] and r["mix_probability"] == 1
    # the sample's token shares by source are near the target's
    got = Counter()
    for r in out:
        if r["mix_sampled"]:
            got[r["source"]] += r["mix_tokens"]
    norm = sum(targets[0].values())
    for s, t in targets[0].items():
        assert got[s] / sum(got.values()) == pytest.approx(t / norm, abs=0.03)
    assert len({r["mix_sampled"] for r in out if r["doc_id"] == 9002}) == 1


def test_a_rare_cell_does_not_set_the_scale(spark):
    import corpus_pipeline
    # one short document is the only one of its cell, and rare in each dimension
    rows = [(i, "word " * 20, "en", "big") for i in range(900)] + [(900 + i, "word " * 20, "de", "small") for i in range(100)]
    rows += [(5000, "12345 67890", "fr", "tiny")]
    got = {r["doc_id"]: r for r in mix_ipf.mix(docs(spark, rows), scale=1.0).collect()}
    shares = {"big": 18000 / 20002, "small": 2000 / 20002}
    assert got[5000]["mix_sampled"] and all(got[i]["mix_probability"] > 0.9 for i in range(900))
    assert sum(r["mix_sampled"] for r in got.values()) > 0.9 * len(rows)
    for r in got.values():
        assert r["mix_copies"] - 1 < r["mix_weight"] < r["mix_copies"] + 1
        assert r["mix_probability"] == min(1.0, r["mix_weight"])
    # with the copies, tokens by source are the raked ones
    for s, share in shares.items():
        want = sum(r["mix_tokens"] * r["mix_weight"] for r in got.values() if r["source"] == s)
        assert (want > share * 20002) == (s == "small")
        assert sum(r["mix_tokens"] * r["mix_copies"] for r in got.values() if r["source"] == s) == pytest.approx(want, rel=0.12)
    kept = corpus_pipeline.mix_sources(spark, docs(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["mix_sampled"])


def test_given_targets_and_empty(spark):
    rows = corpus(800, 2)
    want = spark.createDataFrame([("hot", 0.1), ("s1", 0.9), ("absent", 5.0)], "source string, share double")
    out = mix_ipf.mix(docs(spark, rows), dims={"source": F.col("source")}, targets={"source": want}).where("mix_weight > 0 and mix_tokens > 0")
    tot = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(F.col("mix_tokens") * F.col("mix_weight"))).collect()}
    assert set(tot) == {"hot", "s1"} and tot["hot"] / sum(tot.values()) == pytest.approx(0.1)
    empty = mix_ipf.mix(docs(spark, []))
    assert empty.count() == 0 and "mix_sampled" in empty.columns


def slow_pack(lengths, sources, clusters, capacity, per_source):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins)
                if capacity - sum(x[0] for x in b) >= n and all(x[2] != c for x in b) and sum(x[1] == s for x in b) < per_source]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([])
        bins[i].append((n, s, c))
        out.append(i)
    return out


@pytest.mark.parametrize("per_source", [1, 2, 4])
def test_pack_equals_exhaustive_best_fit(per_source):
    rng = random.Random(per_source)
    n = 300
    lengths = sorted((rng.randint(0, 60) for _ in range(n)), reverse=True)
    sources = [rng.choice(["hot"] * 3 + ["a", "b", None]) for _ in range(n)]
    clusters = [rng.choice([1, 1, 2, *range(10, 200)]) for _ in range(n)]
    assert pb.pack(lengths, sources, clusters, 100, per_source) == slow_pack(lengths, sources, clusters, 100, per_source)


def check_bins(rows, sizes, capacity, per_source):
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for b in bins.values():
        assert sum(r["n_tokens"] for r in b) <= capacity
        assert max(Counter(r["source"] for r in b).values()) <= per_source
        texts = [sizes[r["doc_id"]][1] for r in b]
        assert len(set(texts)) == len(texts)
    return bins


def test_pack_documents(spark):
    rng = random.Random(9)
    rows = [(i, f"d{i} " + "w " * rng.randint(0, 150), "en", rng.choice(["hot", "hot", "x", "y", None])) for i in range(700)]
    rows += [(1000 + i, "the same text " * 5, "en", f"s{i % 3}") for i in range(90)] + [(2000, "long " * 1030, "en", "x"), (2001, None, "en", "x"), (2002, "", None, None)]
    sizes = {r[0]: (len((r[1] or "").split()), "".join((r[1] or "").split()).lower()) for r in rows}
    df = docs(spark, rows)
    out = pb.pack_documents(df, capacity=200, per_source=3, pack_rows=100)
    got = out.collect()
    check_bins([r for r in got], sizes, 200, 3)
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        assert r["start"] == 200 * r["piece"]
    assert total == Counter({i: n for i, (n, _) in sizes.items()}) or {i: total[i] for i in sizes} == {i: n for i, (n, _) in sizes.items()}
    assert set(r["doc_id"] for r in got) == set(sizes)
    assert sorted(map(str, got)) == sorted(map(str, pb.pack_documents(df.repartition(3), capacity=200, per_source=3, pack_rows=100).collect()))
    bins = pb.bins_of(out)
    assert bins.agg(F.sum("n_tokens")).first()[0] == sum(n for n, _ in sizes.values())
    assert bins.agg(F.sum(F.size("doc_ids"))).first()[0] == len(got)


def test_pack_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "a b c", "en", "x")] * 5 + [(None, "d e", "en", None)] * 2
    got = pb.pack_documents(docs(spark, rows)).collect()
    assert len(got) == 7 and len({r["bin_id"] for r in got if r["doc_id"] == 1}) == 5
    assert sum(r["doc_id"] is None for r in got) == 2
    assert pb.pack_documents(docs(spark, [])).count() == 0
    assert pb.bins_of(pb.pack_documents(docs(spark, []))).count() == 0


def test_targets_that_contradict_each_other(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 30)], "s string, l string, tokens long")
    share = lambda d, *rows: spark.createDataFrame(rows, f"{d} string, share double")
    targets = {"s": share("s", ("a", 0.5), ("b", 0.5)), "l": share("l", ("x", 0.9), ("y", 0.1))}
    with pytest.raises(ValueError):
        mix_ipf.rake(cells, targets, Scratch(spark, "test"))
    got = {r["l"]: r["weight"] for r in mix_ipf.rake(cells, targets, Scratch(spark, "test"), strict=False).collect()}
    assert got == {"x": pytest.approx(36), "y": pytest.approx(4)}


def test_rake_goes_on_to_its_tolerance(spark):
    rng = random.Random(8)  # many rounds: cells that all but follow the diagonal
    rows = [(f"s{i}", f"l{j}", 10_000 if i == j else rng.choice([1, 1, 2])) for i in range(6) for j in range(6)]
    cells = spark.createDataFrame(rows, "s string, l string, tokens long")
    share = lambda d, p: spark.createDataFrame([(f"{d}{i}", p ** i) for i in range(6)], f"{d} string, share double")
    out = mix_ipf.rake(cells, {"s": share("s", 0.7), "l": share("l", 1.2)}, Scratch(spark, "test")).collect()
    total = sum(r["tokens"] for r in out)
    for d, p in (("s", 0.7), ("l", 1.2)):
        for i in range(6):
            want = p ** i / sum(p ** j for j in range(6)) * total
            assert sum(r["weight"] for r in out if r[d] == f"{d}{i}") == pytest.approx(want, rel=1e-3)


def test_rake_writes_one_row_per_cell(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 60)], "s string, l string, tokens long")
    targets = {"s": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "s string, share double"), "l": spark.createDataFrame([("x", 0.7), ("y", 0.3)], "l string, share double")}
    got = {(r["s"], r["l"]): r["weight"] for r in mix_ipf.rake(cells, targets, Scratch(spark, "test")).collect()}
    assert got[("a", "y")] == pytest.approx(30, rel=1e-3) and got[("b", "x")] == pytest.approx(50, rel=1e-3)
