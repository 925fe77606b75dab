"""URL verdicts from list rules and link-graph propagation.

A rule names a host and a path prefix; the longest rule that fits decides.
All other pages get the verdict of their host: trust flows from hosts with
allowed pages along links (personalised PageRank), distrust flows from hosts
with blocked pages against them, and a host is blocked where its share of
distrust reaches the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

#: (verdict, host and path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
#: Ranks are settled when none changes by more than this share of itself and
#: no new host is reached.
TOLERANCE = 1e-3
#: Share of distrust in a host's trust and distrust from which it is blocked.
BLOCK_SHARE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Absolute link targets in a page.
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``, null where no rule fits: those of
    the longest rule whose host is the page's or a parent of it and whose
    path starts the page's path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, and one link each way
    between a host and the host one label above it, where pages name both."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select("host").distinct()
    above = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
    both = above.select("src", "dst").unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))
    return links.unionByName(both).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, kind, r) for kind 0 (trust) and 1 (distrust) from seeds of the
    same columns.  Trust follows edges in proportion to the source's links,
    distrust runs back over them in proportion to the target's; what reaches
    a host without onward links ends there.  Rounds go on until every rank
    changes by at most ``tolerance`` of itself; a host that is reached for the
    first time changes by all of it.  Every round is written, so the join
    that sends the ranks on can split a hot host."""
    out = scratch.put(edges.groupBy("src").agg(F.sum("n").alias("total")), "out")
    into = scratch.put(edges.groupBy("dst").agg(F.sum("n").alias("total")), "into")
    forward = edges.join(out, "src").select(F.col("src").alias("host"), F.lit(0).alias("kind"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("w"))
    back = edges.join(into, "dst").select(F.col("dst").alias("host"), F.lit(1).alias("kind"), F.col("src").alias("to"), (F.col("n") / F.col("total")).alias("w"))
    flow = scratch.put(forward.unionByName(back), "flow")
    base = seeds.withColumn("r", F.col("r") * (1 - damping))
    none = F.lit(0.0)
    base = base.withColumn("old", none)
    cur = scratch.put(seeds.withColumn("old", none), "ranks")
    while True:
        sent = cur.join(flow, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("r") * F.col("w") * damping).alias("r"), none.alias("old"))
        before = cur.select("host", "kind", none.alias("r"), F.col("r").alias("old"))
        # the sum brings each rank beside the one before it
        nxt = base.unionByName(sent).unionByName(before).groupBy("host", "kind").agg(F.sum("r").alias("r"), F.sum("old").alias("old"))
        nxt = scratch.put(nxt.where("r > 0"), "ranks")
        scratch.drop(cur)
        cur = nxt
        if (cur.agg(F.max(F.abs(F.col("r") - F.col("old")) / F.col("r"))).first()[0] or 0.0) <= tolerance:
            return cur.drop("old")


def judge(pages: DataFrame, rules=RULES, block_share: float = BLOCK_SHARE, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of
    ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has empty host and path, fits no rule
    and is allowed, as is a host that neither trust nor distrust reaches.
    Null html has no links; repeated rows each return a row and count as
    pages; an empty table gives an empty one."""
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    ruled = scratch.put(with_rule(parsed.drop("html"), rules), "pages")
    edges = scratch.put(host_edges(parsed), "edges")
    hits = ruled.where("rule_verdict is not null and host <> ''").groupBy("host", F.when(F.col("rule_verdict") == "allow", 0).otherwise(1).alias("kind")).agg(F.count("*").alias("n"))
    hits = scratch.put(hits, "seeds")
    total = hits.agg(F.sum("n")).first()[0] or 1
    ranks = propagate(edges, hits.select("host", "kind", (F.col("n") / F.lit(float(total))).alias("r")), scratch, tolerance)
    scores = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("r")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("r")).otherwise(0.0)).alias("distrust"))
    scores = scratch.put(scores, "hosts")
    out = ruled.join(scores, "host", "left")
    blocked = F.coalesce(F.col("distrust") >= block_share * (F.col("trust") + F.col("distrust")), F.lit(False)) & (F.coalesce("distrust", F.lit(0.0)) > 0)
    verdict = F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
