"""Write PLANS.md: the physical plan shape of every registered query.

    python tests/plan_report.py /root/testdata/sf0.01
"""

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NODE = re.compile(r"^\s*(?:[:+\-| ]*)(\*?\s*\(\d+\)\s*)?([A-Z][A-Za-z]+)")


def shape(plan: str) -> list[str]:
    nodes = []
    for line in plan.splitlines():
        line = line.strip()
        if not line or line.startswith("(") or ":" in line.split(" ")[0]:
            continue
        m = re.search(r"([A-Z][A-Za-z]+)(?: \(\d+\))?", line)
        if m and (line.startswith(("+-", ":-", "*", "AdaptiveSparkPlan")) or line[0].isupper()):
            nodes.append(m.group(1))
    return nodes


def main(sf_dir: str) -> None:
    from catalign.queries import all_queries
    from catalign.session import build_session
    spark = build_session("local[8]", 8)
    out = ["# PLANS", "", f"Physical plans of the registered queries on `{sf_dir}` (`local[8]`, AQE on), after one execution,",
           "so the adaptive plan is final. Generated by `python tests/plan_report.py`. Per query: exchanges (shuffles),",
           "broadcasts, Python nodes, and the scans' pushed filters and read schemas.", ""]
    for name, fn in sorted(all_queries().items()):
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        exch = len(re.findall(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange RoundRobin|\bExchange SinglePartition|ShuffleQueryStage", plan))
        bcast = plan.count("BroadcastExchange") + plan.count("BroadcastQueryStage")
        py = sorted(set(re.findall(r"(FlatMapCoGroupsInArrow|FlatMapGroupsInPandas|MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython)", plan)))
        wgl = plan.count("WindowGroupLimit")
        scans = sorted(set(re.findall(r"ReadSchema: (\S+)", plan)))
        pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan)) - {"[]"})
        out.append(f"## `{name}`")
        out.append("")
        out.append(f"- shuffles: {exch}; broadcast stages: {bcast}; WindowGroupLimit: {wgl}; Python: {', '.join(py) or 'none'}")
        for s in scans:
            out.append(f"- scan `{s}`")
        for p in pushed:
            out.append(f"- pushed filters `{p}`")
        out.append("")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
