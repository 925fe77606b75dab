"""Plan shape: the physical strategies the design relies on."""

import re

import pytest

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("FlatMapCoGroupsInPandas", "FlatMapCoGroupsInArrow", "MapInPandas", "MapInArrow", "ArrowEvalPython",
                "BatchEvalPython", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow")
# queries whose semantics need the vector kernel or a caller's model function
PYTHON_ALLOWED = {"cross_top3", "cross_top3_grid", "cross_top3_ties", "space_rank_nulls", "align_top1", "best_source",
                  "distance_scale", "melt_lists", "fact_transfer", "fact_transfer_long", "rank_by_space",
                  "impute_k1", "impute_k3", "impute_k3_uniform", "impute_neighbours", "impute_lines", "judge_pairs", "embed_text"}


def _plan(spark, name):
    from __spark_entry__ import queries
    df = queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString(), df


def test_top_n_runs_in_cells_and_limits_before_the_shuffle(spark):
    plan, df = _plan(spark, "cross_top3_grid")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert plan.count("WindowGroupLimit") >= 2  # partial before the exchange, final after
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dimension_joins_broadcast(spark):
    plan, _ = _plan(spark, "dim_joins")
    assert "BroadcastHashJoin" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan, _ = _plan(spark, "align_top1")
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(label,5\)", plan)
    plan, _ = _plan(spark, "text_normalise")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name", ["text_normalise", "pivot_first", "dim_joins", "dedupe_first", "md_cells",
                                  "keyed_update", "phase_union", "json_explode", "spine_reindex"])
def test_relational_queries_stay_in_the_jvm(spark, name):
    plan, _ = _plan(spark, name)
    assert not any(n in plan for n in PYTHON_NODES), name


def test_python_only_where_needed(spark):
    from catalign.queries import all_queries
    from catalign.queries.flows import QUERIES as flows  # whole jobs, some of which call a model
    for name, query in all_queries().items():
        if name in PYTHON_ALLOWED or name in flows:
            continue
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(n in plan for n in PYTHON_NODES), name
