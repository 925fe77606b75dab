"""The call ledger and the bound on calls of a whole run."""

import os
import time

import pytest

from catalign.operators.modelcall import _call_rows, ledger_map, model_map, shared_bound


def _calls(folder):
    return sorted(int(f.rsplit("-", 1)[0]) for f in os.listdir(folder)) if os.path.isdir(folder) else []


def _logged(folder, answer):
    os.makedirs(folder, exist_ok=True)

    def fn(row):
        k = -1 if row["k"] is None else int(row["k"])
        out = answer(k)
        with open(f"{folder}/{k}-{time.time_ns()}", "w"):
            return out
    return fn


def test_ledger_asks_for_every_distinct_input_once(spark, tmp_dir):
    df = spark.createDataFrame([(i, i % 7 if i % 9 else None, "x") for i in range(60)], "id long, k long, s string")
    log, how = f"{tmp_dir}/log", dict(in_cols=["k"], out_schema="twice long, t string", ledger=f"{tmp_dir}/ledger", retries=1, wait_s=0)
    fn = _logged(log, lambda k: {"twice": 2 * k, "t": f"k{k}"})
    want = sorted((r.id, r.k, "x", 2 * (-1 if r.k is None else r.k), f"k{-1 if r.k is None else r.k}", None) for r in df.collect())
    for _ in range(2):
        assert sorted(map(tuple, ledger_map(df, fn, version="v1", **how).collect())) == want
        assert _calls(log) == [-1, 0, 1, 2, 3, 4, 5, 6]
    more = df.union(spark.createDataFrame([(99, 70, "y")], df.schema))
    assert ledger_map(more, fn, version="v1", **how).count() == 61 and _calls(log)[-1] == 70 and len(_calls(log)) == 9
    ledger_map(df, fn, version="v2", **how)  # another version of the function asks again
    assert len(_calls(log)) == 17
    assert ledger_map(df.limit(0), fn, version="v1", **how).count() == 0
    with pytest.raises(ValueError):
        ledger_map(df.withColumnRenamed("s", "twice"), fn, version="v1", **how)


def test_ledger_keeps_what_a_lost_run_paid_for(spark, tmp_dir):
    df = spark.createDataFrame([(i,) for i in range(40)], "k long")
    log, flag = f"{tmp_dir}/log", f"{tmp_dir}/flag"

    def answer(k):
        if k == 23 and not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("lost")
        return {"v": k + 1}
    run = lambda **kw: ledger_map(df, _logged(log, answer), ["k"], "v long", f"{tmp_dir}/ledger", "v1", retries=1, wait_s=0, tasks=1, flush=1, **kw)
    with pytest.raises(Exception, match="lost"):
        run(on_error="raise").collect()
    first = _calls(log)
    assert 23 not in first
    assert sorted((r.k, r.v) for r in run().collect()) == [(i, i + 1) for i in range(40)]
    assert _calls(log) == list(range(40))


def test_failed_calls_are_asked_again_by_the_next_run(spark, tmp_dir):
    df, flag = spark.createDataFrame([(i,) for i in range(6)], "k long"), f"{tmp_dir}/flag"

    def answer(k):
        if k == 3 and not os.path.exists(flag):
            raise ValueError("no answer")
        return k * 10
    run = lambda: sorted((r.k, r.v, r["_error"]) for r in ledger_map(df, _logged(f"{tmp_dir}/log", answer), ["k"], "v long", f"{tmp_dir}/ledger", "v1", retries=2, wait_s=0).collect())
    assert run()[3] == (3, None, "ValueError: no answer")
    open(flag, "w").close()
    assert run() == [(i, i * 10, None) for i in range(6)]


def test_one_bound_for_all_tasks(spark):
    assert shared_bound(6, 8) == (6, 1) and shared_bound(32, 8) == (8, 4) and shared_bound(1, 8) == (1, 1) and shared_bound(20, 8) == (8, 2)
    with pytest.raises(ValueError):
        shared_bound(0, 8)

    def fn(row):
        began = time.time()
        time.sleep(0.02)
        return {"began": began, "ended": time.time()}
    for total in (1, 3, 6):
        rows = model_map(spark.range(40, numPartitions=8), fn, ["id"], "began double, ended double", retries=1, wait_s=0, total_in_flight=total).collect()
        steps = sorted([(r.began, 1) for r in rows] + [(r.ended, -1) for r in rows])
        now = most = 0
        for _, s in steps:
            now += s
            most = max(most, now)
        assert len(rows) == 40 and most <= total


def test_calls_are_not_queued_one_by_one():
    from concurrent.futures import ThreadPoolExecutor
    queued = []

    class Pool(ThreadPoolExecutor):
        def submit(self, *a, **k):
            queued.append(a)
            return super().submit(*a, **k)
    with Pool(max_workers=3) as pool:
        assert _call_rows(pool, lambda r: -r, list(range(500)), 3) == [-r for r in range(500)]
        assert _call_rows(pool, lambda r: -r, [], 3) == []
        assert len(queued) == 6
        with pytest.raises(SystemExit):
            _call_rows(pool, lambda r: exec("raise SystemExit"), [1, 2], 3)
