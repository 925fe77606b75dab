"""Model-call surface (MDL1-MDL8): a caller-supplied Python function applied
to rows of a DataFrame inside ``mapInPandas``.

The engine ships no network client and no keys.  Each Arrow batch is fed to
a thread pool; every call is retried ``retries`` times with a fixed wait; a
call that still fails gives nulls and an ``_error`` text instead of failing
the job (unless ``on_error='raise'``).  A ``validate`` function may reject an
answer, which counts as a failed attempt (re-ask).

``max_in_flight`` bounds the calls of one task, ``total_in_flight`` those of
the whole run: the rows are dealt over a fixed number of tasks that share the
bound.  ``model_map`` repeats the calls of a task that Spark retries; callers
that pay per call use ``ledger_map``, whose tasks write their answers as they
come and look them up before they call.
"""

from __future__ import annotations

import hashlib
import itertools
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ERROR_COL = "_error"


#: Answers of a task that are written together.
LEDGER_ROWS = 256


def _call_with_retry(fn, args, retries, wait_s, validate):
    last = None
    for attempt in range(max(1, retries)):
        try:
            out = fn(args)
            if validate is not None and not validate(args, out):
                raise ValueError("answer rejected by validator")
            return out, None
        except Exception as e:  # noqa: BLE001 - caller's function may raise anything
            last = e
            if attempt + 1 < retries and wait_s:
                time.sleep(wait_s)
    return None, f"{type(last).__name__}: {last}"


def _call_rows(pool, call, rows: list, workers: int) -> list:
    """``call`` of every row, in order.  Each of the pool's ``workers`` takes the
    next row when it is done with its last one, so no call is queued by itself."""
    results, at = [None] * len(rows), itertools.count()

    def work(_):
        while (i := next(at)) < len(rows):
            results[i] = call(rows[i])
    list(pool.map(work, range(workers)))  # raises what a worker raised
    return results


def model_map(df: DataFrame, fn: Callable[[dict], object], in_cols: Sequence[str], out_schema: T.StructType | str,
              keep_cols: Sequence[str] = (), retries: int = 3, wait_s: float = 1.0, max_in_flight: int = 8,
              on_error: str = "null", validate: Callable[[dict, object], bool] | None = None,
              partitions: int | None = None, total_in_flight: int | None = None) -> DataFrame:
    """Apply ``fn(row_dict) -> dict | value`` to each row.

    ``out_schema`` names the output fields; ``fn`` returns a dict with those
    keys (or a bare value when there is one field).  Output columns:
    ``keep_cols``, the output fields, ``_error``.  ``partitions`` deals the
    rows over as many tasks first; ``total_in_flight`` deals them over at most
    so many tasks, each with an equal share of the bound, so that the run never
    has more calls under way (a speculative copy of a task would add its own:
    leave speculation off).  Nothing is computed before the action.
    """
    if isinstance(out_schema, str):
        out_schema = T._parse_datatype_string(out_schema)
    fields = out_schema.fieldNames()
    in_cols, keep_cols = list(in_cols), list(keep_cols)
    src = df.select(*dict.fromkeys(keep_cols + in_cols))
    if total_in_flight is not None:
        partitions, max_in_flight = shared_bound(total_in_flight, partitions or df.sparkSession.sparkContext.defaultParallelism)
    if partitions:
        src = src.repartition(partitions)
    schema = T.StructType([src.schema[c] for c in keep_cols] + list(out_schema.fields)
                          + [T.StructField(ERROR_COL, T.StringType())])

    def run(batches):
        workers = max(1, max_in_flight)
        with ThreadPoolExecutor(max_workers=workers) as pool:
            for pdf in batches:
                rows = pdf[in_cols].to_dict("records")
                results = _call_rows(pool, lambda r: _call_with_retry(fn, r, retries, wait_s, validate), rows, workers)
                if on_error == "raise":
                    for _, err in results:
                        if err:
                            raise RuntimeError(err)
                out = {c: pdf[c].tolist() for c in keep_cols}
                for f in fields:
                    vals = []
                    for res, _ in results:
                        if res is None:
                            vals.append(None)
                        elif isinstance(res, dict):
                            vals.append(res.get(f))
                        else:
                            vals.append(res if len(fields) == 1 else None)
                    out[f] = vals
                out[ERROR_COL] = [err for _, err in results]
                yield pd.DataFrame(out, columns=schema.fieldNames())

    return src.mapInPandas(run, schema=schema)


def shared_bound(total: int, tasks: int) -> tuple[int, int]:
    """(tasks, calls under way in each) that together stay within ``total``."""
    if total < 1:
        raise ValueError("at least one call has to be under way")
    tasks = max(1, min(total, tasks))
    return tasks, total // tasks


def _input_key(version: str, in_cols: Sequence[str]) -> Column:
    """Hash of a call: the function's version and its inputs, nulls included."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("_v"), *[F.col(f"`{c}`") for c in in_cols]), {"ignoreNullFields": "false"}), 256)


def ledger_map(df: DataFrame, fn: Callable[[dict], object], in_cols: Sequence[str], out_schema: T.StructType | str, ledger: str,
               version: str, retries: int = 3, wait_s: float = 1.0, on_error: str = "null",
               validate: Callable[[dict, object], bool] | None = None, total_in_flight: int = 8,
               tasks: int | None = None, flush: int = LEDGER_ROWS) -> DataFrame:
    """MDL1 + MDL7: ``df`` with the output fields and ``_error``, where no
    distinct input is paid for twice.

    The ledger (a folder that all executors can write, by any URI that Arrow's
    file systems know) keeps one row per answer: the hash of ``version`` and
    the inputs, the fields, the error.  Inputs whose hash is there are not
    called.  The others are dealt by hash over a fixed number of tasks; a task
    writes its answers after every ``flush`` calls, each time as one file that
    appears by a rename, in a folder named by the inputs' share of the hash.
    A retry of the task, or a later run, finds them there and goes on after
    them.  What a lost task can cost again is at most the calls that it had
    not written yet.  A call that failed for good is kept for the retries of
    its run and asked again by the next run.  Change ``version`` with the
    function.  The calls run when this function is called."""
    import uuid

    from pyarrow import fs as pafs
    from ..sources.sinks import output_exists
    if isinstance(out_schema, str):
        out_schema = T._parse_datatype_string(out_schema)
    fields, in_cols, spark = out_schema.fieldNames(), list(in_cols), df.sparkSession
    if clash := {*fields, ERROR_COL} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} of the input have the name of an output")
    entry = T.StructType([T.StructField("_key", T.StringType()), *out_schema.fields, T.StructField(ERROR_COL, T.StringType()), T.StructField("_run", T.StringType())])
    root = ledger if "://" in ledger else "file://" + ledger if ledger.startswith("/") else ledger.replace("file:/", "file:///", 1)
    run = uuid.uuid4().hex
    tasks, in_flight = shared_bound(total_in_flight, tasks or spark.sparkContext.defaultParallelism)
    keyed = df.withColumn("_key", _input_key(version, in_cols))
    read = lambda: spark.read.schema(entry).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(ledger)
    todo = keyed.select("_key", *in_cols).dropDuplicates(["_key"])
    if output_exists(spark, ledger):
        todo = todo.join(read().filter(F.col(ERROR_COL).isNull()).select("_key"), "_key", "left_anti")

    def call(batches):
        from pyspark import TaskContext
        store, base = pafs.FileSystem.from_uri(root)
        folder = f"{base}/run-{run}/task-{TaskContext.get().partitionId()}"
        store.create_dir(folder, recursive=True)
        names = [f.path for f in store.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet")]
        known = {k for name in names for k in pq.read_table(name, columns=["_key"], filesystem=store)["_key"].to_pylist()}
        arrow = to_arrow_schema(entry)

        def put(rows, results):
            value = lambda res, f: None if res is None else res.get(f) if isinstance(res, dict) else res if len(fields) == 1 else None
            columns = {"_key": [r["_key"] for r in rows], ERROR_COL: [err for _, err in results], "_run": [run] * len(rows),
                       **{f: [value(res, f) for res, _ in results] for f in fields}}
            name = f"{folder}/{uuid.uuid4().hex}"
            with store.open_output_stream(name) as out:
                pq.write_table(pa.table([pa.array(columns[c.name], c.type) for c in arrow], schema=arrow), out)
            store.move(name, f"{name}.parquet")

        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            for pdf in batches:
                rows = [r for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records") if r["_key"] not in known]
                for at in range(0, len(rows), flush):
                    part = rows[at:at + flush]
                    results = list(pool.map(lambda r: _call_with_retry(fn, {c: r[c] for c in in_cols}, retries, wait_s, validate), part))
                    bad = [err for _, err in results if err]
                    if bad and on_error == "raise":  # the answers that came are kept
                        good = [i for i, (_, err) in enumerate(results) if not err]
                        put([part[i] for i in good], [results[i] for i in good])
                        raise RuntimeError(bad[0])
                    put(part, results)
                    known.update(r["_key"] for r in part)
        yield pd.DataFrame({"n": pd.Series([len(known)], dtype="int64")})

    todo.repartition(tasks, "_key").mapInPandas(call, "n long").agg(F.sum("n")).collect()
    answers = read()
    # an answer of any run; else the error of this one
    best = F.min_by(F.struct(*fields, ERROR_COL), F.struct(F.col(ERROR_COL).isNotNull(), F.col("_run") != run))
    answers = answers.filter(F.col(ERROR_COL).isNull() | (F.col("_run") == run)).groupBy("_key").agg(best.alias("_a"))
    out = keyed.join(answers, "_key", "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_a.`{f}`").alias(f) for f in fields], F.col(f"_a.{ERROR_COL}").alias(ERROR_COL))


def model_map_distinct(df: DataFrame, fn, in_cols: Sequence[str], out_schema, **kw) -> DataFrame:
    """Call the model once per distinct input (dedupe, call, join back);
    the join is on the input columns themselves, so no row moves to the driver."""
    in_cols = list(in_cols)
    uniq = df.select(*in_cols).dropna().distinct()
    res = model_map(uniq, fn, in_cols, out_schema, keep_cols=in_cols, **kw)
    return df.join(res, in_cols, "left")


# --- deterministic stand-ins for tests and examples (not a model) ---------------------------

def hashed_token_embedding(dim: int = 64) -> Callable[[dict], dict]:
    """Bag of hashed lower-cased tokens, L2-normalised; null text -> null."""
    def embed(row: dict):
        text = row.get("text")
        if text is None:
            return {"embedding": None}
        v = np.zeros(dim)
        for tok in str(text).lower().split():
            h = int.from_bytes(hashlib.blake2b(tok.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1.0 if (h >> 32) & 1 else -1.0
        n = np.linalg.norm(v)
        return {"embedding": (v / n if n else v).tolist()}
    return embed


def letter_count_embedding(letters: str = "aeiou") -> Callable[[dict], dict]:
    """Counts of the given letters and the length: a stand-in simple enough
    to restate in SQL for oracle checks."""
    def embed(row: dict):
        text = row.get("text")
        if text is None:
            return {"embedding": None}
        return {"embedding": [float(text.count(ch)) for ch in letters] + [float(len(text))]}
    return embed


def threshold_judge(threshold: float, score_key: str = "score") -> Callable[[dict], dict]:
    """Stand-in pair judge: same item when the score is at least ``threshold``."""
    return lambda row: {"same_item": bool(row[score_key] >= threshold)}


def token_overlap_judge(min_jaccard: float = 0.5) -> Callable[[dict], dict]:
    """Stand-in pair judge on two texts ``a`` and ``b``: token Jaccard."""
    def judge(row):
        a, b = set(str(row["a"]).lower().split()), set(str(row["b"]).lower().split())
        j = len(a & b) / len(a | b) if a | b else 0.0
        return {"same_item": j >= min_jaccard}
    return judge


def embed_texts(df: DataFrame, text_col: str, fn, dim_type: str = "array<double>", **kw) -> DataFrame:
    """MDL3: embed a rendered text column once per distinct text, join the
    vectors back; a null text gets a null vector (dropped before similarity)."""
    uniq = df.select(F.col(text_col).alias("text")).dropna().distinct()
    res = model_map(uniq, fn, ["text"], f"embedding {dim_type}", keep_cols=["text"], **kw)
    return df.join(res.withColumnRenamed("text", text_col), text_col, "left")
