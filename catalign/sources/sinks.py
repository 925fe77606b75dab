"""Sinks (SNK1-SNK6): parquet / CSV writes, skip-if-exists, resumable
chunked runs, processed-key logs and the wide score-matrix export."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """SNK1."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """SNK1 for tables that are joined again and again: parquet at ``path``,
    bucketed and sorted by ``keys``, entered in the catalog as ``table``.
    Tables bucketed alike by their join keys join without an exchange.  Choose
    ``buckets`` so that one bucket of the largest table is some hundred MB;
    the rows of a bucket come as one file, whatever task they were in."""
    df = df.repartition(buckets, *keys)  # as bucketing hashes: one file a bucket
    (df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return df.sparkSession.table(table)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """SNK2: CSV with header; e.g. extracted tables with their caption as a
    column, partitioned by document and table."""
    w = df.write.mode(mode).option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def output_exists(spark: SparkSession, path: str) -> bool:
    """The path exists (Hadoop FileSystem: local, HDFS, object stores alike).
    Any error reading the store counts as absent."""
    try:
        fs, p = _fs_path(spark, path)
        return bool(fs.exists(p))
    except Exception:  # noqa: BLE001
        return False


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)


#: The file that names the published version of an output.
MANIFEST = "_manifest.json"


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the output at ``path``; ``None`` where nothing was published."""
    if not output_exists(spark, f"{path}/{MANIFEST}"):
        return None
    fs, p = _fs_path(spark, f"{path}/{MANIFEST}")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write beside, then rename over: a reader sees the old manifest or the new one."""
    fs, staged = _fs_path(spark, f"{path}/{MANIFEST}.{uuid.uuid4().hex}")
    stream = fs.create(staged, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(staged, _fs_path(spark, f"{path}/{MANIFEST}")[1], options)


def commit_output(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> dict:
    """SNK1 + SNK3: write a new version of the output and publish it.

    The rows go to a folder of their own under ``path``; then a table of its
    files and their row counts is written, and the manifest that names both
    replaces the one before.  Until then readers see the version before, or
    none: a write that broke off is never taken for an output.  Versions that
    no manifest names are deleted by the next commit."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    data, files = f"{path}/data-{version}", f"{path}/files-{version}"
    write_parquet(df, data, "errorifexists", partition_by)
    written = spark.read.schema(df.schema).parquet(data)
    per_file = written.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    per_file.write.parquet(files)
    size = spark.read.parquet(files).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    manifest = {"version": version, "files": size["files"], "rows": size["rows"], "schema": df.schema.jsonValue()}
    _put_manifest(spark, path, manifest)
    fs, root = _fs_path(spark, path)
    for found in fs.listStatus(root):
        name = found.getPath().getName()
        if name != MANIFEST and not name.endswith(version):
            fs.delete(found.getPath(), True)
    return manifest


def read_committed(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The published version of an output.  ``verify`` counts its rows file by
    file and compares them with those that were published."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    data = spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(f"{path}/data-{manifest['version']}")
    if verify:
        now = data.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        there = spark.read.parquet(f"{path}/files-{manifest['version']}")
        lost = there.join(now, ["file", "rows"], "left_anti").first()
        if lost is not None or now.count() != manifest["files"]:
            raise ValueError(f"the files at {path} are not those that were published" + (f": {lost['file']} held {lost['rows']} rows" if lost else ""))
    return data


def run_unless_exists(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                      overwrite: bool = False, partition_by: Sequence[str] = ()) -> bool:
    """SNK3: compute and publish only when no output was published at
    ``path`` (or ``overwrite``).  The test runs *before* computing, so finished
    work is skipped, not only the write; what a broken run left behind does
    not count.  Returns True when it ran; ``read_committed`` reads the output."""
    if read_manifest(spark, path) is not None and not overwrite:
        return False
    commit_output(compute(), path, partition_by)
    return True


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equal keys of two aliased tables, where a null equals a null."""
    return functools.reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys])


def _without(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left_anti") -> DataFrame:
    return df.alias("_l").join(other.select(*keys).alias("_r"), same_keys("_l", "_r", keys), how)


def content_digest(df: DataFrame) -> Column:
    """Hash of a row's whole content, by column name."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])


#: Folders of a chunked output; more chunks share them.
MAX_FOLDERS = 256


def _any_folder(spark: SparkSession, paths: Sequence[str]) -> bool:
    """One of the folders is there.  An error reading the store is raised: it must not pass for an absent folder."""
    return any(fs.exists(p) for fs, p in (_fs_path(spark, path) for path in paths))


def replace_rows(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], todo: DataFrame, current: DataFrame,
                 chunks: DataFrame, name: str, per: int = 1) -> None:
    """Rewrite the ``chunks`` of an output: ``new`` rows, and of the rows
    that are there those whose key is in ``current`` and not in ``todo``.
    ``per`` successive chunks share a folder, each folder written as one file
    then; rows of the other chunks of a folder stay as they are."""
    from ..session import materialize
    at = name if per == 1 else f"{name}_folder"
    placed = lambda df: df if per == 1 else df.withColumn(at, F.floor(F.col(name) / per).cast("long"))
    folders, new = placed(chunks).select(at).distinct(), placed(new)
    write = lambda df: (df if per == 1 else df.repartition(at)).write.mode("overwrite").option(  # noqa: E731  (else every task would write a file in every folder)
        "partitionOverwriteMode", "dynamic").partitionBy(at).parquet(path)
    if not _any_folder(spark, [f"{path}/{at}={folder}" for (folder,) in folders.collect()]):
        write(new)  # nothing to keep and none to delete: the rows are computed and written once
        return
    if output_exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).join(folders, at, "left_semi").select(*new.columns)
        kept = _without(_without(old.join(chunks, name, "left_semi"), todo, keys), current, keys, "left_semi")
        new = kept.select(*new.columns).unionByName(new)
        if per > 1:
            new = new.unionByName(old.join(chunks, name, "left_anti").select(*new.columns))
    new = materialize(new)
    write(new)
    for (folder,) in folders.join(new.select(at).distinct(), at, "left_anti").collect():  # those that have no rows any more
        delete_path(spark, f"{path}/{at}={folder}")


def _chunks_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Chunks that an output has rows of."""
    return spark.read.parquet(path).select(F.col(name).cast("long").alias(name)).distinct()


def run_chunks(spark: SparkSession, items: DataFrame, keys: Sequence[str], chunk_size: int, path: str,
               compute: Callable[[DataFrame], DataFrame], chunk_start: int | None = None,
               chunk_end: int | None = None, overwrite: bool = False, name: str = "chunk",
               then: Callable[[DataFrame, DataFrame, DataFrame, int], None] | None = None) -> DataFrame:
    """SNK4: resumable run over an input that may change between runs.

    A row's chunk is a hash of its key, so it does not depend on the other
    rows.  A ledger beside the output (``<path>__done``) holds the key and
    content digest of every row done; a run computes the rows that are not in
    it -- new or changed ones -- and nothing else, and rows that left the
    input leave the output.  Only folders of chunks with such rows are
    rewritten; a chunk is a folder, but more than ``MAX_FOLDERS`` chunks share
    that many folders.  Only chunks in ``[chunk_start, chunk_end)`` run;
    ``overwrite`` computes all of their rows again.  ``compute`` must keep
    the keys and the chunk column; it may return several rows a key, or none.

    ``then(todo, current, chunks, per)`` writes further outputs (with
    ``replace_rows``, ``per`` chunks a folder).  The ledger is written last, so a run that broke off
    anywhere is repeated and replaces what it left.  Keys must be unique (a
    null is a key like any other).  The number of chunks is that of the first
    run's rows by ``chunk_size``; size them to 1e5-1e6 rows at scale.  Returns
    the table of chunk ids that ran."""
    from ..operators.checks import assert_unique
    from ..session import materialize
    keys, ledger = list(keys), f"{path}__done"
    assert_unique(items, keys)
    done = spark.read.parquet(ledger) if output_exists(spark, ledger) else None
    n = (done.agg(F.max("_chunks")).first()[0] if done is not None else None) or max(1, -(-items.count() // chunk_size))
    per = -(-n // MAX_FOLDERS)
    part = lambda df: df.filter((F.col(name) >= (chunk_start or 0)) & (F.col(name) < (n if chunk_end is None else chunk_end)))
    tagged = items.withColumn("_digest", content_digest(items)).withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("long"))
    tagged = materialize(part(tagged))
    if done is not None:
        # a chunk that had rows and is not there any more was lost, and counts as not done
        there = (_chunks_of(spark, path, name) if output_exists(spark, path) else done.select(name).limit(0)).withColumn("_there", F.lit(True))
        done = part(done).join(there, name, "left").filter(F.col("_there") | ~F.col("_has_rows"))
        done = materialize(done.select(*keys, "_digest", name))
    todo = tagged if done is None or overwrite else materialize(_without(tagged, done, [*keys, "_digest"]))
    touched = todo.select(name)
    if done is not None:
        touched = touched.unionByName(_without(done, tagged, keys).select(name))
    chunks = materialize(touched.distinct())
    if chunks.isEmpty():
        return chunks
    # rows may only have left the input: then there is nothing to compute
    gone = todo.isEmpty() and output_exists(spark, path)
    out = spark.read.parquet(path).withColumn(name, F.col(name).cast("long")).drop(*[f"{name}_folder"] * (per > 1)).limit(0) if gone else compute(todo.drop("_digest"))
    if missing := {*keys, name} - set(out.columns):
        raise ValueError(f"compute() must keep the columns {sorted(missing)}")
    replace_rows(spark, path, out, keys, todo, tagged, chunks, name, per)
    if then is not None:
        then(todo, tagged, chunks, per)
    has_rows = _chunks_of(spark, path, name).withColumn("_has_rows", F.lit(True))
    entries = tagged.join(chunks, name, "left_semi").join(has_rows, name, "left").select(
        *keys, "_digest", F.lit(n).cast("long").alias("_chunks"), F.coalesce("_has_rows", F.lit(False)).alias("_has_rows"), name)
    replace_rows(spark, ledger, entries, keys, entries, tagged, chunks, name, per)
    return chunks


def process_new_keys(spark: SparkSession, items: DataFrame, key: Sequence[str] | str, log_path: str,
                     compute: Callable[[DataFrame], DataFrame], out_path: str) -> int:
    """SNK5: process only keys not yet in the log; a null key is a key like
    any other.  A run writes its output and then its keys as the next batch,
    each a folder that is replaced as a whole: a run that failed between the
    two is repeated under the same number and leaves no duplicate.  Returns
    the number of new rows."""
    from ..operators.reshape import pivot_names
    from ..session import materialize
    keys = [key] if isinstance(key, str) else list(key)
    todo, batch = items, 0
    if output_exists(spark, log_path):
        log = spark.read.parquet(log_path)
        todo = _without(items, log, keys)
        batch = max(pivot_names(log, "batch"), default=-1) + 1
    todo = materialize(todo)
    n = todo.count()
    if n == 0:
        return 0
    compute(todo).write.mode("overwrite").parquet(f"{out_path}/batch={batch}")
    todo.select(*keys).distinct().write.mode("overwrite").parquet(f"{log_path}/batch={batch}")
    return n


def dedupe_names(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """SNK6 naming rule: repeated names get ``_1, _2, ..`` in order, the
    first keeps its name."""
    from ..operators.tables import rank_within
    ranked = rank_within(df, [name], list(order), "_rank")
    again = F.concat(F.col(name), F.lit("_"), (F.col("_rank") - 1).cast("string"))
    return ranked.withColumn(name, F.when(F.col("_rank") > 1, again).otherwise(F.col(name))).drop("_rank")


def wide_matrix(pairs: DataFrame, row: str, col: str, value: str, col_order: Sequence[str] | None = None) -> DataFrame:
    """SNK6: long pairs -> wide matrix (one column per ``col`` name, all of
    them).  Column names must already be unique (``dedupe_names``)."""
    from ..operators.reshape import pivot_names
    names = list(col_order) if col_order is not None else pivot_names(pairs, col)
    return pairs.groupBy(row).pivot(col, names).agg(F.first(value)) if names else pairs.select(row).distinct()


def matrix_blocks(pairs: DataFrame, row: str, col: str, value: str, width: int = 1_000) -> DataFrame:
    """SNK6 for any number of columns: ``(row, block, names, values)``, each
    block holding the next ``width`` columns in the order of their names,
    with null where a row has no value.  Column numbers come from a sorted
    table of names, so neither the driver nor one row holds all columns."""
    from ..operators.tables import with_row_index
    names = with_row_index(pairs.select(F.col(col).alias("_name")).dropna().distinct(), ["_name"], "_at")
    heads = names.groupBy(F.floor(F.col("_at") / width).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_name"))), lambda h: h["_name"]).alias("names"))
    cells = pairs.select(F.col(row).alias("row"), F.col(col).alias("_name"), F.col(value).alias("_value")).join(names, "_name")
    cells = cells.groupBy("row", F.floor(F.col("_at") / width).alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("_at") % width).alias("at"), "_value"))).alias("_cells"))
    full = cells.join(heads, "block")
    # the columns of a block are numbered without gaps, so a name's place is its number in the block
    return full.select("row", "block", "names", F.transform("names", lambda _, i: F.try_element_at("_cells", i.cast("long"))).alias("values"))
