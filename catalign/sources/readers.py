"""Sources (SRC1-SRC8): parquet, CSV, nested JSON, sheet rows, binary files,
literal dimensions.  Explicit schemas for text formats; NaN -> null at ingest."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.columns import nan_to_null
from ..operators.joins import union_all


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                 merge_schema: bool = False) -> DataFrame:
    """SRC1/SRC2/SRC3: one file or a directory of chunk files; ``columns``
    prunes the scan (Catalyst pushes it into the reader)."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(*paths)
    if columns is not None:
        df = df.select(*columns)
    return nan_to_null(df)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
             keep_empty_strings: bool = False) -> DataFrame:
    """SRC4: CSV with a header and an explicit schema.  With
    ``keep_empty_strings`` an empty field stays ``''`` instead of null
    (pandas ``keep_default_na=False``)."""
    r = spark.read.schema(schema).option("header", str(header).lower()).option("mode", "FAILFAST")
    df = nan_to_null(r.csv(path))
    return _empty_strings(df) if keep_empty_strings else df


def _empty_strings(df: DataFrame) -> DataFrame:
    """A CSV can only say "missing" with an empty field; keep it as ``''``."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.fillna("", subset=cols) if cols else df


def read_nested_json(spark: SparkSession, path: str, array_field: str,
                     schema: T.StructType | str | None = None, multiline: bool = True) -> DataFrame:
    """SRC5: a JSON document holding an array of records -> one row per
    record, struct fields lifted to columns (dotted names kept as paths)."""
    r = spark.read.option("multiLine", str(multiline).lower())
    if schema is not None:
        r = r.schema(schema)
    doc = r.json(path)
    return doc.select(F.explode(array_field).alias("_r")).select("_r.*")


def read_sheet_rows(spark: SparkSession, path: str, n_columns: int | None = None,
                    keep_empty_strings: bool = True) -> DataFrame:
    """SRC6: rows of a sheet exported as a headerless CSV, all strings, with
    the row position ``_idx`` (0-based, file order) for header promotion.  A
    quoted cell may hold line ends, so a file is read as a whole by one task."""
    from ..operators.tables import with_row_index
    r = spark.read.option("header", "false").option("multiLine", "true").option("escape", '"')
    if n_columns is not None:
        r = r.schema(T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(n_columns)]))
    rows = r.csv(path)
    if keep_empty_strings:
        rows = _empty_strings(rows)
    rows = rows.withColumn("_file", F.input_file_name()).withColumn("_mono", F.monotonically_increasing_id())
    return with_row_index(rows, ["_file", "_mono"], "_idx").drop("_file", "_mono")


def read_binary_files(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """SRC7: binary files matching ``glob`` -> ``(path, name, payload_b64)``."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    # Spark breaks base64 into lines; a payload is one line
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                     F.translate(F.base64("content"), "\r\n", "").alias("payload_b64"))


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """SRC8: a literal dimension table (codes kept as zero-padded strings)."""
    return spark.createDataFrame(list(rows), schema)


# --- chunk files whose schemas differ (SRC2) --------------------------------------------------

# types in which every value of the ones before it is exact, by family; a file
# of an earlier type widens to a later one
_WIDER = (["tinyint", "smallint", "int", "bigint", "decimal(20,0)"], ["tinyint", "smallint", "int", "double"], ["float", "double"], ["date", "timestamp"])


def wider_type(a: str, b: str) -> str | None:
    """The narrowest type that holds all values of both, ``None`` if there is
    none.  ``void`` (a column that a file knows only as null) widens to any;
    a long meets a double as a double, as in a table that was read in one go."""
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    if {a, b} <= {"bigint", "float", "double"}:
        return "double"
    for family in _WIDER:
        if a in family and b in family:
            return max(a, b, key=family.index)
    return None


def file_schemas(spark: SparkSession, path: str) -> DataFrame:
    """``(file, name, type)`` of every column of every parquet file below
    ``path``, from the files' footers; no data is read.  The files are listed
    by Spark and their footers read by the tasks, so ``path`` has to be on a
    store that Arrow's file systems know (local, HDFS, S3, GCS)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file"))

    def footers(batches):
        for pdf in batches:
            rows = []
            for file in pdf["file"]:
                store, name = pafs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file)
                with store.open_input_file(name) as f:
                    schema = from_arrow_schema(pq.read_schema(f))
                rows += [(file, c.name, c.dataType.simpleString()) for c in schema.fields]
            yield pd.DataFrame(rows, columns=["file", "name", "type"])

    return files.mapInPandas(footers, "file string, name string, type string")


def widened_schema(schemas: DataFrame) -> T.StructType:
    """One schema for all files: columns in the order of their names' first
    file, each in the narrowest type that holds every file's values.  A column
    whose types have none is an error that names two of its files."""
    types = schemas.groupBy("name", "type").agg(F.min("file").alias("file")).orderBy("file", "name").collect()  # one row per column and type
    plan: dict[str, tuple[str, str]] = {}
    for r in types:
        kind, first = plan.get(r["name"], (r["type"], r["file"]))
        wide = wider_type(kind, r["type"])
        if wide is None:
            raise ValueError(f"column {r['name']!r} is {kind} in {first} and {r['type']} in {r['file']}")
        plan[r["name"]] = (wide, first if wide == kind else r["file"])
    return T.StructType([T.StructField(n, T._parse_datatype_string(kind if kind != "void" else "string")) for n, (kind, _) in plan.items()])


def read_chunk_files(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SRC2: all chunk files below ``path`` as one table, whatever generation
    of the writer they are from: columns widen (``widened_schema``), those that
    a file lacks are null.  Files of one schema are one scan, so pruning and
    pushdown work as ever."""
    schemas = file_schemas(spark, path)
    schema = widened_schema(schemas)
    # one row per generation: its columns, and its files (Spark's scan needs their names)
    generation = schemas.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("columns"))
    frames = []
    for g in generation.groupBy("columns").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy(F.get("files", F.lit(0))).collect():
        have = {c["name"]: c["type"] for c in g["columns"] if c["type"] != "void"}
        own = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in have.items()])
        df = spark.read.schema(own).parquet(*g["files"])
        frames.append(df.select(*[(F.col(f"`{c.name}`") if c.name in have else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema]))
    if not frames:
        raise FileNotFoundError(f"no parquet file below {path}")
    df = union_all(frames)
    return nan_to_null(df.select(*columns) if columns is not None else df)

