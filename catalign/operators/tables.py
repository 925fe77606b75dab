"""Table-shaped text and sheet rows: markdown cells (STR3), header promotion
(PRJ9), metadata transpose (PRJ10), positional slices (PRJ11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# a markdown separator line: only pipes, colons, dashes and blanks, with a dash
_SEPARATOR = r"^[\s|:]*-[\s|:\-]*$"


def markdown_cells(df: DataFrame, doc: str, text: str) -> DataFrame:
    """STR3: markdown tables in a text column -> long cells
    ``(doc, row, col, header, value)``.

    Line 0 is the header, separator lines are dropped, cells are split on
    ``|`` and trimmed, the outer empty cells of ``| a | b |`` are removed,
    and a column whose data cells are all empty is dropped (per document).
    Rows are numbered from 1 among the data lines.  All in one row: the lines
    stay an array until one explode at the end.
    """
    keep = lambda l: (F.trim(l) != "") & ~l.rlike(_SEPARATOR)
    # an outer empty cell of a line stands for no cell: its place is null
    cells_of = lambda l: F.transform(F.split(F.trim(l), r"\|"), lambda c: F.trim(c))
    inner = lambda cells: F.transform(cells, lambda c, i: F.when((c == "") & ((i == 0) | (i == F.size(cells) - 1)), None).otherwise(c))
    # each step's array is read several times below: explode of a one-element array keeps it computed once
    once = lambda df, value, name: df.select("*", F.explode(F.array(value)).alias(name))
    rows = once(df.select(F.col(doc).alias("doc"), F.col(text).alias("_text")), F.filter(F.split("_text", "\n"), keep), "_lines").drop("_text")
    rows = once(rows.filter(F.size("_lines") > 1), F.transform("_lines", cells_of), "_split").drop("_lines")
    rows = once(rows, F.transform("_split", inner), "_cells").drop("_split")
    rows = rows.select("doc", F.get("_cells", F.lit(0)).alias("_head"), F.slice("_cells", F.lit(2), F.size("_cells")).alias("_data"))
    rows = once(rows, F.col("_data"), "_rows").drop("_data")
    places = F.flatten(F.transform("_rows", lambda r: F.transform(r, lambda c, i: F.when(c != "", i))))
    rows = once(rows, F.array_distinct(F.array_compact(places)), "_used")
    line = rows.select("doc", "_head", "_used", F.posexplode("_rows").alias("_row", "_line"))
    cell = line.select("doc", "_head", "_used", (F.col("_row") + 1).alias("row"), F.posexplode("_line").alias("col", "value"))
    return cell.filter(F.col("value").isNotNull() & F.array_contains("_used", F.col("col"))).select(
        "doc", "row", "col", F.get("_head", F.col("col")).alias("header"), "value")


def quoted(name: str):
    """Column reference for any name (dots, spaces, backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def promote_header(rows: DataFrame, index_col: str, header_row: int, columns: Sequence[str]) -> DataFrame:
    """PRJ9: row ``header_row`` holds the column names; rows above it and the
    header itself are dropped, newlines are removed from the names.

    ``rows`` carries a row index column (set at ingest, e.g. from the file
    line number); only the one header row is brought to the driver.
    """
    head = rows.filter(F.col(index_col) == header_row).select(*columns).first()
    if head is None:
        raise ValueError(f"no row {header_row}")
    names = [(str(v) if v is not None else f"col{i}").replace("\n", "") for i, v in enumerate(head)]
    return rows.filter(F.col(index_col) > header_row).select(
        F.col(index_col), *[F.col(c).alias(n) for c, n in zip(columns, names)])


def transpose_rows(rows: DataFrame, index_col: str, keep: Sequence[int], columns: Sequence[str],
                   names: Sequence[str]) -> DataFrame:
    """PRJ10: the rows whose index is in ``keep`` become columns ``names``,
    one output row per input column: ``(column_name, names...)``."""
    sub = rows.filter(F.col(index_col).isin(list(keep)))
    safe = [f"c{i}" for i in range(len(columns))]  # names with dots or spaces are data here
    long = sub.select(index_col, *[quoted(c).cast("string").alias(s) for c, s in zip(columns, safe)]).unpivot(
        [index_col], safe, "_slot", "v")
    slot_names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("_slot", 2, 10).cast("int") + 1)
    long = long.withColumn("column_name", slot_names).drop("_slot")
    wide = long.groupBy("column_name").pivot(index_col, list(keep)).agg(F.first("v"))
    return wide.select("column_name", *[F.col(str(k)).alias(n) for k, n in zip(keep, names)])


def with_row_index(df: DataFrame, order: Sequence[Column | str], name: str = "_idx") -> DataFrame:
    """Global position 0.. under an explicit order (Ord), without a
    single-partition window.

    The range-sorted rows are checkpointed with a per-partition row id,
    partition sizes are counted (one row per partition: a bounded
    broadcast), and the position is the partition's offset plus the row's
    place inside it.
    """
    from ..session import materialize
    pid = F.spark_partition_id().cast("long")
    ordered = materialize(df.orderBy(*order)
                          .withColumn("_pid", pid)
                          .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(pid, 33)))
    sizes = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (ordered.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(name, F.col("_off") + F.col("_local"))
            .drop("_pid", "_local", "_off"))


def row_slice(df: DataFrame, order: Sequence[Column | str], start: int, stop: int,
              name: str = "position") -> DataFrame:
    """PRJ11: rows ``start <= position < stop`` under an explicit order.  Each
    task keeps its first ``stop`` rows; the position is numbered over the
    slice alone."""
    rows = df.orderBy(*order).offset(start).limit(stop - start)
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1 + start)


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``row_number()`` per group under an explicit order, safe for a hot group.

    A window would place a whole group in one task.  Here the rows are
    range-sorted by (group, order) -- the sampler splits a large group over
    many partitions -- and checkpointed with a per-partition row id.  A small
    table of (group, partition) first ids and counts gives each group's offset
    in each partition (it has at most #groups + #partitions rows), and the
    rank is that offset plus the row's place inside its partition.
    """
    from ..session import materialize
    pid = F.spark_partition_id().cast("long")
    ordered = materialize(df.orderBy(*group, *order)
                          .withColumn("_pid", pid)
                          .withColumn("_mono", F.monotonically_increasing_id()))
    stats = ordered.groupBy(*group, "_pid").agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    stats = stats.withColumnsRenamed({c: f"_g_{c}" for c in [*group, "_pid"]})
    same = F.lit(True)
    for c in [*group, "_pid"]:  # a null group ranks like any other
        same = same & ordered[c].eqNullSafe(stats[f"_g_{c}"])
    joined = ordered.join(stats, same).drop(*[f"_g_{c}" for c in [*group, "_pid"]])
    return (joined.withColumn(name, (F.col("_off") + F.col("_mono") - F.col("_first") + 1).cast("int"))
            .drop("_pid", "_mono", "_first", "_off"))
