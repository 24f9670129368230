"""Row numbers and neighbours inside groups of any size.

A window over one key sorts the whole group in one task. Here every group is cut into blocks of the
ordering column first, so a task never holds more than one block; only one row per block takes part in
the second, per-group step. The results are exactly those of ``row_number`` and ``lag``. The ordering
column is an integer whose values repeat at most a few times within a group; ``ties`` order the repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullwise.session import written

BLOCK = 65536


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))


def numbered(df: DataFrame, keys: list[str], order: str, out: str = "n", start: int = 1, block: int = BLOCK,
             ties: tuple[str, ...] = (), totals: dict[str, Column] | None = None) -> DataFrame:
    """Adds the position of each row within its group, in order; ``totals`` adds, per name, the sum of an
    expression over the rows before."""
    totals = totals or {}
    rows = _blocked(df, order, block).withColumns({f"_w_{k}": c.cast("bigint") for k, c in totals.items()})
    sums = {"_before": F.lit(1), **{f"_w_{k}": F.col(f"_w_{k}") for k in totals}}
    sizes = rows.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"{n}_size") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", *[F.coalesce(F.sum(f"{n}_size").over(before), F.lit(0)).alias(f"{n}_off") for n in sums])
    inside = Window.partitionBy(*keys, "_block").orderBy(order, *ties)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"_within": F.row_number().over(inside), **{
        f"_in_{k}": F.coalesce(F.sum(f"_w_{k}").over(earlier), F.lit(0)) for k in totals}}).join(offsets, [*keys, "_block"])
    added = {out: (F.col("_within") + F.col("_before_off") + (start - 1)).cast("bigint"),
             **{k: F.col(f"_in_{k}") + F.col(f"_w_{k}_off") for k in totals}}
    return placed.withColumns(added).drop("_block", "_within", "_before_off", *[f"_w_{k}" for k in totals],
                                          *[f"_in_{k}" for k in totals], *[f"_w_{k}_off" for k in totals])


def with_previous(df: DataFrame, keys: list[str], order: str, value: str, out: str, position: str | None = None,
                  block: int = BLOCK) -> DataFrame:
    """Adds the value of the row before (null for the first), and optionally the position from zero."""
    rows = _blocked(df, order, block)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    ends = rows.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"), F.count(F.lit(1)).alias("_size"))
    across = Window.partitionBy(*keys).orderBy("_block")
    heads = ends.select(*keys, "_block", F.lag("_last").over(across).alias("_carried"), F.coalesce(
        F.sum("_size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = rows.withColumns({"_n": F.row_number().over(inside), "_prev": F.lag(value).over(inside)}).join(
        heads, [*keys, "_block"])
    joined = joined.withColumn(out, F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_prev")))
    if position is not None:
        joined = joined.withColumn(position, (F.col("_before") + F.col("_n") - 1).cast("bigint"))
    return joined.drop("_block", "_n", "_prev", "_carried", "_before")


def in_read_order(rows: DataFrame, file: str, block: str, place: str, out: str = "row_ix") -> DataFrame:
    """Numbers rows from 0 in the order of files, blocks within them, and places within blocks, however the files were split.

    place: consecutive within a block, as ``monotonically_increasing_id`` gives it at the scan; the rows have to be written, so that it
    stays. Rows are never moved for it: block sizes are added up within a file and file sizes across files, one row a block and a file."""
    blocks = rows.groupBy(file, block).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    earlier = Window.unboundedPreceding, -1
    files = blocks.groupBy(file).agg(F.sum("_n").alias("_n")).select(
        file, F.coalesce(F.sum("_n").over(Window.orderBy(file).rowsBetween(*earlier)), F.lit(0)).alias("_files"))
    offsets = blocks.withColumn("_blocks", F.coalesce(F.sum("_n").over(Window.partitionBy(file).orderBy(block).rowsBetween(*earlier)), F.lit(0))).join(
        files, file).select(file, block, (F.col("_files") + F.col("_blocks") - F.col("_first")).alias("_offset"))
    return rows.join(offsets, [file, block]).withColumn(out, (F.col("_offset") + F.col(place)).cast("bigint")).drop("_offset")


def sequenced(rows: DataFrame, *order: Column | str, out: str = "seq", start: int = 0) -> DataFrame:
    """Numbers all rows in an order: dealt out by ranges, placed within them, and numbered from the sizes of the ranges before."""
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_file": F.lit(0), "_block": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ordered")
    return in_read_order(dealt, "_file", "_block", "_place", out).withColumn(out, F.col(out) + start).drop("_file", "_block", "_place")
