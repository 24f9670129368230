"""The row after each row in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullwise.llm.common import partitions
from pullwise.session import written

INDEX_BITS = 33         # fixed value: monotonically_increasing_id keeps the place in the partition in its lower 33 bits


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with `rank` from 0: range partitioning, places within partitions, and the sizes of the partitions before."""
    n = partitions(rows.sparkSession)
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = written(ordered, "ordered")
    part = F.shiftright("_place", INDEX_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))      # a row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        "rank", F.col("_before") + F.col("_place").bitwiseAND((1 << INDEX_BITS) - 1)).drop("_part", "_place", "_before")


def followers(rows: DataFrame, columns: list[str], prefix: str, *order: Column) -> DataFrame:
    """The rows with the given columns of the next row in the order (after the last: the first) under prefixed names."""
    numbered = written(ranked(rows, *order), "ranked")
    total = numbered.count()
    if not total:
        return numbered.select("*", *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    following = numbered.select(((F.col("rank") + total - 1) % total).alias("rank"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return numbered.join(following, "rank")
