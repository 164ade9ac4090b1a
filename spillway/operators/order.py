"""Total order of a dataset: range exchange and sort, and positions without a single-partition window."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spillway.plans.spec import Ordering


def sort(df: DataFrame, ordering: Ordering, strict_empty: bool = False) -> DataFrame:
    """All rows in order. Multiset-preserving; rows of equal keys come by the tie-breakers, or in any order.

    Nothing in, nothing out; with strict_empty that raises, at the price of a look at the input.
    """
    ordering.check(df)
    if strict_empty and df.isEmpty():
        raise ValueError("nothing to sort")
    return df.orderBy(*ordering.sort())


def sort_blocks(df: DataFrame, ordering: Ordering) -> DataFrame:
    """Each partition in order, on its own."""
    ordering.check(df)
    return df.sortWithinPartitions(*ordering.sort())


def with_position(df: DataFrame, ordering: Ordering, name: str = "pos", start: int = 1) -> DataFrame:
    """All rows in order, with their position in it.

    The rows before each partition are counted, so nothing but the counts goes to one task. The sorted rows are persisted:
    counts and positions must see the same partitions. Their ranges are kept with the lineage, so a lost part is made
    again alike as long as the ordering is total.
    """
    ordering.check(df)
    columns = df.columns
    ranked = df.orderBy(*ordering.sort()).select(*columns, F.spark_partition_id().alias("_sw_part"), F.monotonically_increasing_id().alias("_sw_id"))
    ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
    counts = ranked.groupBy("_sw_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_sw_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = counts.select(F.col("_sw_part").alias("_sw_at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_sw_before"))
    inside = F.col("_sw_id") - F.shiftleft(F.col("_sw_part").cast("bigint"), 33)
    joined = ranked.join(F.broadcast(offsets), F.col("_sw_part") == F.col("_sw_at"))
    return joined.select(*columns, (F.col("_sw_before") + inside + start).cast("bigint").alias(name))


def with_rank(df: DataFrame, ordering: Ordering, name: str = "rnk") -> DataFrame:
    """All rows with the position of the first row of equal keys: the same for any order of ties."""
    keys = [k.column for k in ordering.keys]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_sw_n"))
    # Distinct keys are ordered; their sums of counts are the ranks.
    placed = with_position(counts, Ordering(ordering.keys), "_sw_pos")
    chunk = F.floor(F.col("_sw_pos") / 65536)
    placed = placed.withColumn("_sw_chunk", chunk)
    totals = placed.groupBy("_sw_chunk").agg(F.sum("_sw_n").alias("n"))
    before = Window.orderBy("_sw_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_sw_chunk").alias("_sw_c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_sw_before"))
    within = Window.partitionBy("_sw_chunk").orderBy("_sw_pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(offsets, F.col("_sw_chunk") == F.col("_sw_c")).select(
        *[F.col(k).alias(f"_sw_{k}") for k in keys], (F.col("_sw_before") + F.coalesce(F.sum("_sw_n").over(within), F.lit(0)) + 1).cast("bigint").alias(name)
    )
    on = [F.col(k).eqNullSafe(F.col(f"_sw_{k}")) for k in keys]
    return df.join(ranked, on).select(*df.columns, name)
