"""Run formation: consecutive records form blocks, each sorted on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.plans.spec import Ordering


def run_name(prefix: Column | str, run: Column, suffix: str = "split") -> Column:
    """prefix.suffix.001 and so on; wider past 999."""
    return F.format_string(f"%s.{suffix}.%03d", F.lit(prefix) if isinstance(prefix, str) else prefix, run)


def split(df: DataFrame, position: Column | str, block_records: int, ordering: Ordering, in_run: str = "pos_in_run") -> DataFrame:
    """df with run_id (from 1) and the position in the sorted run (from 1); `position` counts records from 0.

    Runs are as large as a block, so their windows are bounded.
    """
    if block_records < 1:
        raise ValueError("block_records must be at least 1")
    ordering.check(df)
    position = F.col(position) if isinstance(position, str) else position
    runs = df.withColumn("run_id", (F.floor(position / block_records) + 1).cast("bigint"))
    within = Window.partitionBy("run_id").orderBy(*ordering.sort())
    return runs.withColumn(in_run, F.row_number().over(within).cast("bigint"))


def manifest(runs: DataFrame, prefix: str, key: str) -> DataFrame:
    """A row per run, in order of run_id: file name, records, smallest and largest key."""
    return runs.groupBy("run_id").agg(F.count("*").alias("elems"), F.min(key).alias("vmin"), F.max(key).alias("vmax")).select("run_id", run_name(prefix, F.col("run_id")).alias("fname"), "elems", "vmin", "vmax")


def write_runs(runs: DataFrame, path: str) -> None:
    """One folder per run (run_id=...), its records in order."""
    parts = runs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    runs.repartition(int(parts), "run_id").sortWithinPartitions("run_id", "pos_in_run").write.partitionBy("run_id").parquet(path)


def read_run(spark: SparkSession, path: str, run: int) -> DataFrame:
    return spark.read.parquet(f"{path}/run_id={run}")
