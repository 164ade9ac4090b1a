"""Records for tests and benchmarks: seeded or computed from their number, never from the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcg(i: Column) -> Column:
    """A fixed 32-bit number for each i."""
    return F.pmod(i * F.lit(1103515245) + F.lit(12345), F.lit(1 << 32))


def generate_u32(spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
    """pos and value (0 to 2**32 - 1): uniform for a seed, else computed from pos."""
    value = lcg(F.col("id")) if seed is None else F.floor(F.rand(seed) * float(1 << 32)).cast("bigint")
    return spark.range(n).select(F.col("id").alias("pos"), value.cast("bigint").alias("value"))


def generate_records(spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
    """pos, id, name and text; name and text count from 1."""
    number = F.col("id") + 1
    key = lcg(number) if seed is None else F.floor(F.rand(seed) * float(1 << 31)).cast("bigint")
    return spark.range(n).select(F.col("id").alias("pos"), key.cast("bigint").alias("id"), F.format_string("Name %03d", number).alias("name"), F.format_string("Text %03d", number).alias("text"))


def field_values(name: str, kind: str, width: int, length: int, spark_type: T.DataType, id: Column, seed: int) -> Column:
    """A field's value for each id: uniform over the kind's bit patterns (reals: over 0 to 1), or its name and number.

    Values are hashes of seed, name and id, so they don't depend on partitions.
    """
    h = F.xxhash64(F.lit(seed), F.lit(name), id)
    if kind.startswith("char"):
        return F.substring(F.format_string("%s %03d", F.lit(name.capitalize()), id + 1), 1, length)
    if kind.startswith("bytes"):
        blocks = [F.unhex(F.sha2(F.concat_ws(":", h.cast("string"), F.lit(str(k))), 256)) for k in range(-(-length // 32))]
        return F.substring(F.concat(*blocks), 1, length)
    if kind == "bool":
        return h.bitwiseAND(F.lit(1)) == 1
    if kind in ("float", "double"):
        return (F.shiftrightunsigned(h, 11) / float(1 << 53)).cast(spark_type)
    if kind == "uint64":
        return (h.cast("decimal(21,0)") + F.when(h < 0, F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(F.lit(0))).cast(spark_type)
    cut = F.shiftrightunsigned if kind.startswith("uint") else F.shiftright
    return cut(h, 64 - 8 * width).cast(spark_type) if width < 8 else h
