"""Is a dataset in order? Counts, violations, extremes, ends, and a fingerprint; all spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spillway.plans.spec import Ordering

#: Positions of a stretch that is checked by one window.
STRETCH = 1 << 20


def _stretches(df: DataFrame, ordering: Ordering, position: str, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with their predecessor in their stretch, and a row per stretch with its ends."""
    rows = df.withColumn("_sw_stretch", F.floor(F.col(position) / STRETCH))
    within = Window.partitionBy("_sw_stretch").orderBy(position)
    columns = [*(k.column for k in ordering.keys), *more]
    rows = rows.select("_sw_stretch", position, *columns, F.lag(F.struct(*columns)).over(within).alias("_sw_prev"), (F.row_number().over(within) - 1).cast("bigint").alias("_sw_i"))
    ends = rows.groupBy("_sw_stretch").agg(F.count("*").alias("n"), F.min_by(F.struct(*columns), position).alias("first"), F.max_by(F.struct(*columns), position).alias("last"))
    # A row per stretch: one window over all of them is small.
    order = Window.orderBy("_sw_stretch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_sw_stretch", "first", F.lag("last").over(order).alias("carried"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows, ends


def _violations(df: DataFrame, ordering: Ordering, position: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Every row, with idx (from 0), prev, cur and whether it comes before its predecessor."""
    rows, ends = _stretches(df, ordering, position, more)
    columns = [*(k.column for k in ordering.keys), *more]
    ends = ends.withColumnRenamed("_sw_stretch", "_sw_s")
    both = rows.join(ends, F.col("_sw_stretch") == F.col("_sw_s"))
    prev = F.coalesce("_sw_prev", F.when(F.col("_sw_i") == 0, F.col("carried")))
    both = both.select((F.col("offset") + F.col("_sw_i")).alias("idx"), prev.alias("prev"), F.struct(*columns).alias("cur"))
    bad = F.col("prev").isNotNull() & ordering.before(lambda c: F.col(f"cur.{c}"), lambda c: F.col(f"prev.{c}"))
    return both.withColumn("bad", bad)


def check(df: DataFrame, ordering: Ordering, position: str) -> DataFrame:
    """One row: sorted, elems, bad, vmin, vmax, vfirst, vlast; in the order of the column `position` (unique numbers).

    bad counts rows that come strictly before their predecessor. An empty dataset is sorted and has no values. With one
    key the values are its own, else structs of all keys.
    """
    ordering.check(df)
    rows = _violations(df, ordering, position)
    value = F.col("cur." + ordering.keys[0].column) if len(ordering.keys) == 1 else F.col("cur")
    least, most = (F.min, F.max) if not ordering.keys[0].descending else (F.max, F.min)
    return rows.agg(
        (F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)) == 0).alias("sorted"),
        F.count("*").alias("elems"),
        F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("bad"),
        least(value).alias("vmin"),
        most(value).alias("vmax"),
        F.min_by(value, "idx").alias("vfirst"),
        F.max_by(value, "idx").alias("vlast"),
    )


def first_violations(df: DataFrame, ordering: Ordering, position: str, n: int = 10, shown: Column | None = None) -> DataFrame:
    """The first n rows out of order: idx (from 0, of the later row), prev and cur: the keys, or `shown` of their rows."""
    if shown is not None:
        rows = _violations(df.withColumn("_sw_shown", shown), ordering, position, ("_sw_shown",)).where("bad")
        return rows.orderBy("idx").limit(n).select("idx", F.col("prev._sw_shown").alias("prev"), F.col("cur._sw_shown").alias("cur"))
    rows = _violations(df, ordering, position).where("bad")
    part = lambda c: F.col(f"{c}.{ordering.keys[0].column}") if len(ordering.keys) == 1 else F.col(c)
    return rows.orderBy("idx").limit(n).select("idx", part("prev").alias("prev"), part("cur").alias("cur"))


def fingerprint(df: DataFrame) -> DataFrame:
    """elems and an order-independent hash: the same for any permutation of the same rows."""
    h: Column = F.xxhash64(*[F.col(c) for c in df.columns])
    half = lambda c: F.coalesce(F.sum(c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string")
    return df.agg(F.count("*").alias("elems"), F.concat_ws(":", half(h), half(F.shiftrightunsigned(h, 32))).alias("hash"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether b is a permutation of a (by fingerprint)."""
    return fingerprint(a).first() == fingerprint(b).first()
