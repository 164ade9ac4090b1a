"""Queries over the test tables, and the SQL they must agree with."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.functions.generate import generate_records, generate_u32
from spillway.functions.text import memory_text, record_text, value_text
from spillway.operators.merge import merge
from spillway.operators.order import sort_blocks, with_position, with_rank
from spillway.operators.runs import manifest, split, write_runs
from spillway.operators.verify import check, fingerprint, first_violations
from spillway.plans.params import MergeParams
from spillway.plans.spec import Key, Ordering

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _position(sql_order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {sql_order}) AS BIGINT) AS pos"


def _sorted(name: str, table: str, columns: tuple[str, ...] | None, ordering: Ordering, sql_order: str, whole: bool = False) -> None:
    chosen = ", ".join(columns) if columns else "*"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table)
        df = df.select(*columns) if columns else df
        return with_position(df, ordering.over(df) if whole else ordering)

    _add(name, f"SELECT {chosen}, {_position(sql_order)} FROM {table}", run)


_LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
_rest = lambda *used: ", ".join(f"{c} NULLS LAST" for c in _LINEITEM if c not in used)

_sorted("sort_int", "orders", ("o_orderkey", "o_custkey"), Ordering.of("o_custkey", "o_orderkey"), "o_custkey NULLS LAST, o_orderkey NULLS LAST")
_sorted("sort_desc", "orders", ("o_orderkey", "o_totalprice"), Ordering.of("-o_totalprice", "o_orderkey"), "o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST")
_sorted("sort_nulls_first", "orders", ("o_orderkey", "o_orderpriority"), Ordering((Key("o_orderpriority", True, True), Key("o_orderkey"))), "o_orderpriority DESC NULLS FIRST, o_orderkey NULLS LAST")
_sorted("sort_ts", "orders", ("o_orderkey", "o_orderdate"), Ordering.of("o_orderdate", "o_orderkey"), "o_orderdate NULLS LAST, o_orderkey NULLS LAST")
_sorted("sort_string", "part", ("p_partkey", "p_name"), Ordering.of("p_name", "p_partkey"), "p_name NULLS LAST, p_partkey NULLS LAST")
_sorted(
    "sort_composite", "lineitem", None, Ordering.of("l_returnflag", "l_linestatus", "-l_extendedprice"),
    "l_returnflag NULLS LAST, l_linestatus NULLS LAST, l_extendedprice DESC NULLS LAST, " + _rest("l_returnflag", "l_linestatus", "l_extendedprice"), True,
)
_sorted("sort_full_record", "lineitem", None, Ordering.of("l_extendedprice"), "l_extendedprice NULLS LAST, " + _rest("l_extendedprice"), True)

_add(
    "sort_rank_unstable",
    "SELECT o_orderkey, o_custkey, CAST(rank() OVER (ORDER BY o_custkey NULLS LAST) AS BIGINT) AS rnk FROM orders",
    lambda spark, d: with_rank(_table(spark, d, "orders").select("o_orderkey", "o_custkey"), Ordering.of("o_custkey")),
)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return split(orders, "o_orderkey", 1024, Ordering.of("o_totalprice", "o_orderkey"))


_add(
    "split_runs",
    "SELECT o_orderkey, o_totalprice, o_orderkey // 1024 + 1 AS run_id, CAST(row_number() OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_totalprice NULLS LAST, o_orderkey) AS BIGINT) AS pos_in_run FROM orders",
    _runs,
)
_add(
    "split_manifest",
    "SELECT run_id, printf('orders.split.%03d', run_id) AS fname, count(*) AS elems, min(o_totalprice) AS vmin, max(o_totalprice) AS vmax FROM (SELECT o_orderkey // 1024 + 1 AS run_id, o_totalprice FROM orders) GROUP BY run_id",
    lambda spark, d: manifest(_runs(spark, d), "orders", "o_totalprice"),
)


def _sorted_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of like o_orderkey mod 8, each with the positions that sorting within partitions gave its records."""
    orders = _table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.pmod("o_orderkey", F.lit(8)).alias("block"))
    ordered = sort_blocks(orders.repartition("block"), Ordering.of("block", "o_totalprice", "o_orderkey")).withColumn("_at", F.monotonically_increasing_id())
    within = Window.partitionBy("block").orderBy("_at")
    return ordered.select("o_orderkey", "o_totalprice", "block", F.row_number().over(within).cast("bigint").alias("pos_in_block"))


_add(
    "sort_blocks",
    "SELECT o_orderkey, o_totalprice, o_orderkey % 8 AS block, CAST(row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_totalprice NULLS LAST, o_orderkey) AS BIGINT) AS pos_in_block FROM orders",
    _sorted_blocks,
)


def _merged(k: int) -> None:
    ordering = Ordering.of("o_totalprice", "o_orderkey")

    def run(spark: SparkSession, d: str) -> DataFrame:
        orders = _table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.pmod("o_orderkey", F.lit(k)).alias("src"))
        return merge([orders.where(F.col("src") == r) for r in range(k)], ordering, "pos")

    _add(f"merge_{k}", f"SELECT o_orderkey, o_totalprice, o_orderkey % {k} AS src, {_position('o_totalprice NULLS LAST, o_orderkey')} FROM orders", run)


for _k in (1, 2, 3, 4, 7):
    _merged(_k)


def _checked(name: str, table: str, position: str, key: str, where: str = "TRUE") -> None:
    sql = f"""
    SELECT coalesce(sum(CAST(cur < prev AS BIGINT)), 0) = 0 AS sorted, count(*) AS elems, CAST(coalesce(sum(CAST(cur < prev AS BIGINT)), 0) AS BIGINT) AS bad,
      min(cur) AS vmin, max(cur) AS vmax, min(CASE WHEN rn = 1 THEN cur END) AS vfirst, min(CASE WHEN nxt IS NULL THEN cur END) AS vlast
    FROM (SELECT {key} AS cur, lag({key}) OVER w AS prev, lead({position}) OVER w AS nxt, row_number() OVER w AS rn FROM {table} WHERE {where} WINDOW w AS (ORDER BY {position}))
    """
    _add(name, sql, lambda spark, d: check(_table(spark, d, table).where(where), Ordering.of(key), position))


_checked("check_bad", "orders", "o_orderkey", "o_totalprice")
_checked("check_good", "orders", "o_orderkey", "o_orderkey")
_checked("check_ts", "events", "event_id", "ts")
_checked("check_empty", "orders", "o_orderkey", "o_totalprice", "o_orderkey < 0")
_checked("check_single", "orders", "o_orderkey", "o_totalprice", "o_orderkey = 5")
_add(
    "check_first10",
    "SELECT idx, prev, cur FROM (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS idx, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS prev, o_totalprice AS cur FROM orders) WHERE cur < prev ORDER BY idx LIMIT 10",
    lambda spark, d: first_violations(_table(spark, d, "orders"), Ordering.of("o_totalprice"), "o_orderkey"),
)


def _permutation(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders")
    both = fingerprint(orders).select("elems", F.col("hash").alias("a")), fingerprint(with_position(orders, Ordering.of("-o_totalprice").over(orders)).drop("pos")).select(F.col("elems").alias("n"), F.col("hash").alias("b"))
    return both[0].join(both[1], F.col("elems") == F.col("n"), "left").select("elems", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same_rows"))


_add("check_permutation", "SELECT count(*) AS elems, TRUE AS same_rows FROM orders", _permutation)
_add(
    "generate_u32",
    "SELECT range AS pos, (range * 1103515245 + 12345) % 4294967296 AS value FROM range(65536)",
    lambda spark, d: generate_u32(spark, 65536),
)
_add(
    "generate_record",
    "SELECT (range * 1103515245 + 12345) % 4294967296 AS id, printf('Name %03d', range) AS name, printf('Text %03d', range) AS text FROM range(1, 1501)",
    lambda spark, d: generate_records(spark, 1500).select("id", "name", "text"),
)
_add(
    "value2str",
    "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS plain, '(id = ' || o_orderkey || '; name = ''' || o_orderstatus || '''; text = ''' || o_orderpriority || ''')' AS record FROM orders",
    lambda spark, d: _table(spark, d, "orders").select("o_orderkey", value_text(F.col("o_custkey")).alias("plain"), record_text(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("record")),
)
_add(
    "memsize",
    "SELECT * FROM (VALUES ('B', CAST(10 AS BIGINT)), ('K', CAST(10240 AS BIGINT)), ('M', CAST(10485760 AS BIGINT))) AS t(unit, bytes)",
    lambda spark, d: spark.createDataFrame([("B",), ("K",), ("M",)], "unit string").select("unit", memory_text(F.lit(10), F.col("unit")).alias("bytes")),
)
_add(
    "merge_counts",
    "SELECT r AS runs, k AS fan_in, CAST(ceil((r - 1) / (k - 1)) AS BIGINT) AS merges FROM (SELECT unnest(range(1, 41)) AS r), (SELECT unnest(range(2, 7)) AS k)",
    lambda spark, d: spark.createDataFrame([(r, k, MergeParams(fan_in=k).merge_count(r)) for r in range(1, 41) for k in range(2, 7)], "runs bigint, fan_in bigint, merges bigint"),
)


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """o_custkey as a file of unsigned 32-bit numbers, split into runs, merged to a sorted file, and read again."""
    from spillway.plans.spec import U32
    from spillway.sources.binary import read_records, write_records

    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = f"{(shared or tempfile.mkdtemp(prefix='spillway-')).rstrip('/')}/roundtrip-{uuid.uuid4().hex}"
    files = base.removeprefix("file://") if base.startswith("file:///") else base
    os.makedirs(files, exist_ok=True) if "://" not in files else None
    orders = _table(spark, d, "orders")
    write_records(orders.select(F.col("o_custkey").alias("value")), f"{files}/in", U32)
    runs = split(read_records(spark, f"{files}/in", U32), "pos", 4096, Ordering.of("value", ties=("pos",)))
    write_runs(runs.select("value", "run_id", "pos_in_run"), f"{base}/runs")
    # All runs are read at once: a plan for each would grow with their number.
    merged = merge([spark.read.schema("value bigint, pos_in_run bigint, run_id bigint").parquet(f"{base}/runs").select("value")], Ordering.of("value"))
    write_records(merged, f"{files}/out", U32)
    return read_records(spark, f"{files}/out", U32)


_add("roundtrip_binary", "SELECT CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS pos, o_custkey AS value FROM orders", _roundtrip)
