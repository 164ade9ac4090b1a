import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spillway.functions.generate import generate_records, generate_u32
from spillway.operators import verify
from spillway.operators.merge import merge
from spillway.operators.order import sort, sort_blocks, with_position, with_rank
from spillway.operators.runs import manifest, read_run, split, write_runs
from spillway.plans.spec import Key, Ordering

BLOCK = 8


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "at bigint, v bigint")


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK, 3 * BLOCK + 1])
@pytest.mark.parametrize("kind", ["random", "equal", "sorted", "reversed"])
def test_sort_equals_merge_of_split(spark, n, kind):
    r = random.Random(n)
    values = {"random": [r.randrange(50) for _ in range(n)], "equal": [7] * n, "sorted": list(range(n)), "reversed": list(range(n, 0, -1))}[kind]
    df = frame(spark, values)
    ordering = Ordering.of("v", ties=("at",))
    runs = split(df, "at", BLOCK, ordering)
    assert sorted(x[0] for x in runs.select("run_id").distinct().collect()) == list(range(1, -(-n // BLOCK) + 1))
    parts = [runs.where(F.col("run_id") == k).select("at", "v") for k in range(1, max(2, -(-n // BLOCK) + 1))]
    got = [r["v"] for r in merge(parts, ordering, "pos").orderBy("pos").collect()]
    assert got == sorted(values)
    assert verify.same_rows(df, merge(parts, ordering))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=40), st.booleans(), st.booleans())
def test_position_with_nulls_and_directions(spark, values, descending, nulls_first):
    df = frame(spark, values)
    got = with_position(df, Ordering((Key("v", descending, nulls_first),), (Key("at"),)), start=0).orderBy("pos").collect()
    want = sorted(range(len(values)), key=lambda i: ((values[i] is None) != nulls_first, 0 if values[i] is None else -values[i] if descending else values[i], i))
    assert [r["at"] for r in got] == want and [r["pos"] for r in got] == list(range(len(values)))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 9), max_size=40), st.booleans())
def test_check_agrees_with_a_fold(spark, values, descending):
    old, verify.STRETCH = verify.STRETCH, 7
    try:
        df = frame(spark, values).repartition(3)
        ordering = Ordering((Key("v", descending),))
        bad = [i for i in range(1, len(values)) if (values[i] > values[i - 1] if descending else values[i] < values[i - 1])]
        report = verify.check(df, ordering, "at").first()
        ends = (min, max) if not descending else (max, min)
        want = (not bad, len(values), len(bad), *((ends[0](values), ends[1](values), values[0], values[-1]) if values else (None,) * 4))
        assert tuple(report) == want
        first = verify.first_violations(df, ordering, "at").collect()
        assert [tuple(r) for r in first] == [(i, values[i - 1], values[i]) for i in bad[:10]]
    finally:
        verify.STRETCH = old


def test_check_with_two_keys(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (2, 1, 1), (3, 2, 0)], "at bigint, a int, b int")
    report = verify.check(df, Ordering.of("a", "b"), "at").first()
    assert (report["sorted"], report["bad"], tuple(report["vmin"]), tuple(report["vlast"])) == (False, 1, (1, 1), (2, 0))


def test_ties_spread_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.col("id"), F.lit(1).alias("k"))
        parts = [r[0] for r in sort(df, Ordering.of("k").over(df)).select(F.spark_partition_id()).collect()]
        assert len(set(parts)) > 1 and parts == sorted(parts)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rank_is_the_same_for_any_order_of_ties(spark):
    df = frame(spark, [3, 1, 3, None, 1, 2])
    assert {r["at"]: r["rnk"] for r in with_rank(df, Ordering.of("v")).collect()} == {1: 1, 4: 1, 5: 3, 0: 4, 2: 4, 3: 6}


def test_one_exchange_per_sort(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity")
    plan = sort(df, Ordering.of("l_quantity"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan") :]
    assert physical.count("rangepartitioning") == 1 and "l_comment" not in physical and "struct<l_orderkey:bigint,l_quantity:double>" in physical


def test_spilled_sort_is_in_order(spark, sf_dir):
    assert int(spark.conf.get("spark.shuffle.spill.numElementsForceSpillThreshold")) < 6000
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").coalesce(1)
    ordered = with_position(df, Ordering.of("l_extendedprice").over(df))
    assert verify.check(ordered, Ordering.of("l_extendedprice"), "pos").first()["sorted"]
    assert verify.same_rows(df, ordered.drop("pos"))


def test_nan_comes_after_infinity(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.0,), (1.0,)], "v double")
    assert [str(r["v"]) for r in sort(df, Ordering.of("v")).collect()] == ["-0.0", "1.0", "inf", "nan"]


def test_maps_cannot_be_ordered(spark):
    df = spark.sql("select map(1, 2) as m, 1 as k")
    with pytest.raises(TypeError):
        sort(df, Ordering.of("m"))
    assert [k.column for k in Ordering.of("k").over(df).tie_breakers] == []


def test_blocks_and_written_runs(spark, tmp_path):
    df = frame(spark, [5, 3, 9, 1, 7, 2])
    runs = split(df, "at", 3, Ordering.of("v"))
    assert [tuple(r) for r in manifest(runs, "x", "v").orderBy("run_id").collect()] == [(1, "x.split.001", 3, 3, 9), (2, "x.split.002", 3, 1, 7)]
    write_runs(runs, str(tmp_path / "runs"))
    assert [r["v"] for r in read_run(spark, str(tmp_path / "runs"), 2).orderBy("pos_in_run").collect()] == [1, 2, 7]
    assert [r["v"] for r in sort_blocks(df.coalesce(1), Ordering.of("-v")).collect()] == [9, 7, 5, 3, 2, 1]
    with pytest.raises(ValueError):
        split(df, "at", 0, Ordering.of("v"))
    with pytest.raises(ValueError):
        merge([], Ordering.of("v"))


def test_generators_repeat_themselves(spark):
    a, b = (generate_u32(spark, 1000, 5) for _ in range(2))
    assert a.exceptAll(b).isEmpty() and a.agg(F.min("value") >= 0, F.max("value") < 1 << 32).first() == (True, True)
    assert tuple(generate_records(spark, 2).orderBy("pos").collect()[1])[2:] == ("Name 002", "Text 002")
