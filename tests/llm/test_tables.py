"""Exact top-k and conversations."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spillway.llm import chat, topk


def plain_top(rows, k):
    import math

    least, most = -(1 << 63), (1 << 63) - 1

    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % 50 == 0:
            queries[i] = min(v, queries.get(i, v))
    out = Counter()
    for i, q in queries.items():
        found = sorted((-min(most, max(least, sum(a * b for a, b in zip(q, v, strict=False)))), j) for j, v in ok if j != i)[:k]
        out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found))
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_is_exact(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_ROUND", 2)
    monkeypatch.setattr(topk, "GROWTH", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "LONGEST", 20)
    monkeypatch.setattr(topk, "STEP", 8)
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 7) for _ in range(6)]) for i in range(1, 160)]
    rows += [(i, [0.5] * 6) for i in range(200, 240)] + [(0, [0.0] * 6), (50, rows[0][1]), (300, None), (None, [1.0] * 6), (301, [float("nan")] * 6), (302, [None] * 6), (350, [1.0, 2.0]), (400, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("q", F.lit("own"))
    got = Counter(tuple(x) for x in topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, 5).collect())
    assert got == plain_top(rows, 5)


def test_scores_of_very_long_vectors(spark):
    """Beyond 2**53, beyond 64 bits, and both ways."""
    r = random.Random(6)
    rows = [(i, [r.choice([-1, 1]) * r.random() * 10.0 ** r.choice([0, 6, 9]) for _ in range(4)]) for i in range(1, 120)]
    rows += [(200, [3e38] * 4), (201, [3e38, -3e38, 1.0, 2.0]), (202, [-3e38] * 4), (203, [1e9, 1e9, 1e9, 1e9]), (250, [1e9, -1e9, 0.5, 1e9]), (300, [1e300] * 4), (350, [1.7e308] * 4), (351, [1e307] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = Counter(tuple(x) for x in topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, 5).collect())
    assert got == plain_top([(i, v) for i, v in rows if max(map(abs, v)) < 7e305], 5)


def test_blocks_that_no_query_can_use_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "LONGEST", 32)
    r = random.Random(7)
    rows = [(i, [(abs(r.gauss(0, 1)) + 0.1) * 40 / (1 + i) for _ in range(4)]) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    search = topk.Search(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, 5)
    blocks = search.query_blocks().count()
    assert search.n_candidates == 25 and 0 < search.block_pairs(0, 25).count() < blocks * 25 / 2
    assert Counter(tuple(x) for x in topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, 5).collect()) == plain_top(rows, 5)


def test_queries_go_out_in_bounded_parts_and_no_join_is_broadcast(spark, monkeypatch):
    for name, value in [("CANDIDATE_BLOCK", 16), ("RANGES", 4), ("FIRST_ROUND", 2), ("LONGEST", 8)]:
        monkeypatch.setattr(topk, name, value, raising=False)
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(0, 2500, 5)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    whole = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)
    assert Counter(tuple(x) for x in whole.collect()) == plain_top(rows, 5)
    # Pairs of blocks are many times what Spark estimates: their broadcast ended the driver at 0.6 million vectors.
    assert "Broadcast" not in whole._jdf.queryExecution().executedPlan().toString()
    sent, found_for = [], topk.Search._found_for

    def recorded(self, blocks, lo, last):
        sent.append(sum(len(x["q_vectors"]) for x in blocks.collect()))
        return found_for(self, blocks, lo, last)

    monkeypatch.setattr(topk, "SENT", 640)
    monkeypatch.setattr(topk.Search, "_found_for", recorded)
    assert Counter(tuple(x) for x in topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect()) == plain_top(rows, 5)
    assert max(sent) <= 640 and sum(sent) >= 50 * 4 * 8


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id bigint, embedding array<float>")
    search = lambda d: [tuple(x) for x in topk.top_k(topk.integer_vectors(d), F.col("vec_id") % 50 == 0, 5).collect()]
    assert search(df) == [(50, 1, 51, 256 * 512)] and search(df.limit(0)) == [] and search(df.where("vec_id = 51")) == []


def test_prefixes_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", None)
    talks = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, c], 5: [a, b, c], 6: [b, a], 7: [("user", "")], 8: [("user", "x")] * 300, 9: [("user", "x")] * 299, None: [a, b]}
    rows = [(i, t, r, x) for i, turns in talks.items() for t, (r, x) in enumerate(turns)] + [(10, None, "user", "lost"), (11, 5, "user", "hi"), (12, 0, "user", "hi"), (12, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("n_turns", F.lit("own"))
    kept = chat.collapse_snapshots(df)
    assert sorted(r["conv_id"] for r in kept.collect()) == [3, 4, 6, 7, 8, 10, 11, 12]
    turns = chat.render_turns(df, kept)
    text = {r["conv_id"]: r["text"] for r in chat.render(turns).collect()}
    assert text[3] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert turns.where("conv_id = 8").count() == 300
    assert chat.render_turns(df.limit(0), chat.collapse_snapshots(df.limit(0))).collect() == []
