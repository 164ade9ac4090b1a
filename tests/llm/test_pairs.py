"""The n-gram join and substring removal against all pairs."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, components, cut, frame, prose, shingles, words

from spillway.llm import ngram_join, substring
from spillway.llm.components import components as connected


def joined(spark, rows):
    return Counter(tuple(r) for r in ngram_join.similar_components(frame(spark, [(d, t, None, None, 0) for d, t in rows])).collect())


def test_awkward_documents(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    assert joined(spark, rows) == components(rows)


@pytest.mark.parametrize("large", [16, 1])
def test_chains_clusters_and_thresholds(spark, large, monkeypatch):
    """Near copies at all distances, chained ones, and boilerplate in most documents."""
    monkeypatch.setattr(ngram_join, "LARGE", large)
    r = random.Random(3)
    rows, boiler = [], prose(77, 40)
    for g in range(6):
        base = prose(100 + g, r.choice([8, 20, 60, 150])).split()
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 12) + 1)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
            base = w if g % 2 else base
    rows += [(len(rows) + k, f"{prose(500 + k, 30)} {boiler}") for k in range(40)]
    assert joined(spark, rows) == components(rows)


def test_hamming_pairs_are_those_of_all_pairs():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    sets = []
    for n in r.integers(20, 400, 60):
        own = r.integers(0, 2**63, max(1, int(n) // 9)).astype(np.uint64)
        sets.append(np.unique(np.concatenate((base[: int(n)], own))))
    sets.sort(key=len)
    value = np.zeros(60, dtype=np.int64)
    sizes, groups = np.array([len(x) for x in sets]), r.integers(0, 5, 60)
    sketches = [ngram_join.dense_sketch(x) for x in sets]
    i, j = ngram_join.within_hamming(value, sizes, groups, sketches, False)
    want = {(a, b) for a in range(60) for b in range(60) if a < b and groups[a] != groups[b] and 4 * min(sizes[a], sizes[b]) >= 3 * max(sizes[a], sizes[b]) and 7 * ngram_join.hamming(sketches[a], sketches[b]) <= sizes[a] + sizes[b]}
    got = [(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want
    i, j = ngram_join.within_hamming(value, sizes, groups, sketches, True)
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} <= want and len(i) >= len({a for p in want for a in p}) // 2


def test_no_documents(spark):
    assert ngram_join.similar_components(frame(spark, [])).collect() == []
    assert substring.remove_repeats(frame(spark, [])).collect() == []


def test_similar_sets_share_a_value_and_stay_within_the_bound():
    r = np.random.default_rng(1)
    for n in (4, 7, 16, 61, 300, 2000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        common = a[: len(a) - len(a) // 8]
        b = np.unique(np.concatenate((common, r.integers(0, 2**63, len(a) // 8).astype(np.uint64))))
        often = np.sort(common[:: max(1, len(common) // 5)])
        values = [set(ngram_join.block_values(x, np.array([len(x)]), often, np.arange(1, len(often) + 1))[0].tolist()) for x in (a, b)]
        assert 4 * len(common) < 3 * len(np.union1d(a, b)) or values[0] & values[1]
        assert ngram_join.hamming(ngram_join.dense_sketch(a), ngram_join.dense_sketch(b)) <= len(np.setxor1d(a, b))


def test_shingles_are_those_of_the_text():
    texts = [r[1] for r in awkward()]
    assert ngram_join.shingle_sets(pa.array(texts))[1].tolist() == [len(shingles(t)) for t in texts]


def test_one_row_of_each_group_stays_where_ids_are_null_or_repeated(spark):
    import corpus_pipeline

    def near(seed):
        return prose(seed, 200) + " more"

    rows = [(1, prose(1, 200)), (None, near(1)), (None, prose(2, 200))]  # the null one that is linked goes, the other stays
    rows += [(7, prose(3, 200)), (7, near(1)), (8, prose(4, 200)), (8, near(4))]  # one id, texts of two groups, and of one
    rows += [(None, prose(5, 200)), (None, near(5)), (None, near(5))]  # no id in the group
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert all(got[x] == 1 for x in [(1, prose(1, 200)), (None, prose(2, 200)), (7, prose(3, 200))])
    assert got[(8, prose(4, 200))] + got[(8, near(4))] == 1 and got[(None, prose(5, 200))] + got[(None, near(5))] == 1
    assert sum(got.values()) == 5


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100)], "u bigint, v bigint")
    assert {(r["node"], r["component"]) for r in connected(edges).collect()} == {(k, 1) for k in range(1, 41)} | {(100, 100), (101, 100)}


def test_substrings_of_awkward_documents(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    got = Counter((r["doc_id"], r["n_words"], tuple(r["kept_words"].split(" ")) if r["kept_words"] else ()) for r in substring.remove_repeats(frame(spark)).collect())
    assert got == Counter(cut(rows))


@pytest.mark.parametrize("seed", range(2))
def test_substrings_at_boundaries(spark, seed):
    """Passages of 48 to 120 words from a few sources, put together at random: factors touch and overlap."""
    r = random.Random(seed)
    sources = [prose(900 + k, 300).split() for k in range(3)]
    rows = []
    for d in range(25):
        parts = []
        for _ in range(r.randrange(1, 4)):
            s, n = r.choice(sources), r.randrange(48, 121)
            a = r.randrange(0, 300 - n)
            parts += s[a : a + n] + prose(r.randrange(10**6), r.choice([0, 0, 3])).split()
        rows.append((d // 2 if d % 5 == 0 else d, " ".join(parts)))
    df = frame(spark, [(d, t, None, None, 0) for d, t in rows])
    got = Counter((x["doc_id"], x["n_words"], tuple(x["kept_words"].split(" ")) if x["kept_words"] else ()) for x in substring.remove_repeats(df).collect())
    assert got == Counter(cut(rows))


def plain_parse(rows, window=50):
    """Greedy factors of each document against the blocks of documents of smaller id, word by word."""
    index = {}
    for d, t in sorted(rows):
        w = words(t)
        for i in range(len(w) - window + 1):
            index.setdefault(tuple(w[i : i + window]), (d, i))
    out = Counter()
    for d, t in rows:
        w = words(t)
        at = lambda i: index.get(tuple(w[i : i + window]), (d, 0)) if i + window <= len(w) else (d, 0)  # noqa: B023, E731
        i = 0
        while i < len(w):
            r, p = at(i)
            if r >= d:
                i += 1
                continue
            n = window
            while at(i + n - window + 1) == (r, p + n - window + 1):
                n += 1
            out[(d, i, n, r, p)] += 1
            across = [j for j in range(i + n - window + 1, i + n) if at(j)[0] < d]
            i = across[0] if across else i + n
    return out


@pytest.mark.parametrize("seed", range(2))
def test_factors_are_those_of_a_greedy_parser(spark, seed):
    r = random.Random(20 + seed)
    sources = [prose(700 + k, 260).split() for k in range(3)]
    rows = []
    for d in range(30):
        parts = []
        for _ in range(r.randrange(1, 5)):
            s, n = r.choice(sources), r.randrange(45, 140)
            a = r.randrange(0, 260 - n)
            parts += s[a : a + n] + prose(r.randrange(10**6), r.choice([0, 0, 4])).split()
        rows.append((d, " ".join(parts)))
    want = plain_parse(rows)
    got = Counter(tuple(x) for x in substring.factorise(frame(spark, [(d, t, None, None, 0) for d, t in rows])).collect())
    assert got == want and len({x[3] for x in want}) > 3


def test_a_copy_is_one_factor(spark):
    rows = [(5, prose(1, 60)), (7, prose(1, 60)), (7, prose(1, 60)), (9, prose(2, 40)), (10, prose(2, 40)), (None, prose(1, 60))]
    got = Counter(tuple(x) for x in substring.factorise(frame(spark, [(d, t, None, None, 0) for d, t in rows])).collect())
    assert got == Counter({(7, 0, 60, 5, 0): 2})


def test_shuffle_files_go_with_the_table_they_were_written_for(spark):
    """Else what substring removal has shuffled for its five tables lies on disk until the driver collects its garbage."""
    from pyspark.sql import functions as F

    from spillway.llm._util import materialise

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffled(), spark.conf.get(setting, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    stored = materialise(df, "counts")
    for _ in range(20):  # files go in the background
        if not shuffled() - before:
            break
        time.sleep(0.5)
    assert not shuffled() - before and spark.conf.get(setting, None) == was
    assert Counter(tuple(r) for r in stored.collect()) == Counter(tuple(r) for r in df.collect())


def test_kept_text_keeps_its_form(spark):
    passage = prose(8, 55)
    out = substring.remove_repeats(frame(spark, [(1, passage, None, None, 0), (2, f"Head\n\n{passage}\n\ttail  end", None, None, 0)])).orderBy("doc_id").collect()
    assert [x["kept_text"] for x in out] == [passage, "Head\n\ntail  end"] and out[1]["class"] == "own"
