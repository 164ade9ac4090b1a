"""Exact top-k inner products over norm-sorted vectors.

Vectors are integers: floor(scale * x) of each component, held as doubles, which are exact for them. Candidates are sorted
by descending length and dealt into blocks. A first bound for each query comes from the longest vectors of all (a fixed
number); a candidate shorter than bound / |q| cannot reach it. Queries are dealt into blocks by that length, so a block of
queries needs the candidate blocks down to one number only, and no others are multiplied. Vectors are not shuffled for it:
blocks of queries of SENT bytes in all go to the tasks at once, which read the candidate blocks as they lie; their finds are
stored before the next queries go out, so the driver holds those bytes and no more, however large the tables. Rounds go from
longer to shorter blocks, each over more blocks than the last, and what a round finds raises the bounds for the next.

In a pair of blocks, candidates are taken in order of descending length: once |q| * |c| is under a query's bound, no later
one can enter; before that, the first components after a rotation (the eigenvectors of the corpus' second moments, which
are the right singular vectors of the whole matrix) give a partial sum, and Cauchy-Schwarz bounds what the others can add.
Only pairs whose bound reaches the query's k-th score so far are multiplied out, exactly: in doubles where |q| * |c| is
under 2**53, else in integers of 64 bits or of any size. Bounds are widened by more than rounding can take, and equal
scores are never pruned.

Defined cases: null vectors, null or non-finite components (also once scaled) and null ids take no part; shorter vectors
count as filled up with zeros; rows with the query's own vec_id are no candidates of it; a repeated row is a candidate as
often as it occurs, while a repeated query counts once (its smallest vector); ties go to the smaller vec_id; scores beyond
64 bits count as the largest or smallest long, and tie; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialise

#: Vectors of a block of candidates, and of a block of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 4096
#: Ranges of length that candidates are dealt into, at most: Spark samples each in the driver. Beyond that a range has several
#: blocks, which share its number.
RANGES = 512
#: Bytes of query vectors that are sent to the tasks at once.
SENT = 16 << 20
#: The longest vectors, from which each query gets its first bound.
LONGEST = 2048
#: Candidates that share one look at the bounds.
STEP = 512
#: Candidate blocks of the first round, and how many times as many each further round ends at.
FIRST_ROUND, GROWTH = 16, 8
#: Classes of length in a doubling.
CLASSES = 8
_LONG = 2.0**63


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and the integers (as doubles) of each vector that takes part."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * scale)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("q"))
    usable = usable.where(F.col("q").isNotNull() & ~F.coalesce(F.exists("q", bad), F.lit(True)))
    # From 2**53 on, doubles are whole.
    return usable.select("vec_id", F.transform("q", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)).alias("q"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    out = np.zeros((len(column), d))
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _class(length: np.ndarray) -> np.ndarray:
    """The class of a length: a step of an eighth of a doubling; below 1 all are one."""
    return np.floor(CLASSES * np.log2(np.maximum(length, 1.0))).astype(np.int64)


def _rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the sum of x xT over all vectors, largest first; summed by entry, d * d of them.

    Any rotation gives right bounds, so vectors of extreme length, whose squares might overflow, count as of length 2**60.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(b.column(0), d)
            x *= np.minimum(1.0, 2.0**60 / np.maximum(_lengths(x), 1.0))[:, None]
            total += x.T @ x
        at = np.arange(d * d, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    entries = vectors.select("q").mapInArrow(partial, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    m = np.zeros(d * d)
    m[entries["at"].to_numpy()] = entries["v"].to_numpy()
    return np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy()


def exact_scores(q: np.ndarray, c: np.ndarray, plain: bool = False) -> np.ndarray:
    """Inner products of the rows of q with those of c, as longs; plain: all |q| * |c| are under 2**53."""
    most = 0.0 if plain else float((_lengths(q) * _lengths(c)).max(initial=0.0))
    if most < 2.0**53:  # no sum of products exceeds it, so every one is exact
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    if most < 2.0**62 and max(np.abs(q).max(), np.abs(c).max()) < 2.0**62:
        return (q.astype(np.int64) * c.astype(np.int64)).sum(axis=1)
    whole = [sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(q.tolist(), c.tolist(), strict=True)]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in whole], dtype=np.int64)


def _best(qi: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by score and then by id."""
    order = np.lexsort((ids, ~scores, qi))
    qi, ids, scores = qi[order], ids[order], scores[order]
    first = np.searchsorted(qi, qi, "left")
    keep = np.arange(len(qi)) - first < k
    return qi[keep], ids[keep], scores[keep]


class QueryBlock:
    """Queries, their bounds and the best found for them so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.q, self.bound, self.rotation, self.k = ids, q, bound.copy(), rotation, k
        self.head = max(1, q.shape[1] // 4)
        self.rotated = q @ rotation
        self.length, self.rest = _lengths(self.rotated), _lengths(self.rotated[:, self.head :])
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def search(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        """Takes in what reaches the bounds, k for each query at most; c is in order of length."""
        k, head, q, bound = self.k, self.head, self.q, self.bound
        cr = c @ self.rotation
        c_len, c_rest = _lengths(cr), _lengths(cr[:, head:])
        slack = 1e-6 * (1 + self.length)
        most = float(self.length.max(initial=0.0)) * float(c_len.max(initial=0.0))
        plain, many = most < 2.0**52, False
        # Sums of integers under 2**24 are exact in single precision too.
        kind = np.float32 if most < 2.0**23 else np.float64
        for start in range(0, len(c), STEP):
            part = slice(start, start + STEP)
            longest = c_len[part].max()
            reach = np.maximum(self.length * longest + slack * (1 + longest), -_LONG)
            live = np.flatnonzero(reach >= bound)
            if not len(live):
                if start and c_len[start:].max() <= longest:
                    break
                continue
            if not many:
                upper = self.rotated[live][:, :head] @ cr[part, :head].T + self.rest[live][:, None] * c_rest[part][None, :]
                upper = np.maximum(upper + slack[live][:, None] * (1 + longest), -_LONG)
                close = upper >= bound[live][:, None]
                many = plain and 16 * np.count_nonzero(close) > close.size
            if many:  # all products at once, and in the rest of the block too
                scores = q[live].astype(kind) @ c[part].T.astype(kind)
                a, b = np.nonzero(scores >= bound[live].astype(kind)[:, None])
                scores = scores[a, b].astype(np.int64)
            else:
                a, b = np.nonzero(close)
                scores = np.empty(len(a), dtype=np.int64)
                for s in range(0, len(a), 1 << 16):
                    scores[s : s + (1 << 16)] = exact_scores(q[live[a[s : s + (1 << 16)]]], c[start + b[s : s + (1 << 16)]], plain)
            a, b = live[a], b + start
            reached = (scores >= bound[a]) & (self.ids[a] != c_ids[b])
            a, b, scores = a[reached], b[reached], scores[reached]
            if not len(a):
                continue
            bq, bi, bs = (np.concatenate(x) for x in zip(self.best, (a, c_ids[b], scores), strict=True))
            self.best = bq, _, bs = _best(bq, bi, bs, k)
            full = np.flatnonzero(np.bincount(bq, minlength=len(q)) == k)
            last = np.searchsorted(bq, full, "right") - 1
            bound[full] = np.maximum(bound[full], bs[last])


class Search:
    """Candidates in blocks, and queries with their bounds."""

    def __init__(self, vectors: DataFrame, is_query: Column, k: int):
        vectors = vectors.select("*", F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x).alias("n2"))
        facts = vectors.agg(F.max(F.size("q")).alias("d"), F.count("*").alias("n"), F.count_distinct(F.when(is_query, F.col("vec_id"))).alias("m")).first()
        self.k, self.d = k, max(1, facts["d"] or 0)
        self.query_block = max(1, min(QUERY_BLOCK, SENT // (16 * self.d)))  # twice over, still sent at once
        self.n_candidates, self.n_queries = min(RANGES, -(-facts["n"] // CANDIDATE_BLOCK)), min(RANGES, -(-facts["m"] // self.query_block))
        if not facts["m"]:
            return
        d = self.d
        self.rotation = _rotation(vectors, d)
        longest = vectors.orderBy(F.desc("n2"), "vec_id").limit(LONGEST).select("vec_id", "q").toArrow()
        long_ids, long_vectors = longest["vec_id"].to_numpy(), _matrix(longest["q"].combine_chunks(), d)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Packs the rows of each block, longest first, into rows of CANDIDATE_BLOCK vectors at most twice over."""
            held: dict[int, list] = {}

            def packed(b: int, rows: list) -> pa.RecordBatch:
                ids, m = (np.concatenate([x[k] for x in rows]) for k in range(2))
                n = _lengths(m)
                order = np.lexsort((ids, -n))
                return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([float(n.max())]), pa.array([ids[order].tobytes()], pa.binary()), pa.array([m[order].tobytes()], pa.binary())], ["cb", "most", "c_ids", "c_vectors"])

            for batch in batches:
                which = batch.column(0).to_numpy()
                ids, m = batch.column(1).to_numpy(), _matrix(batch.column(2), d)
                for b in np.unique(which):
                    rows = held.setdefault(int(b), [])
                    rows.append((ids[which == b], m[which == b]))
                    if sum(len(x[0]) for x in rows) >= 2 * CANDIDATE_BLOCK:
                        yield packed(int(b), held.pop(int(b)))
            for b, rows in held.items():
                yield packed(b, rows)

        # Length decides only the order of work, not the result, so the dealing needs no exact ranks: ranges of (length, id).
        dealt = vectors.repartitionByRange(self.n_candidates, F.desc("n2"), F.col("vec_id")).select(F.spark_partition_id().alias("cb"), "vec_id", "q")
        self.candidates = materialise(dealt.mapInArrow(blocks, "cb int, most double, c_ids binary, c_vectors binary"), "candidates")
        # The last block of each class of length: a row for each of fewer than 2048 * CLASSES classes.
        length_class = F.floor(CLASSES * F.log2(F.greatest("most", F.lit(1.0)))).cast("bigint")
        lasts = sorted((r["c"], r["cb"]) for r in self.candidates.groupBy(length_class.alias("c")).agg(F.max("cb").alias("cb")).collect())
        self.classes, self.last_blocks = np.array([x[0] for x in lasts]), np.maximum.accumulate(np.array([x[1] for x in lasts])[::-1])[::-1]

        def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), d)
                bound = np.full(len(q), -np.inf)
                for start in range(0, len(q), 512):
                    own = slice(start, start + 512)
                    scores = np.clip(q[own] @ long_vectors.T, -_LONG, _LONG)
                    scores -= 1e-6 * (1 + _lengths(q[own]))[:, None] * (1 + _lengths(long_vectors))[None, :]
                    scores[ids[own, None] == long_ids[None, :]] = -np.inf
                    if scores.shape[1] >= k:
                        bound[own] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bound)], ["vec_id", "q", "bound"])

        first = vectors.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
        self.queries = materialise(first.mapInArrow(first_bounds, "vec_id bigint, q array<double>, bound double"), "queries")

    def raise_bounds(self, best: DataFrame) -> None:
        """From the k-th of the best (query_id, rank, score) so far."""
        kth = best.where(F.col("rank") == self.k).select(F.col("query_id").alias("k_id"), F.col("score").cast("double").alias("kth"))
        joined = self.queries.join(kth, F.col("vec_id") == F.col("k_id"), "left")
        # A long as a double may be rounded up.
        lowered = F.col("kth") - 1e-6 * (1 + F.abs("kth"))
        self.queries = materialise(joined.select("vec_id", "q", F.greatest("bound", lowered).alias("bound")), "queries")

    def query_blocks(self) -> DataFrame:
        """Packed queries of like reach: ids, vectors, bounds, and upto, the last candidate block that any of them needs; a
        block is named by its first query."""
        d, classes, last_blocks, most = self.d, self.classes, self.last_blocks, self.query_block

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

            def packed() -> pa.RecordBatch:
                ids, m, bound, need = (np.concatenate([x[k] for x in held]) for k in range(4))
                held.clear()
                # One class of length less than needed: logarithms may be rounded.
                at = int(np.searchsorted(classes, int(_class(need).min()) - 1))
                upto = int(last_blocks[at]) if at < len(classes) else -1
                return pa.RecordBatch.from_arrays([pa.array([ids[0]]), pa.array([upto], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, m, bound))], ["block", "upto", "q_ids", "q_vectors", "q_bounds"])

            for whole in batches:
                for start in range(0, whole.num_rows, most):
                    batch = whole.slice(start, most)
                    held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), d), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)))
                    if sum(len(x[0]) for x in held) >= most:
                        yield packed()
            if held and sum(len(x[0]) for x in held):
                yield packed()

        # The least length of a candidate that reaches the bound.
        length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
        need = F.when((F.col("bound") > 0) & (length > 0), F.col("bound") / length * (1 - 1e-6)).otherwise(0.0)
        queries = self.queries.withColumn("need", need).repartitionByRange(self.n_queries, "need", "vec_id")
        return queries.select("vec_id", "q", "bound", "need").mapInArrow(blocks, "block bigint, upto int, q_ids binary, q_vectors binary, q_bounds binary")

    def block_pairs(self, lo: int, hi: int) -> DataFrame:
        """A row for each block of queries and each number of candidate blocks from lo to hi - 1 that found() takes to it."""
        needed = self.query_blocks().where(F.col("upto") >= lo)
        return needed.select("block", F.explode(F.sequence(F.lit(lo), F.least("upto", F.lit(hi - 1)))).alias("cb"))

    def found(self, lo: int, hi: int) -> list[DataFrame]:
        """Stored finds (query_id, vec_id, score) in candidate blocks from lo to hi - 1, a table for each SENT bytes of queries."""
        blocks = materialise(self.query_blocks().where(F.col("upto") >= lo), "query-blocks")
        sizes = blocks.select("block", "upto", (F.length("q_ids") * self.d).alias("bytes")).toArrow().to_pylist()
        sent, total = [], SENT + 1
        for r in sorted(sizes, key=lambda r: (-r["upto"], r["block"])):
            if (total := total + r["bytes"]) > SENT:
                sent.append([])
                total = r["bytes"]
            sent[-1].append(r)
        return [self._found_for(blocks.where(F.col("block").isin([r["block"] for r in part])), lo, min(hi - 1, part[0]["upto"])) for part in sent]

    def _found_for(self, blocks: DataFrame, lo: int, last: int) -> DataFrame:
        d, k, rotation, queries = self.d, self.k, self.rotation, blocks.toArrow().to_pylist()

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for batch in batches:
                for row in range(batch.num_rows):
                    cb = batch.column(0)[row].as_py()
                    c_ids, c = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in ((1, np.int64), (2, float)))
                    if not held:
                        unpacked = [[np.frombuffer(r[x], t) for x, t in (("q_ids", np.int64), ("q_vectors", float), ("q_bounds", float))] for r in queries]
                        held = [(r["upto"], QueryBlock(ids, q.reshape(-1, d), bound, rotation, k)) for r, (ids, q, bound) in zip(queries, unpacked, strict=True)]
                    for upto, own in held:
                        if upto >= cb:
                            own.search(c_ids, c.reshape(-1, d))
            for _, own in held:
                q, ids, scores = own.best
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (own.ids[q], ids, scores))), ["query_id", "vec_id", "score"])

        candidates = self.candidates.where(F.col("cb").between(lo, last)).select("cb", "c_ids", "c_vectors")
        return materialise(candidates.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint"), "found")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query; `vectors` as integer_vectors() gives them."""
    search = Search(vectors, is_query, k)
    best = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not search.n_queries:
        return best
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    lo, hi = 0, FIRST_ROUND
    while True:
        found = search.found(lo, min(hi, search.n_candidates))
        if not found:  # bounds only rise: no later block is needed either
            return best
        if lo:
            found.append(best.select("query_id", "vec_id", "score"))
        best = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if hi >= search.n_candidates:
            return best
        best = materialise(best, "best")
        search.raise_bounds(best)
        lo, hi = hi, hi * GROWTH
