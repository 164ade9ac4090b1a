"""N-gram Jaccard join over parity sketches.

A document's set has its distinct 5-word shingles, each a 64-bit hash. XORing one bit per shingle into a bit vector gives
a parity sketch: an element of only one of two sets flips at most one bit, so the Hamming distance of two sketches is at
most the size of the symmetric difference. For a Jaccard similarity of 3/4 that size is at most (|A| + |B|) / 7, and B has
between 3/4 and 4/3 of A's elements.

1. Documents with equal sets are one class.
2. Each class has a sparse sketch of 2**64 bits in BLOCKS blocks, of which it keeps the non-zero ones, each as one XOR
   fingerprint. Of A's blocks at most d = (|A| + 4/3 |A|) / 7 can differ from B's, so, under any order of all block
   values that both use, the first d + 1 of A's and of B's share one: by the pigeonhole principle nothing is missed.
   Values that hold a frequent shingle come last, the rarer the earlier, so boilerplate makes no large groups.
3. Values travel packed, by ranges of their hash, and only those of two classes or more go on.
4. Each class is first compared with one partner, the one with which it shares most values among the smallest classes of
   its values; components of these links follow. That joins a large group of near copies with one comparison each.
5. Then classes of different components that share a value, and are in one size band, are compared. In groups of over
   LARGE this is done by sketches where the group is, so that its pairs are not written out: first each class proposes
   the nearest class of another component, and components are formed again; then all pairs within the Hamming bound go on.
6. A comparison starts with the dense sketches (twice as many bits as shingles, the larger folded to the smaller); pairs
   within the Hamming bound are verified on the sets themselves.

Which shingles count as frequent decides the order alone, never the result. Hashes have 64 bits: sets or shingles that
differ are taken for the same with a probability near n**2 / 2**65.

Defined cases: null or empty texts have the empty set and link with nothing; texts of under five words have one shingle,
the whole sequence; repeated rows are linked copies; null doc_ids take part but are no component_id unless all of a
component are null; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialise, mix, ragged, run_hashes, signed, slices, small_batches, text_of, word_hashes
from .components import components

SHINGLE = 5
#: A sketch's blocks: by the first bits of a shingle's hash.
BLOCK_BITS = 20
#: A shingle is counted as frequent by a task if so many of WINDOW shingles that it reads together are this one.
LOCAL_COUNT, WINDOW = 2, 1 << 20
#: Frequent shingles told to all tasks: the most frequent of all; 16 bytes each.
FREQUENT = 1 << 18
#: Values of a packed range.
RANGE_VALUES = 1 << 20
#: Classes whose sets are looked up by a broadcast at most; 24 bytes each.
BROADCAST_ROWS = 200_000
_TEXT = 1 << 20
#: Classes that share a value, up to which all pairs of different components are compared one by one.
LARGE = 16
#: Rounds in which classes of large groups propose their nearest class; they decide the order of work alone.
PROPOSALS = 2


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of the texts one after the other, sorted within each, and how many each has."""
    words, _, _, first, _ = word_hashes(texts, lower=True)
    counts = np.diff(first)
    many = np.maximum(counts - size + 1, 0)
    runs = run_hashes(words, size)
    doc = [np.repeat(np.arange(len(counts)), many)]
    values = [runs[ragged(first[:-1], many)]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            doc.append(short)
            values.append(mix(run_hashes(words, n)[first[short]] + np.uint64(n)))
    doc_of, hashes = np.concatenate(doc), np.concatenate(values)
    order = np.lexsort((hashes, doc_of))
    doc_of, hashes = doc_of[order], hashes[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc_of[1:] != doc_of[:-1])
    return hashes[keep], np.bincount(doc_of[keep], minlength=len(counts))


def set_ids(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for the empty one."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        total, folded = np.add.reduceat(hashes, at), np.bitwise_xor.reduceat(mix(hashes + np.uint64(1)), at)
        out[full] = mix(total + mix(folded + counts[full].astype(np.uint64))) | np.uint64(1)
    return out


def most_different(n: np.ndarray) -> np.ndarray:
    """Blocks in which a set of n may differ from a similar one, at most."""
    return (n + 4 * n // 3) // 7


def block_values(hashes: np.ndarray, counts: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first d + 1 block values of each set, and the set of each value."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    block = hashes >> np.uint64(64 - BLOCK_BITS)
    starts = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (doc[1:] != doc[:-1]))))
    value = mix(np.bitwise_xor.reduceat(mix(hashes), starts) + block[starts])
    doc = doc[starts]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        often = np.maximum.reduceat(np.where(frequent[at] == hashes, times[at], 0), starts)
    else:
        often = np.zeros(len(starts), dtype=np.int64)
    order = np.lexsort((value, often, doc))
    value, doc = value[order], doc[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    keep = rank <= most_different(counts)[doc]
    return value[keep], doc[keep]


def dense_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch of one set: a power of two of bits, at least twice its size; as 64-bit words."""
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    at = (mix(hashes + np.uint64(5)) & np.uint64(bits - 1)).astype(np.int64)
    parity = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ, the larger folded to the size of the smaller."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def in_band(value: np.ndarray, n: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Rows i (out of firsts) and a distance d such that i and i + d have one value and are in one size band.

    Rows are in order of value and n, so a row that has left the band with one distance has left it with all larger ones.
    """
    d, live = 1, firsts
    while len(live):
        live = live[live + d < len(value)]
        live = live[(value[live] == value[live + d]) & (4 * n[live] >= 3 * n[live + d])]
        yield live, d
        d += 1


def within_hamming(value: np.ndarray, n: np.ndarray, groups: np.ndarray, sketches: list[np.ndarray], nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one value, of different groups, within the size band and the Hamming bound; `nearest`: the best of each row."""
    left, right, apart = ([np.zeros(0, np.int64)] for _ in range(3))
    words = np.array([len(x) for x in sketches])
    for w in np.unique(words):
        # Sizes within 4/3 of each other have sketches of one size or of two that follow.
        ids = np.flatnonzero((words == w) | (words == 2 * w))
        table = np.array([sketches[i] if len(sketches[i]) == w else sketches[i][:w] ^ sketches[i][w:] for i in ids])
        v, m, g = value[ids], n[ids], groups[ids]
        for live, d in in_band(v, m, np.flatnonzero(words[ids] == w)):
            different = live[g[live] != g[live + d]]
            for at in range(0, len(different), 1 << 15):
                a = different[at : at + (1 << 15)]
                bits = np.bitwise_count(table[a] ^ table[a + d]).sum(axis=1, dtype=np.int64)
                hit = 7 * bits <= m[a] + m[a + d]
                left.append(ids[a[hit]])
                right.append(ids[a[hit] + d])
                apart.append(bits[hit])
    i, j, bits = (np.concatenate(x) for x in (left, right, apart))
    if nearest:
        i, j, bits = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((bits, bits))
        order = np.lexsort((bits, i))
        i, j = i[order], j[order]
        keep = np.ones(len(i), dtype=bool)
        keep[1:] = i[1:] != i[:-1]
        i, j = i[keep], j[keep]
    return i, j


def _batches(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text)."""
    return grouped_rows(docs).select("doc_id", "n_shingles", "component_id")


def grouped_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and component (a number, null for empty sets) of each row of docs."""
    docs = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "set_id", "n", "sketch", "shingle", "times"]
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def counted() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= LOCAL_COUNT
            n = int(often.sum())
            empty = pa.nulls(n, pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(n, pa.binary()), pa.array(signed(values[often])), pa.array(times[often].astype(np.int64))], names)

        for whole in batches:
            for batch in slices(whole, 1, _TEXT):
                hashes, counts = shingle_sets(batch.column(1))
                ids = set_ids(hashes, counts)
                none = pa.nulls(batch.num_rows, pa.int64())
                _, firsts = np.unique(ids, return_index=True)
                new = np.zeros(len(ids), dtype=bool)
                new[[i for i in firsts.tolist() if ids[i] not in seen]] = True
                seen.update(ids[new].tolist())
                ends = np.cumsum(counts)
                sketches = [dense_sketch(hashes[e - c : e]).tobytes() if ok else None for e, c, ok in zip(ends.tolist(), counts.tolist(), (new & (counts > 0)).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(signed(ids)), pa.array(counts.astype(np.int64)), pa.array(sketches, pa.binary()), none, none], names)
                held.append(hashes[np.repeat(new, counts)])
                if sum(map(len, held)) >= WINDOW:
                    yield counted()
        if held:
            yield counted()

    read = materialise(docs.mapInArrow(classify, "doc_id bigint, text_hash bigint, set_id bigint, n bigint, sketch binary, shingle bigint, times bigint"), "sets")
    members = read.where(F.col("set_id").isNotNull()).select("doc_id", "text_hash", "set_id", "n")
    # Bounded: the FREQUENT most frequent.
    top = read.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(FREQUENT).toArrow()
    frequent, times = top["shingle"].to_numpy().view(np.uint64), top["times"].to_numpy()
    order = np.argsort(frequent)
    frequent, times = frequent[order], times[order]
    total = members.agg(F.sum(F.floor(F.col("n") / 3) + 1)).first()[0] or 0
    n_ranges = int(max(64, -(-total // RANGE_VALUES)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            values, ids, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            at = ((values >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
            order = np.argsort(values, kind="stable")  # ranges are ranges of values, so they are in order as well
            values, ids, sizes, at = values[order], ids[order], sizes[order], at[order]
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            ends = np.append(starts[1:], len(at))
            rows = []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                classes, one, index = np.unique(ids[a:b], return_index=True, return_inverse=True)
                rows.append((int(at[a]), values[a:b].tobytes(), classes.tobytes(), sizes[a:b][one].tobytes(), index.astype(np.uint32).tobytes()))
            return _batches(rows, ["part", "values", "classes", "sizes", "at"], [pa.int64(), *[pa.binary()] * 4])

        for whole in batches:
            for batch in slices(whole, 0, _TEXT):
                hashes, counts = shingle_sets(batch.column(0))
                ids = set_ids(hashes, counts)
                _, firsts = np.unique(ids, return_index=True)
                new = np.zeros(len(ids), dtype=bool)
                new[[i for i in firsts.tolist() if ids[i] not in seen]] = True
                seen.update(ids[new].tolist())
                hashes, ids, counts = hashes[np.repeat(new, counts)], ids[new], counts[new]
                values, at = block_values(hashes, counts, frequent, times)
                held.append((values, ids[at], counts[at].astype(np.int64)))
                if sum(len(x[0]) for x in held) >= WINDOW:
                    yield packed()
        if held and sum(len(x[0]) for x in held):
            yield packed()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes that share a value with one of the size band: they form runs in order of size. Rows come range by range."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        current = None

        def several() -> Iterator[pa.RecordBatch]:
            values, ids, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            order = np.lexsort((ids, sizes, values))
            values, ids, sizes = values[order], ids[order], sizes[order]
            keep = np.ones(len(values), dtype=bool)
            keep[1:] = (values[1:] != values[:-1]) | (ids[1:] != ids[:-1])
            values, ids, sizes = values[keep], ids[keep], sizes[keep]
            starts = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (4 * sizes[:-1] < 3 * sizes[1:]))))
            lengths = np.diff(np.append(starts, len(values)))
            many = np.repeat(lengths > 1, lengths)
            least = np.repeat(np.minimum.reduceat(signed(ids), starts), lengths)
            run = np.repeat(signed(mix(values[starts] + sizes[starts].astype(np.uint64))), lengths)
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(run[many]), pa.array(signed(ids[many])), pa.array(sizes[many]), pa.array(least[many])], ["value", "set_id", "n", "least"])

        for batch in batches:
            for r in range(batch.num_rows):
                part = batch.column(0)[r].as_py()
                if part != current and held:
                    yield from several()
                current = part
                values, classes, sizes = (np.frombuffer(batch.column(k)[r].as_buffer(), t) for k, t in ((1, np.uint64), (2, np.uint64), (3, np.int64)))
                at = np.frombuffer(batch.column(4)[r].as_buffer(), np.uint32)
                held.append((values, classes[at], sizes[at]))
        if held:
            yield from several()

    ranges = docs.select("text").mapInArrow(spread, "part bigint, values binary, classes binary, sizes binary, at binary")
    together = materialise(ranges.repartition("part").sortWithinPartitions("part").mapInArrow(shared, "value bigint, set_id bigint, n bigint, least bigint"), "shared")

    representative = members.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    sketches = read.where(F.col("sketch").isNotNull()).groupBy("set_id").agg(F.first("sketch").alias("sketch"))

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, _TEXT):
                hashes, counts = shingle_sets(batch.column(0))
                ends = np.cumsum(counts)
                parts = [hashes[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(parts, pa.binary())], ["set_id", "shingles"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in (4, 5))
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            apart = np.array([hamming(x, y) for x, y in zip(a, b, strict=True)], dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(7 * apart <= n + m))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for r in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[r].as_buffer(), np.uint64) for k in (2, 3))
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                keep[r] = 100 * common >= 75 * (len(a) + len(b) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    def similar(pairs: DataFrame) -> DataFrame:
        """The similar ones of the pairs (u, v, n of u, m of v)."""
        a = sketches.select(F.col("set_id").alias("u"), F.col("sketch").alias("us"))
        b = sketches.select(F.col("set_id").alias("v"), F.col("sketch").alias("vs"))
        in_band = pairs.where(4 * F.least("n", "m") >= 3 * F.greatest("n", "m"))
        hits = materialise(in_band.join(a, "u").join(b, "v").select("u", "v", "n", "m", "us", "vs").mapInArrow(near, "u bigint, v bigint"), "near")
        nodes = hits.select(F.col("u").alias("set_id")).union(hits.select("v")).distinct()
        wanted = materialise(representative.join(nodes, "set_id", "left_semi").select("set_id", F.col("r.doc_id").alias("r_doc"), F.col("r.text_hash").alias("r_hash")), "wanted")
        few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        chosen = docs.join(few, docs["doc_id"].eqNullSafe(F.col("r_doc")) & (docs["text_hash"] == F.col("r_hash"))).select("text", "set_id")
        sets = chosen.mapInArrow(collect_sets, "set_id bigint, shingles binary").groupBy("set_id").agg(F.first("shingles").alias("shingles"))
        sets = materialise(sets, "shingles")
        a = sets.select(F.col("set_id").alias("u"), F.col("shingles").alias("us"))
        b = sets.select(F.col("set_id").alias("v"), F.col("shingles").alias("vs"))
        return materialise(hits.join(a, "u").join(b, "v").select("u", "v", "us", "vs").mapInArrow(check, "u bigint, v bigint"), "links")

    votes = together.where(F.col("set_id") != F.col("least")).groupBy("set_id", "n", "least").agg(F.count("*").alias("votes"))
    best = votes.groupBy("set_id", "n").agg(F.max_by("least", F.struct("votes", "least")).alias("v"))
    size_of = members.where(F.col("n") > 0).groupBy("set_id").agg(F.max("n").alias("m"))
    links = similar(best.select(F.col("set_id").alias("u"), "v", "n").join(size_of.withColumnRenamed("set_id", "v"), "v").select("u", "v", "n", "m"))

    def compare(sketched: bool, nearest: bool):
        """Pairs of different components in one size band; rows come value by value, in order of size."""

        def pairs(rows: np.ndarray, parts: list[np.ndarray]) -> pa.RecordBatch:
            value, ids, n, groups = rows
            if sketched:
                i, j = within_hamming(value, n, groups, parts, nearest)
            else:
                found = [(live[groups[live] != groups[live + d]], d) for live, d in in_band(value, n, np.arange(len(value)))]
                i = np.concatenate([np.zeros(0, np.int64), *[a for a, _ in found]])
                j = np.concatenate([np.zeros(0, np.int64), *[a + d for a, d in found]])
            swap = ids[i] > ids[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            told = np.unique(np.stack((ids[i], ids[j], n[i], n[j])), axis=1)
            return pa.RecordBatch.from_arrays(list(map(pa.array, told)), ["u", "v", "n", "m"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, parts = np.zeros((4, 0), np.int64), []
            for batch in batches:
                rows = np.concatenate((rows, np.array([batch.column(k).to_numpy() for k in range(4)])), axis=1)
                parts += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(4)] if sketched else []
                # Whole values only: the last one may go on.
                upto = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
                if upto >= 1 << 15:
                    yield pairs(rows[:, :upto], parts[:upto])
                    rows, parts = rows[:, upto:], parts[upto:]
            if rows.shape[1]:
                yield pairs(rows, parts)

        return run

    def labels(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of values that different components share: of small and of large groups."""
        labelled = together.select("value", "set_id", "n").join(found, F.col("set_id") == F.col("node"), "left").select("value", "set_id", "n", F.coalesce("component", "set_id").alias("component"))
        labelled = materialise(labelled, "labelled")
        mixed = labelled.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where(F.col("lo") != F.col("hi"))
        rows = lambda which: labelled.join(mixed.where(which).select("value"), "value", "left_semi")
        large = rows(F.col("members") > LARGE).join(sketches, "set_id").select("value", "set_id", "n", "component", "sketch")
        return rows(F.col("members") <= LARGE).select("value", "set_id", "n", "component"), large

    def proposed(rows: DataFrame, sketched: bool, nearest: bool) -> DataFrame:
        return rows.repartition("value").sortWithinPartitions("value", "n", "set_id").mapInArrow(compare(sketched, nearest), "u bigint, v bigint, n bigint, m bigint")

    found = components(links)
    # Proposals only join what belongs together before all pairs are looked at, so some of the values serve.
    some = F.pmod(F.xxhash64("value"), F.lit(8)) == 0
    for _ in range(PROPOSALS):
        nearer = similar(proposed(labels(found)[1].where(some), True, True).distinct())
        links = links.union(nearer)
        found = components(links)
    small, large = labels(found)
    more = similar(proposed(small, False, False).union(proposed(large, True, False)).distinct())
    found = components(links.union(more))

    classes = members.where(F.col("n") > 0).groupBy("set_id").agg(F.min("doc_id").alias("least_doc"))
    grouped = classes.join(found, F.col("set_id") == F.col("node"), "left").select("set_id", "least_doc", F.coalesce("component", "set_id").alias("c2"))
    grouped = materialise(grouped, "grouped")
    lowest = grouped.groupBy("c2").agg(F.min("least_doc").alias("component_id"))
    by_class = grouped.join(lowest, "c2").select("set_id", "component_id", F.col("c2").alias("component"))
    out = members.join(by_class, "set_id", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")
