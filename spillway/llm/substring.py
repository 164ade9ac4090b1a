"""Substring removal by relative Lempel-Ziv parsing.

The reference is made of blocks of WINDOW words: of every word sequence of that length, the place where it stands first
(smallest doc_id, then first position). A document is parsed greedily from its first word: where a block of it is indexed
under a smaller doc_id, a factor starts, and it is as long as the words go on like the reference does, block after block at
the following place; else the word is a literal. Where a factor ends, the blocks that lie across its end are checked, as
they may stand elsewhere in the reference; the first one found starts the next factor, so that nothing is lost there.
Factors have WINDOW words or more, and the words they cover are the duplicate spans.

The index is spread over the cluster: no task or reader holds a reference. Blocks are hashed to 64 bits. Which of them are
worth indexing is told by anchors: among the word 8-grams of a block the one of smallest hash is its anchor, so two equal
blocks have equal anchors, about one for 20 words.

1. Equal texts are one class; its smallest doc_id represents it. All other rows of it are one factor.
2. Anchors of different classes are matched; only blocks whose anchor occurs in two classes or more go on.
3. Their hashes are indexed with the place where each stands first: minima combine before the shuffle, so a passage in
   every document is one row per task. Index and blocks are joined by hash from two tables, which Spark can split where
   a hash is very frequent.
4. Each text is parsed against the places that its blocks were found at, in one task: as many rows as it has words.

Defined cases: null texts have no words; texts of under 50 words are kept whole; rows with null doc_id are kept whole and
are no references; rows with equal doc_id are no references of each other; extra columns are kept; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialise, mix, ragged, run_hashes, signed, slices, small_batches, text_of, word_hashes

WINDOW, GRAM = 50, 8
_TEXT = 2 << 20


def anchored(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window inside a text, and the hash of its anchor."""
    counts = np.diff(first)
    starts = ragged(first[:-1], np.maximum(counts - window + 1, 0))
    grams = run_hashes(words, GRAM)
    span = window - GRAM + 1
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    # Smallest of each run of `span`: of a block's end and of the next block's start.
    padded = np.full(-(-len(grams) // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(grams)] = grams
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return starts, np.minimum(behind[starts], ahead[starts + span - 1])


def parse(at: np.ndarray, refs: np.ndarray, ref_at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, length, reference document and first word there of each factor, in order.

    at: the words at which a block of the text starts that is in the index; refs and ref_at: where it stands there. A block
    goes on with the factor of the one before if it stands at the next word of both. Greedy parsing resumes at a factor's
    end, but for the check of the blocks across it: so each block that doesn't go on with a factor starts one.
    """
    at, firsts = np.unique(at, return_index=True)
    refs, ref_at = refs[firsts], ref_at[firsts]
    if not len(at):
        return at, at, refs, ref_at
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(refs) != 0) | (np.diff(ref_at) != 1))))
    blocks = np.diff(np.append(new, len(at)))
    return at[new], blocks + window - 1, refs[new], ref_at[new]


def covered(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """First word and end of each stretch that factors cover, where they touch or overlap as one."""
    if not len(starts):
        return []
    ends = np.maximum.accumulate(starts + lengths)
    apart = np.flatnonzero(starts[1:] > ends[:-1])
    return list(zip(starts[np.concatenate(([0], apart + 1))].tolist(), ends[np.concatenate((apart, [len(ends) - 1]))].tolist(), strict=True))


def _hits_of(listed: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(listed.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))


def _looked_up(docs: DataFrame, window: int) -> DataFrame:
    """class, first_id (its smallest doc_id) and hits (at, ref, ref_at) of every distinct text with an id."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("class", F.xxhash64("text"))
    numbered = rows.where(F.col("doc_id").isNotNull())
    first_ids = numbered.groupBy("class").agg(F.min("doc_id").alias("first_id"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, 0, _TEXT):
                names = batch.column(1).to_numpy()
                _, firsts = np.unique(names, return_index=True)
                take = sorted(i for i in firsts.tolist() if names[i] not in seen)
                seen.update(names[take].tolist())
                batch = batch.take(pa.array(take, pa.int64()))
                words, _, _, first, _ = word_hashes(batch.column(0))
                starts, values = anchored(words, first, window)
                doc = np.searchsorted(first, starts, "right") - 1
                keep = np.ones(len(values), dtype=bool)
                keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(values[keep])), pa.array(names[take][doc[keep]])], ["anchor", "class"])

    anchor_rows = numbered.select("text", "class").mapInArrow(anchors, "anchor bigint, class bigint")
    anchor_rows = materialise(anchor_rows, "anchors")
    shared = materialise(anchor_rows.groupBy("anchor").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where(F.col("lo") != F.col("hi")).select("anchor"), "shared")
    by_class = anchor_rows.join(shared, "anchor", "left_semi").groupBy("class").agg(F.collect_set("anchor").alias("anchors"))
    wanted = by_class.join(first_ids, "class").select(F.col("class").alias("w_class"), "first_id", "anchors")
    blocks = numbered.join(wanted, (F.col("class") == F.col("w_class")) & (F.col("doc_id") == F.col("first_id"))).select("text", "doc_id", "class", "anchors")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, 0, _TEXT):
                # Rows of one id and text come to one task: the first will do.
                names = batch.column(2).to_numpy()
                _, firsts = np.unique(names, return_index=True)
                take = sorted(i for i in firsts.tolist() if names[i] not in seen)
                seen.update(names[take].tolist())
                batch = batch.take(pa.array(take, pa.int64()))
                words, _, _, first, _ = word_hashes(batch.column(0))
                starts, values = anchored(words, first, window)
                doc = np.searchsorted(first, starts, "right") - 1
                listed = batch.column(3)
                lengths = listed.value_lengths().to_numpy()
                # An anchor of one document may be shared while its like in another is not: they are matched by pair.
                own = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), lengths)
                pair = mix(listed.flatten().to_numpy().view(np.uint64) + mix(own))
                keep = np.isin(mix(values + mix(doc.astype(np.uint64))), pair)
                hashes = run_hashes(words, window)[starts[keep]]
                doc = doc[keep]
                ids, classes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(ids[doc]), pa.array(classes[doc]), pa.array((starts[keep] - first[doc]).astype(np.int32))], ["seed", "doc_id", "class", "at"])

    found = materialise(blocks.mapInArrow(seeds, "seed bigint, doc_id bigint, class bigint, at int"), "seeds")
    place = F.struct("doc_id", "class", "at")
    index = found.groupBy("seed").agg(F.min(place).alias("first"), F.max("doc_id").alias("hi")).where(F.col("first.doc_id") < F.col("hi"))
    index = materialise(index.select("seed", F.col("first.doc_id").alias("ref"), F.col("first.at").alias("ref_at")), "index")
    hits = found.join(index, "seed").where(F.col("doc_id") > F.col("ref"))
    by_class = hits.groupBy("class").agg(F.collect_list(F.struct("at", "ref", "ref_at")).alias("hits"))
    return first_ids.join(by_class, "class", "left")


def _with_hits(docs: DataFrame, columns: list[str], window: int) -> DataFrame:
    """The columns of docs, then first_id and hits of its class, its text and doc_id."""
    known = _looked_up(docs, window).select(F.col("class").alias("_spw_class"), F.col("first_id").alias("_spw_first"), F.col("hits").alias("_spw_hits"))
    joined = docs.withColumn("_spw_own", F.xxhash64(text_of())).join(known, F.col("_spw_own") == F.col("_spw_class"), "left")
    return joined.select(*columns, "_spw_first", "_spw_hits", text_of().alias("_spw_text"), F.col("doc_id").cast("bigint").alias("_spw_id"))


def _factors_of(n: int, own: int | None, first: int | None, listed: pa.Scalar, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The factors of a text of n words: of a copy of a text with a smaller id it is one factor."""
    if own is not None and first is not None and own > first and n >= window:
        return tuple(np.array([x], dtype=np.int64) for x in (0, n, first, 0))
    usable = own is not None and own == first and listed.is_valid
    return parse(*(_hits_of(listed) if usable else [np.zeros(0, np.int64)] * 3), window)


def factorise(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ref_doc and ref_start (words) of each factor of docs (doc_id, text)."""
    joined = _with_hits(small_batches(docs), [], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, _TEXT):
                counts = np.diff(word_hashes(batch.column(2))[3]).tolist()
                found = [_factors_of(n, own, first, listed, window) for n, own, first, listed in zip(counts, batch.column(3).to_pylist(), batch.column(0).to_pylist(), batch.column(1), strict=True)]
                own = pa.array(np.repeat(np.array([x or 0 for x in batch.column(3).to_pylist()], dtype=np.int64), [len(x[0]) for x in found]))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(np.concatenate([x[k] for x in found])) for k in range(4))], ["doc_id", "start", "length", "ref_doc", "ref_start"])

    return joined.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ref_doc bigint, ref_start bigint")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, n_factors, kept_words (by single spaces) and kept_text (as it stood, without the factors)."""
    names = ("n_words", "n_removed", "n_factors", "kept_words", "kept_text")
    columns = [c for c in docs.columns if c not in names]
    docs = small_batches(docs).select(*columns)
    joined = _with_hits(docs, columns, window)
    schema = docs.schema
    for name, kind in zip(names, ("long", "long", "long", "string", "string"), strict=True):
        schema = schema.add(name, kind)
    width = len(columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, width + 2, _TEXT):
                first_id, listed, text, ids = (batch.column(width + k) for k in range(4))
                counts, gone, told, kept_words, kept_text = [], [], [], [], []
                _, starts, ends, first, _ = word_hashes(text)
                offsets = 0
                for r in range(batch.num_rows):
                    t = text[r].as_py()
                    raw = t.encode()
                    a, b = int(first[r]), int(first[r + 1])
                    n = b - a
                    s, e = starts[a:b] - offsets, ends[a:b] - offsets
                    offsets += len(raw) + 1
                    found = _factors_of(n, ids[r].as_py(), first_id[r].as_py(), listed[r], window)
                    spans = covered(found[0], found[1])
                    told.append(len(found[0]))
                    keep_from, words, parts, removed = 0, [], [], 0
                    for i, j in [*spans, (n, n)]:
                        if i > keep_from:
                            words.extend(raw[s[k] : e[k]] for k in range(keep_from, i))
                        keep_from = j
                        removed += j - i
                    at = 0
                    for i, j in spans:
                        parts.append(raw[at : s[i]])
                        at = int(s[j]) if j < n else len(raw)
                    parts.append(raw[at:])
                    counts.append(n)
                    gone.append(removed)
                    kept_words.append(b" ".join(words))
                    kept_text.append(b"".join(parts) if spans else raw)
                new = [*(pa.array(x, pa.int64()) for x in (counts, gone, told)), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (kept_words, kept_text))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], [f.name for f in schema])

    return joined.mapInArrow(cut, schema)
