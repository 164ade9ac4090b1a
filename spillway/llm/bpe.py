"""Byte-level BPE over distinct words.

Texts are split into pre-tokens by Spark. Each task gathers the pre-tokens of its documents into blocks: the distinct
words of a block, and for each position of each document the number of its word. The words of all blocks are dealt out by
hash; where they arrive, each distinct word is encoded once, and its ids go back to every block that asked. There the ids
are put in each position's place. So a word is encoded once however often it occurs, frequent words travel once per
block rather than once per position, and positions never travel but packed in their block.

A block is named by a hash of its content and is made in both branches of the job: a block that is made differently when
a task is repeated finds no ids under its name and encodes its words itself, with the same result. Decoding looks every id
up in the table of token bytes, whose size is that of the vocabulary.

Defined cases: a null or empty text has no ids; repeated rows are encoded alike; null doc_ids stay null; extra columns are
ignored; empty in, empty out. Letters and digits are those of the JVM's Unicode version.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import ragged, small_batches, text_of

#: Positions of a block, about.
BLOCK = 1 << 20
_SPACE = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def java_pattern(pattern: str) -> str:
    r"""The pattern with white space spelt out: \s means less in Java."""
    out = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    return out


class _Block:
    """Documents that are packed together."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.pieces: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: pa.Array, pieces: pa.ListArray) -> None:
        self.ids.append(ids)
        self.counts.append(pieces.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        coded = pieces.flatten().dictionary_encode()
        self.pieces.append(coded)
        self.size += len(coded)

    def done(self) -> tuple[int, list[bytes], np.ndarray, pa.Array, np.ndarray]:
        """Name, distinct words, the word of each position, ids and lengths of the documents."""
        coded = pa.chunked_array(self.pieces).unify_dictionaries().combine_chunks() if self.pieces else None
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        counts = np.concatenate(self.counts)
        name = xxhash.xxh3_64(at.tobytes())
        name.update(counts.tobytes())
        name.update(b"\0".join(words))
        return name.intdigest() - (1 << 63), words, at, pa.concat_arrays(self.ids), counts


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[bytes], np.ndarray, pa.Array, np.ndarray]]:
    block = _Block()
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            block.add(part.column(0), part.column(1))
            if block.size >= size:
                yield block.done()
                block = _Block()
    if block.ids:
        yield block.done()


def _bins(words: list[bytes], n: int) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) % n for w in words), dtype=np.int64, count=len(words))


def encode(docs: DataFrame, ranks_path: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, as binary) of every row of docs (doc_id, text)."""
    import tiktoken

    ranks = load_ranks(ranks_path)
    packed_ranks = b"".join(len(k).to_bytes(4, "little") + k + v.to_bytes(4, "little") for k, v in ranks.items())
    spark = docs.sparkSession
    n_bins = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    made: dict[str, object] = {}

    def encoder():
        if "core" not in made:
            found, at = {}, 0
            while at < len(packed_ranks):
                n = int.from_bytes(packed_ranks[at : at + 4], "little")
                found[packed_ranks[at + 4 : at + 4 + n]] = int.from_bytes(packed_ranks[at + 4 + n : at + 8 + n], "little")
                at += 8 + n
            made["core"] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=found, special_tokens={})._core_bpe
        return made["core"].encode_single_piece

    pieces = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_extract_all(text_of(), F.lit(java_pattern(pattern)), F.lit(0)).alias("pieces"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for name, words, *_ in _blocks(batches, block):
            bins = _bins(words, n_bins)
            order = np.argsort(bins, kind="stable")
            starts = np.searchsorted(bins[order], np.arange(n_bins + 1))
            out = []
            for b in range(n_bins):
                mine = [words[k] for k in order[starts[b] : starts[b + 1]]]
                if mine:
                    out.append((b, name, pack(np.array([len(w) for w in mine], "<u4").tobytes()), pack(b"".join(mine))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bin", "block", "lengths", "words"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come bin by bin: a distinct word is encoded once."""
        import zstandard

        one, pack, unpack = encoder(), zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        current, known = None, {}
        for batch in batches:
            out = []
            for b, name, lengths, words in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b != current:
                    current, known = b, {}
                lengths, words = np.frombuffer(unpack(lengths), "<u4"), unpack(words)
                ends = np.cumsum(lengths.astype(np.int64)).tolist()
                found, at = [], 0
                for e in ends:
                    w = words[at:e]
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = one(w)
                    found.append(ids)
                    at = e
                counts = np.array([len(x) for x in found], "<u4")
                out.append((name, b, pack(counts.tobytes()), pack(np.array([i for x in found for i in x], "<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "bin", "counts", "ids"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for name, words, at, ids, counts in _blocks(batches, block):
            # Frequent words get small numbers, which pack well.
            times = np.bincount(at, minlength=len(words))
            by_times = np.argsort(-times, kind="stable").astype(np.int32)
            small = np.empty(len(words), dtype=np.int32)
            small[by_times] = np.arange(len(words), dtype=np.int32)
            row = [name, ids.to_pylist(), pack(counts.tobytes()), pack(small[at].tobytes()), pack(by_times.tobytes()), pack(np.array([len(w) for w in words], "<u4").tobytes()), pack(b"".join(words))]
            types = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["block", "doc_ids", "lengths", "at", "numbers", "sizes", "words"])

    def assemble(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        doc_ids, texts = [], []
        for row in blocks.to_pylist():
            sizes, blob = np.frombuffer(unpack(row["sizes"]), "<u4").astype(np.int64), unpack(row["words"])
            ends = np.cumsum(sizes)
            words = [blob[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            bins = _bins(words, n_bins)
            order = np.argsort(bins, kind="stable")
            parts = {b: (c, i) for b, c, i in zip(answers["bin"].to_pylist(), answers["counts"].to_pylist(), answers["ids"].to_pylist(), strict=True)}
            lengths = np.zeros(len(words), dtype=np.int64)
            if parts or not words:
                got = [(np.frombuffer(unpack(parts[b][0]), "<u4"), np.frombuffer(unpack(parts[b][1]), "<u4")) for b in sorted(parts)]
                counts, ids = (np.concatenate([x[k] for x in got]) if got else np.zeros(0, "<u4") for k in range(2))
            else:  # made differently than the first time
                one = encoder()
                found = [one(words[k]) for k in order]
                counts, ids = np.array([len(x) for x in found]), np.array([i for x in found for i in x], "<u4")
            lengths[order] = counts
            starts = np.zeros(len(words), dtype=np.int64)
            starts[order] = np.cumsum(counts) - counts
            at = np.frombuffer(unpack(row["numbers"]), np.int32)[np.frombuffer(unpack(row["at"]), np.int32)]
            per_doc = np.frombuffer(unpack(row["lengths"]), np.int64)
            cuts = np.concatenate(([0], np.cumsum(lengths[at])))[np.concatenate(([0], np.cumsum(per_doc)))]
            first = 0
            # Some documents at a time: positions take eight bytes each while they are gathered.
            for stop in range(256, len(per_doc) + 256, 256):
                stop = min(stop, len(per_doc))
                a, b = int(per_doc[:first].sum()), int(per_doc[:stop].sum())
                mine = at[a:b]
                flat = np.ascontiguousarray(ids[ragged(starts[mine], lengths[mine])], dtype="<u4").tobytes()
                texts += [flat[4 * (x - cuts[first]) : 4 * (y - cuts[first])] for x, y in zip(cuts[first:stop].tolist(), cuts[first + 1 : stop + 1].tolist(), strict=True)]
                first = stop
            doc_ids += row["doc_ids"]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(texts, pa.binary())})

    asked = pieces.mapInArrow(ask, "bin bigint, block bigint, lengths binary, words binary")
    answers = asked.repartition("bin").sortWithinPartitions("bin").mapInArrow(answer, "block bigint, bin bigint, counts binary, ids binary")
    carried = pieces.mapInArrow(carry, "block bigint, doc_ids array<bigint>, lengths binary, at binary, numbers binary, sizes binary, words binary")
    return carried.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (doc_id, ids) with decoded: the bytes of all its ids."""
    ranks = load_ranks(ranks_path)
    table = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        table[v] = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")
