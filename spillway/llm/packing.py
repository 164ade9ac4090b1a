"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

A sequence costs LINEAR per token plus QUADRATIC per squared token of each piece in it (attention is computed within a
piece). Within a buffer of documents, pieces go in order of descending length to the sequence of lowest cost that still
has room; what fits nowhere whole is cut to fill the room that is left, and what is left over goes to the next buffer.
After the last buffer it is cut into sequences whose lengths are powers of two. So nothing is padded, and a task has one
such tail, of less than sequence_length tokens.

Every task packs what it reads, buffer by buffer: no shuffle, memory bounded by the buffer, and a lost task is packed
again alike. Defined cases: a null or empty text is the end-of-document id alone; names of the tokenizer's own tokens in a
text are ids of theirs only where the library takes them so (as they are spelt, in lower case); repeated rows are packed
as often as they occur; a null doc_id stays null; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import ragged, slices, small_batches, text_of

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that are packed together.
BUFFER_TOKENS = 1 << 21
#: Words remembered by a task; beyond them it starts anew.
MEMORY_WORDS = 1 << 20
#: Letters, then ASCII punctuation but for the apostrophe: one or two pre-tokens for sure.
_ONE = r"^\p{L}+$"
_TWO = r"^\p{L}+[!-&(-/:-@\[-`{-~]+$"
_TOKENIZERS: dict[int, object] = {}


class WordEncoder:
    """Ids of texts, of which each distinct word is encoded once.

    White space always separates pre-tokens and is dropped, so the ids of a text are those of its words one after the
    other. Words are compared in lower case, as the tokenizer does, but for those that hold the name of an added token
    in any case: such names are cut out before a text is lowered, so these words stay as they are. Words of one or two
    pre-tokens are encoded many at a time and told apart by the tokens that end a pre-token; others one at a time.
    """

    def __init__(self, tokenizer_json: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = hash(tokenizer_json)
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = Tokenizer.from_str(tokenizer_json)
        self.tokenizer, self.end_id = _TOKENIZERS[key], end_id
        vocabulary = self.tokenizer.get_vocab()
        self.names = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        if any(len(n.split()) != 1 for n in self.names):
            raise ValueError("an added token of the tokenizer holds white space")
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.parts = [np.array([self.end_id], dtype=np.uint32)]  # 0: no id; 1: the end of a document
        self.starts, self.lengths, self.total = [np.array([0, 0])], [np.array([0, 1])], 1

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts.append(self.total + np.cumsum(lengths) - lengths)
        self.parts.append(ids.astype(np.uint32))
        self.lengths.append(lengths)
        self.total += len(ids)

    def _singly(self, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._add(np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64))

    def learn(self, words: pa.Array) -> None:
        one, two = pc.match_substring_regex(words, _ONE), pc.match_substring_regex(words, _TWO)
        kinds = np.where(one.to_numpy(zero_copy_only=False), 1, np.where(two.to_numpy(zero_copy_only=False), 2, 0))
        listed = words.to_pylist()
        order = np.argsort(kinds, kind="stable")
        plain = int((kinds == 0).sum())
        for w in order:
            self.at[listed[w]] = len(self.at) + 1
        if plain:
            self._singly([listed[k] for k in order[:plain]])
        for start in range(plain, len(order), 4096):
            part = order[start : start + 4096]
            texts = [listed[k] for k in part]
            ids = np.array(self.tokenizer.encode(" ".join(texts), add_special_tokens=False).ids, dtype=np.uint32)
            closed = np.flatnonzero(self.ends[ids]) + 1
            if len(closed) != kinds[part].sum() or closed[-1] != len(ids):
                self._singly(texts)
                continue
            last = closed[np.cumsum(kinds[part]) - 1]
            self._add(ids, np.diff(last, prepend=0))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by the end id, and how many each text has."""
        if len(self.at) > MEMORY_WORDS:
            self.reset()
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        as_written = words.flatten()
        lowered = pc.ascii_lower(as_written)
        for name in self.names:
            named = pc.match_substring(lowered, name)
            if pc.any(named).as_py():
                lowered = pc.if_else(named, as_written, lowered)
        coded = lowered.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [k for k, w in enumerate(distinct) if w not in self.at]
        if new:
            self.learn(coded.dictionary.take(pa.array(new)))
        here = np.array([self.at[w] for w in distinct], dtype=np.int64)
        for name in ("parts", "starts", "lengths"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        at = here[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        closes = np.cumsum(per_text)
        at = np.insert(at, closes, 1)
        starts, lengths = self.starts[0][at], self.lengths[0][at]
        ids = self.parts[0][ragged(starts, lengths)]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        edges = sums[np.concatenate(([0], closes + np.arange(1, len(closes) + 1)))]
        return ids, np.diff(edges)


def assign(lengths: np.ndarray, size: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of full sequences for documents of these lengths; what is left
    over (document, start, length), which is less than a sequence; and the number of sequences."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    sequence = 0
    for d, n in enumerate(lengths.tolist()):
        for k in range(n // size):
            pieces.append((d, k * size, size, sequence, 0))
            sequence += 1
        if n % size:
            rest.append((n % size, d, n - n % size))
    count = sum(x[0] for x in rest) // size
    room = np.full(count, size)
    cost = np.zeros(count)

    def put(d: int, start: int, n: int, at: int) -> None:
        pieces.append((d, start, n, sequence + at, size - int(room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n

    whole: list[tuple[int, int, int]] = []
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        open_cost = np.where(room >= n, cost, np.inf)
        at = int(open_cost.argmin()) if count else 0
        if count and open_cost[at] < np.inf:
            put(d, start, n, at)
        else:
            whole.append((d, start, n))
    left: list[tuple[int, int, int]] = []
    by_cost = iter([int(k) for k in np.argsort(cost, kind="stable") if room[k]])
    at = next(by_cost, None)
    for d, start, n in whole:
        while n and at is not None:
            part = min(n, int(room[at]))
            put(d, start, part, at)
            start, n = start + part, n - part
            if not room[at]:
                at = next(by_cost, None)
        if n:
            left.append((d, start, n))
    return pieces, left, sequence + count


def tail(left: list[tuple[int, int, int]], sequence: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces that fill sequences of powers of two, the longest first, and the number of sequences then."""
    pieces: list[tuple[int, int, int, int, int]] = []
    total = sum(x[2] for x in left)
    free, offset = 0, 0
    for d, start, n in left:
        while n:
            if not free:
                free, offset = 1 << (total.bit_length() - 1), 0
                total -= free
                sequence += 1
            part = min(n, free)
            pieces.append((d, start, part, sequence - 1, offset))
            start, n, free, offset = start + part, n - part, free - part, offset + part
    return pieces, sequence


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer_path: str, sequence_length: int = 2048, end_id: int = 1, with_ids: bool = False, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """Pieces of `docs` (doc_id, text), each with its sequence and its offset there; with_ids adds the ids themselves.

    tokenizer_path is a file of the `tokenizers` library; its text goes to the executors with the task.
    sequence_id is unique over the whole result.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_json, end_id)
        # What a buffer holds of each document: its doc_id, ids, how many ids came before them, and how many it has in all.
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        base, used, held = TaskContext.get().partitionId() << 32, 0, 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal kept, held, used
            doc_ids, ids, lengths, before, totals = (np.concatenate([x[k] for x in kept]) for k in range(5))
            begins = np.cumsum(lengths) - lengths
            found, left, used = assign_from(lengths, used)
            if last:
                more, used = tail(left, used)
                found, left = found + more, []
            little = np.ascontiguousarray(ids, dtype="<u4")
            d, start, n, seq, offset = np.array(found, dtype=np.int64).reshape(-1, 5).T
            lo = begins[d] + start
            crc = np.array([zlib.crc32(little[a : a + m]) for a, m in zip(lo.tolist(), n.tolist(), strict=True)], dtype=np.int64)
            columns = [pa.array(doc_ids[d], pa.int64(), from_pandas=True), *map(pa.array, (before[d] + start, n, crc, totals[d], base + seq, offset))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                flat = little[ragged(lo, n)].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat)))
                names.append("ids")
            d, start, n = np.array(left, dtype=np.int64).reshape(-1, 3).T
            kept, held = [(doc_ids[d], little[ragged(begins[d] + start, n)], n, before[d] + start, totals[d])], int(n.sum())
            return pa.RecordBatch.from_arrays(columns, names)

        def assign_from(lengths: np.ndarray, first: int) -> tuple[list, list, int]:
            pieces, left, count = assign(lengths, sequence_length)
            return [(d, start, n, first + seq, offset) for d, start, n, seq, offset in pieces], left, first + count

        for whole in batches:
            for batch in slices(whole, 1):
                ids, lengths = encoder.encode(batch.column(1))
                kept.append((np.array(batch.column(0).to_pylist(), dtype=object), ids, lengths, np.zeros(len(lengths), np.int64), lengths))
                held += len(ids)
                if held >= max(buffer_tokens, sequence_length):
                    yield flush(False)
        if held:
            yield flush(True)

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)
