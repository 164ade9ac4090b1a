"""Toxicity by compression distance.

Zstandard dictionaries are trained on ordinary and on toxic text. A window (a word with the spaces around it) is compressed
with an ordinary one, and with that and a toxic one; the bytes that the toxic one saves are its distance. How much a text's
windows save, at most and how often, is mapped to a probability by a logistic curve that is fitted on labelled texts that
no dictionary has seen.

Most windows of a toxic text are ordinary, so a toxic dictionary is trained in two steps, both by zstandard. The toxic
texts are halved, and a dictionary is trained on each half. The windows of a half that the other half's dictionary saves
LEAST_SAVED bytes of or more are what toxic texts have in common and ordinary ones lack; the toxic dictionary is trained on
them. As a dictionary holds some rare ordinary words and lacks others by chance, PAIRS of them are trained, each on another
part of the ordinary texts and other halves of the toxic ones, and a window's distance is the median of theirs, or 0 if it
is less or if all toxic dictionaries together save nothing of it (most windows: these are compressed twice only). A fixed
tail, which all dictionaries hold, follows every window, as zstandard neither looks for matches in the last bytes of its
input nor compresses at all what is very short.

Training uses a bounded sample of labelled rows: the TOXIC_ROWS and ORDINARY_ROWS rows of smallest hash of doc_id, as far
as they have SAMPLE_BYTES characters of a class together, and of rows that share a doc_id the one of smallest text; this is
the only part that does not grow with the input. Scores are computed for every text as a whole, window by window, from its
text alone.

Defined cases: null and empty texts have the score of a text that saves nothing; repeated rows are scored alike; with too
few labels of one class every score is 0; null labels are not learned from, and a doc_id with both labels counts as both;
words of over WINDOW bytes are several windows; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import small_batches, text_of

#: Rows of a class that are learned from, at most, and characters of their texts together.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 2000, 4000, 1 << 26
#: Bytes of a window at most, and the level of compression.
WINDOW, LEVEL = 48, 10
#: Bytes of the dictionaries: of ordinary text, of each half of the toxic texts, of what these have in common.
ORDINARY, HALF, TOXIC = 300_000, 112_000, 3072
#: Pairs of dictionaries; an odd number.
PAIRS = 5
#: Bytes that the other half's dictionary must save of a window.
LEAST_SAVED = 2
#: Bytes of the segments that zstandard puts together to a dictionary, and of the strings that it counts.
ORDINARY_SEGMENTS, TOXIC_SEGMENTS = (64, 8), (12, 6)
#: Windows whose length is remembered by a task; beyond them it starts anew.
MEMORY_WINDOWS = 1 << 19
_GAPS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
_TAIL = bytes(range(1, 25))


def windows(text: str) -> list[bytes]:
    """The words of the text in lower case, each with the spaces around it; long ones in parts."""
    words = [f" {w} ".encode() for w in text.translate(_GAPS).lower().split(" ") if w]
    return [w[at : at + WINDOW] for w in words for at in range(0, len(w), WINDOW)]


def _trained(size: int, samples: list[bytes], segments: tuple[int, int]) -> bytes:
    """A dictionary's bytes; where there is too little text to train on, the text itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segments[0], d=segments[1], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class Distance:
    """Compares windows under ordinary dictionaries, and under each with a toxic one."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        import zstandard

        def compressor(content: bytes):
            both = zstandard.ZstdCompressionDict(content + _TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            both.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=both, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        # The ordinary part ends both, so that what it matches costs the same under both.
        self.pairs = [(compressor(ordinary), compressor(toxic + ordinary)) for ordinary, toxic in pairs]
        self.all_toxic = compressor(b"".join(toxic for _, toxic in pairs) + pairs[0][0]) if len(pairs) > 1 else self.pairs[0][1]
        self.known: dict[bytes, int] = {}

    def saved(self, window: bytes) -> int:
        """Bytes that the toxic dictionaries save of a window: the median."""
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= MEMORY_WINDOWS:
                self.known.clear()
            data = window + _TAIL
            found = 0
            if len(self.pairs[0][0](data)) > len(self.all_toxic(data)):
                found = max(0, sorted(len(a(data)) - len(b(data)) for a, b in self.pairs)[len(self.pairs) // 2])
            self.known[window] = found
        return found

    def features(self, text: str) -> list[float]:
        x = np.array([0, 0, *map(self.saved, windows(text))])
        first, second = sorted(np.partition(x, len(x) - 2)[-2:], reverse=True)
        counts = [float(np.log1p((x >= n).sum())) for n in range(1, 7)]
        return [1.0, float(min(first, 9)), float(min(second, 9)), *counts, 10.0 * float((x >= 3).mean()), 10.0 * float((x >= 1).mean()), float(np.log(len(x)))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxic_dictionary(texts: list[list[bytes]], plain: bytes) -> bytes:
    """Trained on the windows of toxic texts (distinct ones of each) that half of these have in common with the other."""
    halves = texts[::2], texts[1::2]
    common: list[bytes] = []
    for own, other in (halves, halves[::-1]):
        distance = Distance([(plain, _trained(HALF, [b"".join(x) for x in other if x], TOXIC_SEGMENTS))])
        common += [b"".join(w for w in x if distance.saved(w) >= LEAST_SAVED) for x in own]
    return _trained(TOXIC, [x for x in common if x], TOXIC_SEGMENTS)


def train(toxic: list[str], ordinary: list[str]) -> dict | None:
    """The pairs of dictionaries and the weights; two thirds of the texts train the dictionaries, the others the curve."""
    if len(toxic) < 6 or len(ordinary) < 3 * PAIRS:
        return None
    parts = [([t for i, t in enumerate(x) if i % 3], [t for i, t in enumerate(x) if not i % 3]) for x in (toxic, ordinary)]
    (toxic_a, toxic_b), (ordinary_a, ordinary_b) = parts
    each = [list(dict.fromkeys(windows(t))) for t in toxic_a]
    pairs = []
    for k in range(PAIRS):
        plain = _trained(ORDINARY, [x for t in ordinary_a[k::PAIRS] for x in _passages(t)], ORDINARY_SEGMENTS)
        order = np.random.default_rng(k).permutation(len(each))
        pairs.append((plain, toxic_dictionary([each[i] for i in order], plain)))
    distance = Distance(pairs)
    x = np.array([distance.features(t) for t in [*toxic_b, *ordinary_b]])
    y = np.array([1.0] * len(toxic_b) + [0.0] * len(ordinary_b))
    return {"pairs": pairs, "weights": fit_logistic(x, y)}


def _passages(text: str, size: int = 512) -> list[bytes]:
    """The whole text, as its windows hold it, in parts of about `size` bytes."""
    out, part, n = [], [], 0
    for w in windows(text):
        part.append(w)
        n += len(w)
        if n >= size:
            out.append(b"".join(part))
            part, n = [], 0
    return [*out, b"".join(part)] if part else out


def bucket(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, sample_bytes: int = SAMPLE_BYTES) -> dict | None:
    """A model from labelled rows (doc_id, toxic) outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (bucket(F.col("doc_id")) != 2)).select(F.col("doc_id").alias("l_id"), "toxic").distinct()
    order = [F.xxhash64("l_id"), F.col("l_id")]
    # Both sides are bounded by the two numbers of rows.
    sample = usable.where(F.col("toxic") == 1).orderBy(*order).limit(toxic_rows).union(usable.where(F.col("toxic") == 0).orderBy(*order).limit(ordinary_rows))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).groupBy("l_id", "toxic").agg(F.min("text").alias("text"))
    so_far = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).orderBy(*order).select("text", "toxic").toArrow()
    texts, toxic = rows["text"].to_pylist(), rows["toxic"].to_pylist()
    return train([t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y])


def score(docs: DataFrame, model: dict | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model["pairs"]) if model else None
        for batch in batches:
            if model:
                x = np.array([distance.features(t) for t in batch.column(1).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(x @ model["weights"], -30, 30)))
            else:
                p = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    scored = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id bigint, score double")
    held_out = F.coalesce(bucket(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
