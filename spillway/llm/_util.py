"""What the operators of this subpackage share: tables, scratch space and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a class of a regular expression.
WORD_CLASS = "[^\\x20\\x09-\\x0D]"
GAP_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder serves a
    local session, whose executors are the driver itself; any other session is refused."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spillway-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where the tables that are written just now are noted, if anyone wants to delete them.
_NOTED: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("noted", default=None)


@contextmanager
def noted() -> Iterator[list[tuple[SparkSession, str]]]:
    """Lists the tables that materialise() writes inside the block, for delete(). No other call's tables are in it."""
    tables: list[tuple[SparkSession, str]] = []
    token = _NOTED.set(tables)
    try:
        yield tables
    finally:
        _NOTED.reset(token)


#: Whether shuffle files go when the query that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside the block go at its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage is cut, and lost executors lose nothing. The shuffle
    files of the writing are deleted at once.

    The table stays, as lazy results may read it, unless a caller that noted() it deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spillway-{uuid.uuid4().hex}/{name}"
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    tables = _NOTED.get()
    if tables is not None:
        tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def delete(tables: list[tuple[SparkSession, str]]) -> None:
    """Deletes tables that noted() lists. Only for callers whose results are already stored elsewhere."""
    while tables:
        spark, path = tables.pop()
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows that Spark hands to Python at once: texts are long.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, where Spark's default for rows in a batch is lowered: ten thousand texts can take hundreds of megabytes."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def text_of(name: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, then) -> Column:
    """then(value), with value computed once even if then() uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text has about `most` bytes; one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


# Word hashes -------------------------------------------------------------------------------------------------------
# Polynomial hashes modulo 2**64 of whole arrays: a word's bytes, then runs of word hashes. Every result is mixed, and
# the multipliers are odd, so that prefix sums can be divided again.

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[int(base)] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end byte (in the returned bytes) of each word; first word of each text, with the end; the bytes.

    Null texts have no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))  # a space ends each text
    buffers = joined.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1 if len(data) else np.zeros(0, np.int64)
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is a space, so every word ends
    if lower:
        data = _LOWER[data]
    power, back = _powers(_BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets).astype(np.int64)
    return hashes, starts, ends, first, data


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive words, across texts too: callers skip those."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if size <= 8:
        x = words[:n].copy()
        for k in range(1, size):
            x = x * _WORD_BASE + words[k : k + n]
        return mix(x)
    power, back = _powers(_WORD_BASE, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * back[:n] + np.uint64(size))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1 ..., for each start as many as its length says."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
