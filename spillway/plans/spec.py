"""What a record is, on disk and in Spark, and how records are ordered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spillway.functions.generate import field_values, generate_records, generate_u32
from spillway.functions.text import fields_text, record_text

#: Kind on disk (little-endian), numpy's name, Spark's type.
CODECS = {
    "int8": ("<i1", T.ByteType()),
    "int16": ("<i2", T.ShortType()),
    "int32": ("<i4", T.IntegerType()),
    "int64": ("<i8", T.LongType()),
    "uint8": ("<u1", T.ShortType()),
    "uint16": ("<u2", T.IntegerType()),
    "uint32": ("<u4", T.LongType()),
    "uint64": ("<u8", T.DecimalType(20, 0)),
    "float": ("<f4", T.FloatType()),
    "double": ("<f8", T.DoubleType()),
    "bool": ("|b1", T.BooleanType()),
}


@dataclass(frozen=True)
class Field:
    """A field of a record: its kind is one of CODECS, or char[N] (text up to the first NUL) or bytes[N]."""

    name: str
    kind: str
    offset: int | None = None

    @property
    def length(self) -> int:
        head, _, n = self.kind.partition("[")
        return int(n[:-1]) if head in ("char", "bytes") else 0

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"V{self.length}" if self.length else CODECS[self.kind][0])

    @property
    def spark(self) -> T.DataType:
        if self.length:
            return T.StringType() if self.kind.startswith("char") else T.BinaryType()
        return CODECS[self.kind][1]


@dataclass(frozen=True)
class RecordSpec:
    """Fields one after the other, unless they have offsets; size covers padding.

    A spec also tells how its records are ordered (by the first field), generated (generator(spark, n, seed) gives pos and
    the fields) and shown (formatter(column) gives text, with column(name) as a field's value), unless these are left out.
    """

    fields: tuple[Field, ...]
    size: int | None = None
    ordering: Ordering | None = field(default=None, compare=False)
    generator: Callable[[SparkSession, int, int], DataFrame] | None = field(default=None, compare=False)
    formatter: Callable[[Callable[[str], Column]], Column] | None = field(default=None, compare=False)

    def order(self) -> Ordering:
        return self.ordering or Ordering.of(self.fields[0].name)

    def generate(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """pos (from 0) and the fields of n records."""
        if self.generator:
            return self.generator(spark, n, seed)
        values = [field_values(f.name, f.kind, f.dtype.itemsize, f.length, f.spark, F.col("id"), seed).alias(f.name) for f in self.fields]
        return spark.range(n).select(F.col("id").alias("pos"), *values)

    def shown(self, column: Callable[[str], Column] = F.col) -> Column:
        """A record as text."""
        return self.formatter(column) if self.formatter else fields_text([f.name for f in self.fields], column)

    @property
    def dtype(self) -> np.dtype:
        offsets, at = [], 0
        for f in self.fields:
            at = f.offset if f.offset is not None else at
            offsets.append(at)
            at += f.dtype.itemsize
        size = self.size or max(o + f.dtype.itemsize for o, f in zip(offsets, self.fields, strict=True))
        return np.dtype({"names": [f.name for f in self.fields], "formats": [f.dtype for f in self.fields], "offsets": offsets, "itemsize": size})

    @property
    def record_size(self) -> int:
        return self.dtype.itemsize

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark) for f in self.fields])

    @classmethod
    def parse(cls, text: str) -> RecordSpec:
        """From "value:uint32" or "id:uint32,name:char[32],text:char[64]"."""
        parts = [p.strip().split(":") for p in text.split(",") if p.strip()]
        for p in parts:
            if len(p) != 2 or not (p[1] in CODECS or p[1].partition("[")[0] in ("char", "bytes") and p[1].endswith("]")):
                raise ValueError(f"not a field: {':'.join(p)}")
        return cls(tuple(Field(n, k) for n, k in parts))

    def text(self) -> str:
        return ",".join(f"{f.name}:{f.kind}" for f in self.fields)


@dataclass(frozen=True)
class Key:
    """A column to order by; nulls come last unless told otherwise."""

    column: str
    descending: bool = False
    nulls_first: bool = False

    def sort(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def before(self, a: Column, b: Column) -> Column:
        """Whether value a comes strictly before value b."""
        plain = a > b if self.descending else a < b
        null = a.isNull() & b.isNotNull() if self.nulls_first else a.isNotNull() & b.isNull()
        return F.when(a.isNull() | b.isNull(), null).otherwise(plain)


@dataclass(frozen=True)
class Ordering:
    """Keys, the first the most significant; then tie-breakers, which order records that the keys leave equal.

    Records of equal keys may come in any order, so tie-breakers are allowed; they also let equal keys be spread over
    several partitions.
    """

    keys: tuple[Key, ...]
    tie_breakers: tuple[Key, ...] = field(default=())

    @classmethod
    def of(cls, *columns: str, ties: tuple[str, ...] = ()) -> Ordering:
        """Columns by name, descending with a leading minus."""
        key = lambda c: Key(c[1:], True) if c.startswith("-") else Key(c)
        return cls(tuple(map(key, columns)), tuple(map(key, ties)))

    def over(self, df: DataFrame) -> Ordering:
        """The same, with all other columns that can be ordered as tie-breakers."""
        used = {k.column for k in (*self.keys, *self.tie_breakers)}
        more = [f.name for f in df.schema.fields if f.name not in used and orderable(f.dataType)]
        return Ordering(self.keys, (*self.tie_breakers, *map(Key, more)))

    def check(self, df: DataFrame) -> None:
        for k in (*self.keys, *self.tie_breakers):
            if not orderable(df.schema[k.column].dataType):
                raise TypeError(f"{k.column} can't be ordered: {df.schema[k.column].dataType.simpleString()}")

    def sort(self) -> list[Column]:
        return [k.sort() for k in (*self.keys, *self.tie_breakers)]

    def before(self, a, b) -> Column:
        """Whether the record with columns a(name) comes strictly before b(name), by the keys alone."""
        terms, equal = [], F.lit(True)
        for k in self.keys:
            x, y = a(k.column), b(k.column)
            terms.append(equal & k.before(x, y))
            equal = equal & x.eqNullSafe(y)
        return reduce(lambda p, q: p | q, terms)


U32 = RecordSpec((Field("value", "uint32"),), ordering=Ordering.of("value"), generator=generate_u32)
NAMED = RecordSpec(
    (Field("id", "uint32"), Field("name", "char[32]"), Field("text", "char[64]")),
    ordering=Ordering.of("id"),
    generator=generate_records,
    formatter=lambda column: record_text(column("id"), column("name"), column("text")),
)


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))
