"""Values as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_text(value: Column) -> Column:
    return value.cast("string")


def record_text(id: Column, name: Column, text: Column) -> Column:
    return F.concat(F.lit("(id = "), id.cast("string"), F.lit("; name = '"), name, F.lit("'; text = '"), text, F.lit("')"))


def memory_text(size: Column, unit: Column) -> Column:
    """Bytes of `size` units (B, K or M)."""
    return (size.cast("bigint") * F.when(unit == "K", 1024).when(unit == "M", 1048576).when(unit == "B", 1)).cast("bigint")


def fields_text(names: list[str], column: Callable[[str], Column]) -> Column:
    """(a = 1; b = 2), or the value alone where there is one field."""
    if len(names) == 1:
        return value_text(column(names[0]))
    parts = [x for n in names for x in (F.lit("; "), F.lit(f"{n} = "), F.coalesce(value_text(column(n)), F.lit("")))]
    return F.concat(F.lit("("), *parts[1:], F.lit(")"))
