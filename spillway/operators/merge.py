"""Merging any number of runs into one order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from spillway.plans.spec import Ordering

from .order import sort, with_position


def union(runs: list[DataFrame]) -> DataFrame:
    if not runs:
        raise ValueError("nothing to merge")
    return reduce(DataFrame.unionByName, runs)


def merge(runs: list[DataFrame], ordering: Ordering, position: str | None = None, strict_empty: bool = False) -> DataFrame:
    """All records of all runs in order, in one pass: Spark's sorter merges as many spills as there are.

    One run is its own result, and empty runs add nothing. Runs are never consumed. They need not be sorted, as a range
    exchange sorts anew what it deals out. With strict_empty, runs without any record raise.
    """
    both = union(runs)
    if strict_empty and both.isEmpty():
        raise ValueError("nothing to merge")
    return with_position(both, ordering, position) if position else sort(both, ordering)
