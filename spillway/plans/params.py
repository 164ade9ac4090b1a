"""Parameters of runs, merges and generation, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

UNITS = {"B": 1, "K": 1 << 10, "M": 1 << 20}


def memory_bytes(size: int, unit: str = "M") -> int:
    """`size` units in bytes; units are powers of 1024."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}, not {unit!r}")
    if size < 0:
        raise ValueError("size must not be negative")
    return size * UNITS[unit]


def _at_least(least: int, **values: int) -> None:
    for name, value in values.items():
        if value < least:
            raise ValueError(f"{name} must be at least {least}, not {value}")


@dataclass(frozen=True)
class MemoryParams:
    """Advisory: they set how many records a run has; Spark manages the memory itself."""

    size: int = 10
    unit: str = "M"
    blocks: int = 2

    def __post_init__(self) -> None:
        _at_least(1, blocks=self.blocks)
        memory_bytes(self.size, self.unit)

    def block_records(self, record_size: int) -> int:
        found = memory_bytes(self.size, self.unit) // self.blocks // record_size
        if found < 1:
            raise ValueError(f"a block of {self.size}{self.unit} / {self.blocks} holds no record of {record_size} bytes")
        return found


@dataclass(frozen=True)
class MergeParams:
    """merges and stream_blocks are advisory; fan_in only enters the number of merges that a plan reports."""

    merges: int = 4
    fan_in: int = 4
    stream_blocks: int = 2

    def __post_init__(self) -> None:
        _at_least(1, merges=self.merges, stream_blocks=self.stream_blocks)
        _at_least(2, fan_in=self.fan_in)

    def merge_count(self, runs: int) -> int:
        """Merges of at most fan_in inputs that leave one of `runs`."""
        return max(0, -(-(runs - 1) // (self.fan_in - 1)))


@dataclass(frozen=True)
class GenerateParams:
    size: int = 16
    unit: str = "M"
    seed: int = 0

    def records(self, record_size: int) -> int:
        return memory_bytes(self.size, self.unit) // record_size
