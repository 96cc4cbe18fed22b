"""Sets of session settings as bit masks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Hint:
    """A planner feature that can be switched off; ``on`` and ``off`` are settings, ``join`` a join operator that it allows."""

    name: str
    short: str
    on: tuple[tuple[str, str], ...]
    off: tuple[tuple[str, str], ...]
    join: str = ""


def _switch(key: str) -> tuple[tuple[tuple[str, str], ...], tuple[tuple[str, str], ...]]:
    return ((key, "true"),), ((key, "false"),)


#: The lowest bit is the first hint.
CORE = (
    Hint("hash join", "hj", (), (), "hash"),
    Hint("broadcast join", "bj", (("spark.sql.autoBroadcastJoinThreshold", "10485760"),), (("spark.sql.autoBroadcastJoinThreshold", "-1"),), "broadcast"),
    Hint("filter pushdown", "fp", *_switch("spark.sql.parquet.filterPushdown")),
    Hint("aggregate pushdown", "ap", *_switch("spark.sql.parquet.aggregatePushdown")),
    Hint("vectorized reader", "vr", *_switch("spark.sql.parquet.enableVectorizedReader")),
    Hint("whole-stage codegen", "wc", *_switch("spark.sql.codegen.wholeStage")),
)
EXTRA = (
    Hint("adaptive execution", "aq", *_switch("spark.sql.adaptive.enabled")),
    Hint("skew join", "sk", *_switch("spark.sql.adaptive.skewJoin.enabled")),
    Hint("cost-based optimization", "cb", *_switch("spark.sql.cbo.enabled")),
)


@dataclass(frozen=True)
class HintSet:
    """``bits`` has a 1 for each hint that is on."""

    bits: int
    library: tuple[Hint, ...] = CORE

    def __post_init__(self) -> None:
        if not 0 <= self.bits < 1 << len(self.library):
            raise ValueError(f"{self.bits} does not fit {len(self.library)} hints")

    @classmethod
    def all_on(cls, library: tuple[Hint, ...] = CORE) -> HintSet:
        return cls((1 << len(library)) - 1, library)

    @classmethod
    def without(cls, names: list[str], library: tuple[Hint, ...] = CORE) -> HintSet:
        unknown = set(names) - {h.name for h in library}
        if unknown:
            raise ValueError(f"unknown hints {sorted(unknown)}")
        return cls(sum(1 << i for i, h in enumerate(library) if h.name not in names), library)

    def active(self) -> list[bool]:
        return [bool(self.bits >> i & 1) for i in range(len(self.library))]

    def disabled(self) -> list[str]:
        return [h.name for h, on in zip(self.library, self.active(), strict=True) if not on]

    def neighbours(self) -> Iterator[HintSet]:
        """One more hint off, from the lowest bit."""
        for i, on in enumerate(self.active()):
            if on:
                yield HintSet(self.bits & ~(1 << i), self.library)

    def conf(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for h, on in zip(self.library, self.active(), strict=True):
            out |= dict(h.on if on else h.off)
        return out

    def joins(self) -> tuple[str, ...]:
        """Join operators in order of preference; sorting and merging is always possible."""
        return (*(h.join for h, on in zip(self.library, self.active(), strict=True) if on and h.join), "merge")

    def binary(self) -> str:
        return format(self.bits, f"0{len(self.library)}b")

    def __str__(self) -> str:
        return "+".join(h.short for h, on in zip(self.library, self.active(), strict=True) if on) or "none"
