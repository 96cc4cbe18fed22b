"""Column encoders fitted by one aggregation, kept as small state, stored as JSON."""

from __future__ import annotations

import bisect
import datetime
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.sources.registry import Database

MOST_DISTINCT = 100_000  # text values that an ordinal encoder holds; beyond, quantiles of the values


@dataclass
class Numeric:
    """(x - lo) / (hi - lo), 0 for a single value; null encodes as null."""

    lo: float | None
    hi: float | None

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> Numeric:
        r = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
        return cls(r[0], r[1])

    def encode(self, value) -> float | None:
        if value is None or self.lo is None:
            return None
        return 0.0 if self.hi == self.lo else (float(value) - self.lo) / (self.hi - self.lo)

    def decode(self, code: float) -> float:
        return self.lo + code * (self.hi - self.lo)


def _seconds(value) -> float:
    if isinstance(value, str):
        value = datetime.datetime.fromisoformat(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=value.tzinfo or datetime.UTC).timestamp()
    return datetime.datetime(value.year, value.month, value.day, tzinfo=datetime.UTC).timestamp()


@dataclass
class Time(Numeric):
    """Numeric over seconds since 1970 (UTC)."""

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> Time:
        r = df.agg(F.min(column), F.max(column)).first()
        return cls(*(None if v is None else _seconds(v) for v in r))

    def encode(self, value) -> float | None:
        return super().encode(None if value is None else _seconds(value))

    def decode(self, code: float) -> datetime.datetime:
        return datetime.datetime.fromtimestamp(super().decode(code), datetime.UTC).replace(tzinfo=None)


@dataclass
class Text:
    """Share of the distinct values below x; null encodes as -1."""

    values: list[str]

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> Text:
        distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
        n = distinct.count()
        if n > MOST_DISTINCT:  # every k-th value in order
            from planforge.operators.ordered import ordered_scan

            step = n // MOST_DISTINCT + 1
            distinct = ordered_scan(distinct, [F.asc(column)], number="_n").where((F.col("_n") - 1) % step == 0).select(column)
        return cls(sorted(r[0] for r in distinct.collect()))

    def encode(self, value) -> float:
        if value is None:
            return -1.0
        return bisect.bisect_left(self.values, value) / max(len(self.values), 1)

    def decode(self, code: float) -> str | None:
        return None if code < 0 or not self.values else self.values[min(round(code * len(self.values)), len(self.values) - 1)]


KINDS = {"number": Numeric, "time": Time, "text": Text}


def fit_encoder(db: Database, table: str, column: str):
    kind = db.kind(table, column)
    if kind not in KINDS:
        raise TypeError(f"{table}.{column} has no encoder")
    return KINDS[kind].fit(db.table(table), column)


def encoder_json(e) -> str:
    return json.dumps({"kind": next(k for k, c in KINDS.items() if type(e) is c), "state": asdict(e)})


def encoder_from_json(text: str):
    data = json.loads(text)
    return KINDS[data["kind"]](**data["state"])
