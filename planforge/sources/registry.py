"""Tables, their declared keys, and loading.

Parquet has no constraints, so keys are declared here.  Nothing is enforced;
bounds only use them where they make a bound tighter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """A table's primary key (empty: none) and foreign keys {column: (table, column)}."""

    name: str
    key: tuple[str, ...] = ()
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict, hash=False)


@dataclass
class Schema:
    tables: dict[str, TableSpec]

    def is_key(self, table: str, column: str) -> bool:
        return self.tables[table].key == (column,)

    def references(self, child: tuple[str, str], parent: tuple[str, str]) -> bool:
        return self.tables[child[0]].foreign.get(child[1]) == parent

    def edges(self) -> list[tuple[tuple[str, str], tuple[str, str]]]:
        """All declared joins as (child column, parent column)."""
        return [((t.name, c), p) for t in self.tables.values() for c, p in sorted(t.foreign.items())]


STAR = Schema({
    t.name: t
    for t in (
        TableSpec("region", ("r_regionkey",)),
        TableSpec("nation", ("n_nationkey",), {"n_regionkey": ("region", "r_regionkey")}),
        TableSpec("customer", ("c_custkey",), {"c_nationkey": ("nation", "n_nationkey")}),
        TableSpec("supplier", ("s_suppkey",), {"s_nationkey": ("nation", "n_nationkey")}),
        TableSpec("part", ("p_partkey",)),
        TableSpec("orders", ("o_orderkey",), {"o_custkey": ("customer", "c_custkey")}),
        TableSpec("lineitem", (), {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
        TableSpec("events", ("event_id",), {"user_id": ("customer", "c_custkey")}),
    )
})


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Database:
    """Lazily loaded tables of one folder, with their schema."""

    def __init__(self, spark: SparkSession, sf_dir: str, schema: Schema = STAR) -> None:
        self.spark, self.sf_dir, self.schema = spark, sf_dir, schema
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = load(self.spark, self.sf_dir, name)
        return self._tables[name]

    def kind(self, table: str, column: str) -> str:
        """``number``, ``text``, ``time`` or ``other``."""
        t = self.table(table).schema[column].dataType
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, T.StringType):
            return "text"
        return "time" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"

    def prewarm(self, tables: list[str] | None = None) -> list[str]:
        """Caches tables from the smallest to the largest, so the largest are evicted last; returns the order."""
        names = tables or sorted(self.schema.tables)
        sizes = {t: self.table(t).count() for t in names}
        order = sorted(names, key=lambda t: (sizes[t], t))
        for t in order:
            self.table(t).cache().count()
        return order

    def cached_fraction(self, table: str) -> float:
        """Share of a table's cached partitions that are held now; 0 if it is not cached."""
        if not self.table(table).is_cached:
            return 0.0
        infos = [i for i in self.spark.sparkContext._jsc.sc().getRDDStorageInfo() if i.numPartitions()]
        held = [i.numCachedPartitions() / i.numPartitions() for i in infos if table in str(i.name())]
        return max(held, default=1.0)
