"""Connected components of large graphs by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


PACK = 200_000  # edges that a task holds at once in union-find


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a partition by edges to the smallest node of their local component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in list(parent)]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool, step: str) -> DataFrame:
    """One star operation; ``edges`` (a, b) with a > b, both ways round inside.

    Neighbourhood minima come from a partial aggregation and are written, so
    the join that follows can be split or broadcast by size: no neighbourhood
    is gathered in one place.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialize(least, f"star-{step}")
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), f"star-{step}")
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = materialize(moved.where("a != b").distinct(), f"edges-{step}")
    discard(edges, least)
    return out


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none: stars leave such edges as they are."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    return n == nodes and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its smallest node.

    ``edges``: two long columns; loops, repeated and reversed edges may occur,
    edges with a null end are ignored.  Local union-find first shrinks what
    partitions of about ``PACK`` edges hold; then large-star and small-star alternate until every
    component is a star.  Every round is written to the shared folder, so lineage
    stays short; about log2 of the longest chain rounds are needed.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a != b")
    raw = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-raw")
    packed = raw.coalesce(raw.count() // PACK + 1).mapInArrow(_union_find, "a long, b long")
    e = materialize(packed.where("a != b").distinct(), "edges-0")
    discard(raw)
    for n in range(1, most_rounds + 1):
        if _is_star_forest(e):
            break
        e = _star(_star(e, True, f"{n}-large"), False, f"{n}-small")
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
