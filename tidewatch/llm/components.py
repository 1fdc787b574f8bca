"""Connected components: every task first contracts its own edges; what is left goes through alternating star contractions, or, if
it is little, through one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import stored


FEW_EDGES = 500_000  # of 16 bytes that one task contracts at once
_BATCHED = 1 << 20  # edges that a task contracts at a time


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (vertex, least vertex) of each component, without the least vertex itself."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return names[moved], names[root[moved]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges with the same components."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def out() -> pa.RecordBatch:
        a, b = _contracted(*(np.concatenate(c) for c in zip(*held, strict=True))) if held else (np.zeros(0, np.int64),) * 2
        held.clear()
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
        count += batch.num_rows
        if count > _BATCHED:
            yield out()
            count = 0
    yield out()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the least vertex around it."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least, "a")
    return lower.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
        least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that has an edge, the component being its least vertex.

    Vertices are whole numbers. Edges may repeat, point either way or be loops; loops and edges with a null end are left out.
    """
    rows = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    rows = stored(rows, "edges")
    few = rows.count() <= FEW_EDGES
    rows = stored((rows.coalesce(1) if few else rows).mapInArrow(_stars, "a long, b long"), "stars")
    size = None
    while not few:
        new = stored(_small_star(_large_star(rows)).distinct(), "stars")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        rows = new
        if now == size:
            break
        size = now
    return rows.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        rows.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
