"""Comparing the members of cells, large cells in blocks, without emitting pairs.

A cell whose members may link is dealt to groups of bounded size: with ``T``
tiles a member goes to the ``T`` groups ``(t, u)`` that its tile is part of,
and every two members meet in one group.  What leaves a group is bounded by
its members: counts, and edges to the smallest member linked in the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(members: DataFrame, cell: str, spread: str, tile_rows: int, weight: str | None = None, tile_weight: int = 1) -> DataFrame:
    """``members`` with ``g``, the group, and ``side``: 0 or 1 in a group of two tiles, 2 alone.

    ``spread`` is a hash column by which members of a cell are dealt to tiles.
    Cell sizes are counted, never assumed.  With ``weight``, a column, a tile
    has ``tile_weight`` of it at most, on average.
    """
    heavy = F.sum(weight) / F.lit(tile_weight) if weight else F.lit(0.0)
    sizes = members.groupBy(cell).agg(F.count("*").alias("n_in_cell"), heavy.alias("heavy")).where("n_in_cell > 1")
    tiles = F.ceil(F.greatest(F.col("n_in_cell") / F.lit(tile_rows), "heavy")).cast("int")
    at = members.join(sizes.withColumn("n_tiles", tiles), cell).withColumn("t", F.pmod(F.col(spread), F.col("n_tiles")).cast("int"))
    dealt = at.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    return dealt.select(
        *members.columns,
        F.xxhash64(cell, F.least("t", "u"), F.greatest("t", "u")).alias("g"),
        F.when(F.col("t") == F.col("u"), 2).when(F.col("t") < F.col("u"), 0).otherwise(1).alias("side"),
    )


def each_group(
    dealt: DataFrame,
    body: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
    rows: int = 100_000,
    held_bytes: int = 1 << 30,
) -> DataFrame:
    """Run ``body(table, starts)`` over whole groups: ``table`` is sorted by ``g`` and ``starts`` has where each group begins.

    Groups come many at a time, so small ones cost no call each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) < rows and sum(x.nbytes for x in held) < held_bytes:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1], "left"))
            if last:
                yield from _with_starts(body, table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield from _with_starts(body, pa.Table.from_batches(held).combine_chunks())

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)


def _with_starts(body, table: pa.Table) -> Iterator[pa.RecordBatch]:
    g = table.column("g").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    yield from body(table, starts)


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of each ``i`` and ``j`` in place; a label is the smallest position of a component."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def spanning(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`merge`; returns those of the pairs that joined components, fewer than there are positions."""
    taken_i, taken_j = [], []
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        # Each component takes one pair that leads to a smaller one.
        roots, at = np.unique(high, return_index=True)
        taken_i.append(i[at])
        taken_j.append(j[at])
        labels[roots] = low[at]
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
    empty = np.empty(0, np.int64)
    return (np.concatenate(taken_i), np.concatenate(taken_j)) if taken_i else (empty, empty)
