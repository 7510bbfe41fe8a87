"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Equal vectors are one class.  A unit vector ``u`` is held as int8 ``q`` with
its own scale, ``u = q / s + e``, and the norm of its error ``e`` is measured.
For two vectors ``|u.v - (q_u.q_v) / (s_u s_v)| <= |e_u| + (1 + |e_u|) |e_v|``,
so a pair whose int8 product lies under the threshold by more than that cannot
link; only the others are computed again, in double precision.

Classes go to the cell of their nearest pivot.  A class must also meet a
cell's members if its angle to the pivot is at most the cell's radius plus the
threshold's angle, else no member can be near enough: it is sent there as a
guest, from later to earlier cells only, so each pair is compared once.  Cells
are dealt in tiles of ``TILE_VALUES`` numbers; a group returns link counts and edges to
a smallest member, never pairs.

Pivots are a sample of classes, at most ``max_pivots``: they steer the work,
not the result.  Null, zero, and null- or non-finite-holding vectors, and rows
with a null id, link with nothing; vectors of different length never link.
Repeated rows are in one class.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathframe.llm.common import connected_components, cut
from pathframe.llm.tiles import each_group, merge

#: Numbers in a tile, and rows of it at least and at most: a class is sent once for each tile of its cell, so tiles are as large as a task can hold.
TILE_VALUES, TILE_ROWS = 1 << 20, (1024, 1 << 16)
#: Cells up to which their sizes are broadcast, at 24 bytes each.
MAX_BROADCAST_CELLS = 100_000
#: Products of so many int8 pairs add up exactly in float32.
EXACT_DIMS = 1024
#: Room for rounding in float64 sums and angles.
SLACK = 1e-6


def _tile_rows(dim: int) -> int:
    return int(min(max(TILE_VALUES / dim, TILE_ROWS[0]), TILE_ROWS[1]))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32 for the matrix product), inverse scales and error norms of unit rows."""
    top = np.abs(units).max(axis=1)
    step = np.where(top > 0, top, 1.0) / 127
    codes = np.rint(units / step[:, None])
    error = np.linalg.norm(units - codes * step[:, None], axis=1)
    return codes.astype(np.int8), step, error + 1e-12


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows."""
    out = None
    for k in range(0, a.shape[1], EXACT_DIMS):
        part = a[:, k : k + EXACT_DIMS].astype(np.float32) @ b[:, k : k + EXACT_DIMS].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def linked(x: np.ndarray, y: np.ndarray, threshold: float, chunk: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, rows, columns)`` of the pairs of ``x`` and ``y`` with cosine at or over ``threshold``."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex = quantise(x / nx[:, None])
    qy, sy, ey = quantise(y / ny[:, None])
    # q_u.q_v >= (threshold - bound) / (s_u s_v), row by row with the largest bound of the tile first.
    worst = ey.max(initial=0.0)
    for k in range(0, len(x), chunk):
        rows = slice(k, k + chunk)
        near = tile_products(qx[rows], qy) * sy.astype(np.float32)
        floor = (threshold - SLACK - ex[rows] - (1 + ex[rows]) * worst) / sx[rows] - 1e-3
        i, j = np.nonzero(near >= floor[:, None].astype(np.float32))
        if len(i):
            a, b = i + k, j
            keep = near[i, j].astype(np.float64) * sx[a] >= threshold - SLACK - ex[a] - (1 + ex[a]) * ey[b]
            a, b = a[keep], b[keep]
            for s in range(0, len(a), 1 << 18):
                u, v = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
                cosine = np.einsum("ij,ij->i", x[u], y[v]) / (nx[u] * ny[v])
                hit = cosine >= threshold
                yield k, u[hit], v[hit]


def _compare(threshold: float):
    def body(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        stops = np.append(starts[1:], table.num_rows)
        for start, stop in zip(starts, stops, strict=True):
            part = table.slice(start, stop - start)
            side = part.column("side").to_numpy()
            dim = part.column("dim")[0].as_py()
            rep, n = part.column("rep").to_numpy(), part.column("n").to_numpy()
            x = _matrix(part.column("v"), dim)
            alone = bool((side == 2).any())
            left = np.arange(len(x)) if alone else np.flatnonzero(side == 0)
            right = left if alone else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            links = np.zeros(len(x), np.int64)
            labels = np.arange(len(x))
            for _, i, j in linked(x[left], x[right], threshold):
                i, j = left[i], right[j]
                if alone:
                    apart = i != j
                    i, j = i[apart], j[apart]
                    links += np.bincount(i, n[j], len(x)).astype(np.int64)
                else:
                    links += (np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))).astype(np.int64)
                merge(labels, i, j)
            found = np.flatnonzero(links)
            yield pa.record_batch([pa.array(rep[found]), pa.array(links[found]), pa.array(rep[labels[found]])], names=["rep", "links", "root"])

    return body


def _place(pivots: dict[int, np.ndarray], radii: dict[tuple[int, int], float] | None, angle: float):
    """Give rows their cell and angle; with ``radii`` a row for each cell they must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                n = part.num_rows
                if dim not in pivots:
                    angles = np.zeros((n, 1))
                else:
                    x = _matrix(part.column("v"), int(dim))
                    unit = x / np.linalg.norm(x, axis=1)[:, None]
                    angles = np.arccos(np.clip(unit @ pivots[dim].T, -1, 1))
                cell = angles.argmin(axis=1)
                if radii is None:
                    at, to, core = np.arange(n), cell, np.ones(n, bool)
                else:
                    reach = np.array([radii.get((int(dim), k), -9.0) for k in range(angles.shape[1])]) + angle
                    guest = (angles <= reach + 1e-4) & (np.arange(angles.shape[1]) < cell[:, None])
                    guest[np.arange(n), cell] = True
                    at, to = np.nonzero(guest)
                    core = to == cell[at]
                out = part.take(pa.array(at))
                columns = [out.column(c) for c in ("dim", "v", "rep", "n", "spread")]
                yield pa.record_batch([*columns, pa.array(to.astype(np.int32)), pa.array(core), pa.array(angles[at, to])], names=["dim", "v", "rep", "n", "spread", "cell", "core", "angle"])

    return run


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, id: str = "vec_id", vector: str = "embedding", max_pivots: int = 1024
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``."""
    value = F.col(vector)
    rows = vectors.select(F.col(id).cast("bigint").alias("vec_id"), value.alias("v"))
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    keyed = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    keyed = keyed.withColumn("k1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(7), "v")))
    classes = cut(
        keyed.where("ok")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
        .withColumn("dim", F.size("v"))
        .withColumn("spread", F.xxhash64("k1"))
    )
    n = classes.count()
    wanted = min(max_pivots, math.ceil(n / _tile_rows(classes.agg(F.max("dim")).first()[0] or 1)))
    pivots: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("k2"), "k1").limit(wanted).collect() if wanted > 1 else []:
        x = np.array(r.v, np.float64)
        pivots.setdefault(r.dim, []).append(x / np.linalg.norm(x))
    units = {d: np.array(p) for d, p in pivots.items()}
    angle = math.acos(max(-1.0, min(1.0, threshold)))
    kind = classes.schema["v"].dataType.simpleString()
    schema = f"dim int, v {kind}, rep bigint, n bigint, spread bigint, cell int, core boolean, angle double"
    placed = classes.select("dim", "v", "rep", "n", "spread")
    radii = {
        (r.dim, r.cell): r.r
        for r in placed.mapInArrow(_place(units, None, angle), schema).groupBy("dim", "cell").agg(F.max("angle").alias("r")).collect()
    } if units else {}
    members = cut(placed.mapInArrow(_place(units, radii, angle), schema).drop("angle"))
    sizes = members.groupBy("dim", "cell").agg(F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_guest"))
    tiles = lambda c: F.ceil(F.col(c) / F.least(F.greatest(F.lit(TILE_VALUES) / F.col("dim"), F.lit(TILE_ROWS[0])), F.lit(TILE_ROWS[1]))).cast("int")
    sizes = cut(sizes.withColumn("tc", tiles("n_core")).withColumn("tg", tiles("n_guest")))
    at = members.join(F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST_CELLS else sizes, ["dim", "cell"])
    at = at.withColumn("t", F.pmod("spread", F.when(F.col("core"), F.col("tc")).otherwise(F.col("tg"))).cast("int"))
    zero, none = F.lit(0), F.array().cast("array<int>")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(zero, F.col(c) - 1)).otherwise(none)
    # (first tile, second tile, whether the second is of guests, side)
    own = F.transform(
        upto("tc"),
        lambda u: F.struct(
            F.least("t", u).alias("a"),
            F.greatest("t", u).alias("b"),
            F.lit(False).alias("guests"),
            F.when(F.col("t") == u, 2).when(F.col("t") < u, 0).otherwise(1).alias("side"),
        ),
    )
    hosts = F.transform(upto("tg"), lambda u: F.struct(F.col("t").alias("a"), u.alias("b"), F.lit(True).alias("guests"), F.lit(0).alias("side")))
    visits = F.transform(upto("tc"), lambda u: F.struct(u.alias("a"), F.col("t").alias("b"), F.lit(True).alias("guests"), F.lit(1).alias("side")))
    groups = F.explode(F.when(F.col("core"), F.concat(own, hosts)).otherwise(visits))
    dealt = at.withColumn("x", groups).select(
        F.xxhash64("dim", "cell", "x.a", "x.b", "x.guests").alias("g"), F.col("x.side").alias("side"), "dim", "v", "rep", "n"
    )
    found = cut(each_group(dealt, _compare(threshold), "rep bigint, links bigint, root bigint", rows=20_000))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.select("k1", "k2", "rep", "n")
        .join(counts, "rep", "left")
        .join(parts, F.col("rep") == F.col("node"), "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    joined = keyed.select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"], "left")
    component = F.coalesce("c", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
