"""Pairs of vectors with a high cosine, by products of int8 tiles with error bounds.

A unit vector x is stored as x' = scale * q with q in int8, together with
e = |x - x'| and m = |x'|. For two of them, x.y = x'.y' + (x - x').y + x'.(y - y'),
and with |y| = 1 the last two terms are at most e_x + m_x * e_y in size. A tile
product therefore decides every pair but those within that distance of the
threshold, and only these are computed again from the stored vectors in double
precision. Products run in single precision, whose rounding SLACK covers.

Equal vectors are one weighted vertex. Vertices are ordered by their nearest
reference vector and packed in tiles; each pair of tiles is one task. Within a
task, blocks whose centres are further apart than their radii and the threshold
allow are skipped. A task returns sums per vertex and a spanning forest, no pairs.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, components, spanning, table

#: Rows of a tile (one row of the shuffle) and of a block (one product).
TILE, SIDE = 8192, 1024
#: Rounding of a single-precision product of unit vectors with up to some thousand components.
SLACK = 1e-4
#: Reference vectors that order the vertices; they only decide what lies together.
REFERENCES = 8


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, error norms e (rounded up) and norms m of the coded vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    error = np.linalg.norm(unit - coded, axis=1) * (1 + 1e-9) + 1e-12
    return codes, scale, error, np.linalg.norm(coded, axis=1)


def pack_tile(vertex: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> bytes:
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes, scale, error, norm = quantise(unit)
    out = io.BytesIO()
    np.savez(out, vertex=vertex, weight=weight, vectors=vectors, codes=codes, scale=scale, error=error, norm=norm)
    return out.getvalue()


class Tile:
    def __init__(self, data: bytes):
        held = np.load(io.BytesIO(data))
        self.vertex, self.weight, self.vectors = held["vertex"], held["weight"], held["vectors"]
        self.error, self.norm = held["error"], held["norm"]
        self.coded = held["codes"].astype(np.float32) * held["scale"][:, None].astype(np.float32)
        self.blocks = [slice(k, min(k + SIDE, len(self.vertex))) for k in range(0, len(self.vertex), SIDE)]
        self.balls = [self._ball(s) for s in self.blocks]

    def _ball(self, block: slice) -> tuple[np.ndarray, float]:
        """Centre and angle that hold the block's true vectors."""
        x = self.vectors[block].astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centre = x.mean(axis=0)
        size = np.linalg.norm(centre)
        if size < 1e-9:
            return x[0], np.pi
        return centre / size, float(np.arccos(np.clip((x @ (centre / size)).min(), -1, 1))) + 1e-6


def linked(x: Tile, y: Tile, bx: slice, by: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of all pairs at or above the threshold in one block, and how many needed double precision."""
    product = x.coded[bx] @ y.coded[by].T
    ex, mx, ey = x.error[bx], x.norm[bx], y.error[by]
    i, j = np.nonzero(product >= threshold - ex.max() - mx.max() * ey.max() - SLACK)
    value, bound = product[i, j], ex[i] + mx[i] * ey[j] + SLACK
    sure = value - bound >= threshold
    keep = value + bound >= threshold
    doubt = np.flatnonzero(keep & ~sure)
    for k in range(0, len(doubt), 1 << 16):
        part = doubt[k : k + (1 << 16)]
        a, b = x.vectors[bx][i[part]].astype(np.float64), y.vectors[by][j[part]].astype(np.float64)
        cosine = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
        keep[part] = cosine >= threshold
    return i[keep], j[keep], len(doubt)


def forest(i: np.ndarray, j: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) that join what the pairs (i, j) join; at most about rows + columns of them where there are many."""
    if len(i) <= 2 * (rows + cols):
        return i, j
    net = np.zeros((rows, cols), bool)
    net[i, j] = True
    left, open_cols = net.any(axis=1), np.ones(cols, bool)
    a, b = [], []
    while left.any():
        ahead = np.array([int(left.argmax())])
        left[ahead] = False
        while len(ahead):
            sub = net[ahead] & open_cols
            new = np.flatnonzero(sub.any(axis=0))
            a.append(ahead[sub[:, new].argmax(axis=0)])
            b.append(new)
            open_cols[new] = False
            sub = net[:, new] & left[:, None]
            ahead = np.flatnonzero(sub.any(axis=1))
            a.append(ahead)
            b.append(new[sub[ahead].argmax(axis=1)] if len(ahead) else ahead)
            left[ahead] = False
    return np.concatenate(a), np.concatenate(b)


def tile_links(x: Tile, y: Tile, same: bool, threshold: float):
    """Weighted links per vertex and forest edges between two tiles."""
    nx, ny = np.zeros(len(x.vertex)), np.zeros(len(y.vertex))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    widest = np.arccos(threshold)
    for p, (bx, (cx, rx)) in enumerate(zip(x.blocks, x.balls, strict=True)):
        for q, (by, (cy, ry)) in enumerate(zip(y.blocks, y.balls, strict=True)):
            if same and q < p or np.arccos(np.clip(cx @ cy, -1, 1)) - rx - ry > widest + 1e-6:
                continue
            i, j, _ = linked(x, y, bx, by, threshold)
            if same and p == q:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            nx[bx] += np.bincount(i, y.weight[by][j], bx.stop - bx.start)
            ny[by] += np.bincount(j, x.weight[bx][i], by.stop - by.start)
            i, j = forest(i, j, bx.stop - bx.start, by.stop - by.start)
            a.append(x.vertex[bx][i])
            b.append(y.vertex[by][j])
    return nx, ny, *spanning(np.concatenate(a), np.concatenate(b))


def links(points: DataFrame, ws: Workspace, threshold: float, tile: int = TILE) -> DataFrame:
    """(a, b, n) from ``points(vertex, weight, vector, place)``: n is the weight linked to a in one pair of tiles; b, where not NULL, is an edge."""

    def pack(batches):
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def close(rows):
            nonlocal seq
            cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq - 1], pa.int32()), pa.array([pack_tile(*cols)], pa.binary())], ["part", "seq", "tile"])

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), flat.reshape(batch.num_rows, -1)])
            while sum(len(h[0]) for h in held) >= tile:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield close([[c[:tile] for c in cols]])
                held = [[c[tile:] for c in cols]]
        held = [h for h in held if len(h[0])]
        if held:
            yield close(held)

    def join(group: pa.Table) -> pa.Table:
        data = sorted(zip(group.column("idx").to_pylist(), range(group.num_rows), strict=True))
        tiles = [Tile(group.column("tile")[k].as_py()) for _, k in data]
        same = len(tiles) == 1
        nx, ny, a, b = tile_links(tiles[0], tiles[-1], same, threshold)
        if same:
            nx, ny = nx + ny, np.zeros(0)
        vertex = np.concatenate([tiles[0].vertex[nx > 0], tiles[-1].vertex[: len(ny)][ny > 0]])
        n = np.concatenate([nx[nx > 0], ny[ny > 0]]).astype(np.int64)
        edge = np.concatenate([np.zeros(len(n), bool), np.ones(len(a), bool)])
        return pa.table({
            "a": np.concatenate([vertex, a]),
            "b": pa.array(np.concatenate([np.zeros(len(n), np.int64), b]), mask=~edge),
            "n": np.concatenate([n, np.zeros(len(a), np.int64)]),
        })

    spread = points.repartitionByRange("place", "vertex").sortWithinPartitions("place", "vertex")
    tiles = ws.keep(spread.select("vertex", "weight", "vector").mapInArrow(pack, "part int, seq int, tile binary"), "tiles", compression="none")
    # One row per tile.
    order = ws.keep(tiles.select("part", "seq").withColumn("idx", F.row_number().over(W.orderBy("part", "seq")) - 1), "order")
    n = order.count()
    if n == 0:
        return points.sparkSession.createDataFrame([], "a long, b long, n long")
    met = tiles.join(order, ["part", "seq"]).select("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"), "tile")
    met = met.select(F.least("idx", "other").alias("lo"), F.greatest("idx", "other").alias("hi"), "idx", "tile")
    return ws.keep(met.groupBy("lo", "hi").applyInArrow(join, "a long, b long, n long"), "links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Pairs with cosine >= ``threshold`` (above 0) in double precision link.
    Vectors that are NULL, empty, zero or hold NULL or non-finite components link
    with nothing: they have 0 links and are their own component. Vectors of
    another length never link, so each length is compared by itself. Equal
    vectors link with each other; rows that repeat count each. A row with a NULL
    id links, but names no component; its component is the smallest id reached,
    NULL where there is none, and it is not kept. An empty table gives an empty
    one; other columns are not read.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "embedding")
    v = F.col(vector_col).cast("array<float>")
    usable = F.coalesce(
        (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, v).alias("vector"))
    key = F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))
    points = rows.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    points = ws.keep(points.select(F.xxhash64("vector").alias("vertex"), "least", "weight", "vector", F.size("vector").alias("length")), "points")
    found = None
    # One row per length: lengths of embeddings are few, and the product needs them equal.
    for (length,) in points.select("length").distinct().collect():
        of = points.filter(F.col("length") == length)
        refs = [r[0] for r in of.select("vector").orderBy("vertex").limit(REFERENCES).collect()]
        near = nearest_reference(F.col("vector"), refs)
        one = links(of.select("vertex", "weight", "vector", near.alias("place")), ws, threshold, tile)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "vertex")
    labels = components(found.filter("b is not null").select("a", "b"), ws).withColumnRenamed("id", "vertex")
    classes = points.select("vertex", "least", "weight").join(labels, "vertex", "left")
    classes = classes.withColumn("label", F.coalesce("component", "vertex")).join(counts, "vertex", "left")
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "label").select("vertex", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("id", key.alias("vertex")).join(classes, "vertex", "left")
    component = F.when(F.col("vertex").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def nearest_reference(vector, refs: list):
    """Number of the reference vector with the largest product."""
    products = [F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in r]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for r in refs]
    return F.array_position(F.array(*products), F.array_max(F.array(*products)))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
