"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors of cosine c or more are at most sqrt(2 - 2c) apart.  A random rotation spreads that distance evenly; split into
BLOCKS blocks of coordinates, a pair within it is within its share, sqrt((2 - 2c) / BLOCKS), in one block at least.  So each
block is range-joined by itself: vectors go to the cell of a grid over two of the block's coordinates and to the cells
their range touches, where blocks are compared by distance; the union over the blocks is verified by the cosine of the
original vectors in double precision.  A pair found in several blocks counts in the first.

Equal vectors of a label are one class, so copies cost nothing.  A tile (label, block, cell) with more than TILE vectors
is dealt to several tasks, each with its parts of both sides (some TILE vectors of each).  Tiles give sums and links between representatives,
not pairs: a dense group of m vectors costs m rows, not m squared.

Cases: vectors that are null, empty, zero or hold null, NaN or infinite components, or whose label is null, link with
nothing; vectors of different lengths link with nothing; equal rows are copies; rows that repeat an id are vectors
of their own with one node between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist
from .components import components

BLOCKS, TILE, CHUNK = 8, 16_384, 512
#: On squared distances, for rounding.
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)


def units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, radius: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cell, home) for a block's coordinates: each vector's own cell, and those its range touches."""
    width, out = 2 * radius, []
    axes = []
    for k in range(min(2, x.shape[1])):
        home = np.floor(x[:, k] / width).astype(np.int64)
        low, high = np.floor((x[:, k] - radius) / width).astype(np.int64), np.floor((x[:, k] + radius) / width).astype(np.int64)
        axes.append([(home, np.ones(len(x), bool), True), (low, low != home, False), (high, high != home, False)])
    if len(axes) == 1:
        axes.append([(np.zeros(len(x), np.int64), np.ones(len(x), bool), True)])
    for a, there, own in axes[0]:
        for b, there2, own2 in axes[1]:
            rows = np.flatnonzero(there & there2)
            if len(rows):
                out.append((rows, (a[rows] << 20) + b[rows], np.full(len(rows), own and own2)))
    return out


def linked(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, min_cos: float, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """In one tile: for each vector the weight of those it links with, and links enough to connect what is connected.

    A pair is taken here if one of `left` has a smaller id than one of `right` and `block` is the first block in which the two are close."""
    dim = x.shape[1]
    bounds = block_bounds(dim, blocks)
    limit = (2 - 2 * min_cos) / (len(bounds) - 1) + SLACK
    y = x @ rotation(dim)
    parts = [y[:, a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    own = parts[block]
    key = own[:, min(2, own.shape[1] - 1)]
    order = np.argsort(key, kind="stable")
    ids, weight, x, left, right, key = ids[order], weight[order], x[order], left[order], right[order], key[order]
    parts = [p[order] for p in parts[: block + 1]]
    total, pairs = np.zeros(len(ids), np.int64), []

    def apart(k: int, u, v) -> np.ndarray:
        a, b = parts[k][u], parts[k][v]
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)

    rows = np.flatnonzero(left)
    for at in range(0, len(rows), CHUNK):
        u = rows[at : at + CHUNK]
        reach = np.sqrt(limit) + 1e-6
        v = np.arange(np.searchsorted(key, key[u[0]] - reach), np.searchsorted(key, key[u[-1]] + reach, side="right"))
        v = v[right[v]]
        hit = (apart(block, u, v) <= limit) & (ids[u][:, None] < ids[v][None, :])
        us, vs = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(us):
            continue
        u, v, hit = u[us], v[vs], hit[np.ix_(us, vs)]
        hit &= x[u] @ x[v].T >= min_cos
        for k in range(block):
            hit &= apart(k, u, v) > limit
        if not hit.any():
            continue
        total[u] += hit @ weight[v]
        total[v] += weight[u] @ hit
        first = hit.argmax(0)  # of each v, the first u
        a, b = np.nonzero(hit)
        pairs.append(np.unique(np.concatenate((np.stack((ids[u[first[b]]], ids[v[b]]), 1), np.stack((ids[u[a]], ids[u[first[b]]]), 1))), axis=0))
    some = total > 0
    edges = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return np.stack((ids[some], total[some]), 1), edges[edges[:, 0] != edges[:, 1]]


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cos: float = 0.93, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Per row: the id, n_links, component_id, kept. Without an id: no links, and null for the last two."""
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.col(label_col).alias("_label"))
    sound = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    # + 0.0 makes -0.0 and 0.0 the same vector
    fit = rows.withColumn("_fit", F.coalesce(F.col("_label").isNotNull() & F.col("_id").isNotNull() & sound, F.lit(False)))
    fit = fit.withColumn("_v", F.when(F.col("_fit"), F.transform("_v", lambda x: x + 0.0)))
    classes = persist(fit.filter("_fit").groupBy("_label", "_v").agg(F.min("_id").alias("_rep"), F.count("*").alias("_w")))

    def deal(batches):
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column("_v").offsets))
            for dim in np.unique(lengths):
                t = batch.filter(pa.array(lengths == dim))
                x = units(matrix(t.column("_v"))) @ rotation(int(dim))
                bounds = block_bounds(int(dim), blocks)
                radius = float(np.sqrt((2 - 2 * min_cos) / (len(bounds) - 1) + SLACK))
                for k in range(len(bounds) - 1):
                    for own, cell, home in cells_of(x[:, bounds[k] : bounds[k + 1]], radius):
                        sub = t.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays(
                            [sub.column("_label"), pa.array(np.full(len(own), dim), pa.int32()), pa.array(np.full(len(own), k), pa.int32()), pa.array(cell), pa.array(home), sub.column("_rep"), sub.column("_w"), sub.column("_v")],
                            names=["_label", "_dim", "_block", "_cell", "_home", "_rep", "_w", "_v"],
                        )

    kind = classes.schema["_label"].dataType.simpleString()
    dealt = classes.mapInArrow(deal, f"_label {kind}, _dim int, _block int, _cell long, _home boolean, _rep long, _w long, _v array<double>")
    key = ["_label", "_dim", "_block", "_cell"]
    crowded = dealt.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias("_parts")).filter("_parts > 1")
    dealt = dealt.join(crowded, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    # a task for each part of the left with each of the right
    parts = F.sequence(F.lit(0), F.col("_parts") - 1)
    dealt = dealt.withColumn("_mine", F.pmod(F.xxhash64("_rep"), "_parts").cast("int"))
    as_left = F.when(F.col("_home"), F.transform(parts, lambda j: F.col("_mine") * F.col("_parts") + j)).otherwise(F.array().cast("array<int>"))
    as_right = F.transform(parts, lambda i: i * F.col("_parts") + F.col("_mine"))
    dealt = dealt.withColumn("_part", F.explode(F.array_union(as_left, as_right)))
    dealt = dealt.withColumn("_left", F.col("_home") & (F.floor(F.col("_part") / F.col("_parts")) == F.col("_mine")))
    dealt = dealt.withColumn("_right", F.pmod("_part", "_parts") == F.col("_mine")).drop("_mine")

    def join(t: pa.Table) -> pa.Table:
        counts, edges = linked(
            t.column("_rep").to_numpy(), t.column("_w").to_numpy(), units(matrix(t.column("_v"))), t.column("_left").to_numpy(zero_copy_only=False),
            t.column("_right").to_numpy(zero_copy_only=False), t.column("_block")[0].as_py(), min_cos, blocks,
        )
        a, b = np.concatenate((counts[:, 0], edges[:, 0])), pa.array(np.concatenate((counts[:, 1], edges[:, 1])))
        return pa.table({"_a": pa.array(a), "_b": b, "_edge": pa.array(np.arange(len(a)) >= len(counts))})

    found = persist(dealt.groupBy(*key, "_part").applyInArrow(join, "_a long, _b long, _edge boolean"))
    links = found.filter("NOT _edge").groupBy("_a").agg(F.sum("_b").alias("_n"))
    comps = components(found.filter("_edge"), "_a", "_b")
    state = classes.join(links, classes["_rep"] == links["_a"], "left").join(comps, classes["_rep"] == comps["node"], "left")
    state = state.select("_label", "_v", (F.coalesce("_n", F.lit(0)) + F.col("_w") - 1).alias("_n"), F.coalesce("component", "_rep").alias("_comp"))
    out = fit.join(state, ["_label", "_v"], "left")
    comp = F.coalesce("_comp", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("_id") == comp).alias("kept"))
