"""Connected components of a link table, distributed.

First each task replaces its part of the links by a spanning forest of them (every node hung on the smallest of its tree), so links
within a part cost nothing any more.  While more links stay than one task may hold (LOCAL), alternating large-star and small-star
steps hang the neighbours of a node on the smallest node it knows, each followed by forests again; once no more than
that stay, one task finishes.  Links stay in Spark tables with a checkpoint after each round; the driver sees only counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, forget, persist

#: Links that a task holds at a time: 16 bytes each, some 100 MB with all that is made of them.
LOCAL = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, ascending, and the smallest node that each is connected with."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def forests(edges: DataFrame, most: int, roots: bool = False) -> DataFrame:
    """u, v: for each run of `most` links of a partition, its nodes with their smallest ones (roots themselves only if asked for)."""

    def run(batches):
        def hung():
            node, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            own = np.ones(len(node), bool) if roots else node != root
            return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], names=["u", "v"])

        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                yield hung()
                held, n = [], 0
        if held:
            yield hung()

    return edges.mapInArrow(run, "u long, v long")


def starred(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step."""
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = dealt_anew(both, "u").join(dealt_anew(low, "u"), "u").filter(F.col("v") > F.bitwise_not("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = dealt_anew(large, "u").join(dealt_anew(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(low.select("u", F.col("m").alias("v")))
    return small.filter("u != v").distinct()


def components(links: DataFrame, a: str, b: str, local: int = LOCAL) -> DataFrame:
    """node, component (its smallest node) of every node that a link names; links with a null or to itself are left out."""
    edges = links.select(F.greatest(F.col(a), F.col(b)).cast("long").alias("u"), F.least(F.col(a), F.col(b)).cast("long").alias("v"))
    # dealt anew by `distinct`, so that no task runs a second Python worker beside the one that may have made the links
    edges = persist(forests(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), local))
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] <= local:
            return persist(forests(edges.coalesce(1), local + 1, roots=True)).toDF("node", "component")
        if state == before:
            break
        before = state
        edges, used = persist(forests(starred(edges), local)), edges
        forget(used)
    root = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return root.union(root.select("component").distinct().select(F.col("component").alias("node"), "component"))
