"""Consolidating pairwise matches into groups on a two-dimensional grid.

Vertices are hashed into B blocks; the edge (u, v) lies in cell (block of u, block of v). Every cell runs a local
union-find and sends, for each of its vertices, the smallest vertex of its local set; along its row and column each
vertex then takes the least representative it received as parent, and the representatives it received become the
edges of the next, smaller round, until parents are stable. The parents of the rounds are joined back at the end.
A vertex with very many edges is spread over all cells of its row or column, so it makes no hot task.

Defined results: an edge with a null end is ignored; loops and repeated edges change nothing (a vertex with loops
alone is no group); an empty table gives no rows. Every vertex of a group of two or more has one row with the
smallest vertex of the group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.session import cut, drop_cut

#: Edges sought for a cell; the grid has at most MAX_BLOCKS x MAX_BLOCKS cells.
CELL_EDGES, MAX_BLOCKS = 200_000, 128


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mixing of integers."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return z ^ (z >> np.uint64(31))


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges and for each the smallest vertex of its set."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)  # hook roots on smaller ones
        while (root[root] != root).any():  # then shorten paths
            root = root[root]
    return ids, ids[root]


def _cell(table: pa.Table) -> pa.Table:
    ids, root = local_roots(table["u"].to_numpy(), table["v"].to_numpy())
    return pa.table({"v": ids, "rep": root})


def connected_groups(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 50) -> DataFrame:
    """member, grp (both long): for edges between long ids, every vertex of a group with the smallest vertex of it."""
    e = cut(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u is not null and v is not null and u <> v"))
    parents: list[DataFrame] = []
    n = e.count()
    for _ in range(rounds):
        if not n:
            break
        blocks = max(1, min(MAX_BLOCKS, math.ceil(math.sqrt(n / CELL_EDGES))))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        sent = cut(e.withColumns({"r": block("u"), "c": block("v")}).groupBy("r", "c").applyInArrow(lambda t: _cell(t), "v long, rep long"))
        parent = cut(sent.groupBy("v").agg(F.min("rep").alias("m"), F.max("rep").alias("most"), F.count("*").alias("k")))
        parents.append(parent.select("v", "m"))
        torn = parent.filter("m <> most").select("v", "m")
        nxt = cut(sent.join(torn, "v").filter("rep <> m").select(F.col("rep").alias("u"), F.col("m").alias("v")).distinct())
        drop_cut(e)
        drop_cut(sent)
        e, n = nxt, nxt.count()
    else:
        raise RuntimeError("parents did not stabilise")
    if not parents:
        return edges.sparkSession.createDataFrame([], "member long, grp long")
    label = parents[-1].select(F.col("v").alias("member"), F.col("m").alias("grp"))
    for p in reversed(parents[:-1]):
        up = label.select(F.col("member").alias("m"), "grp")
        label = p.join(up, "m", "left").select(F.col("v").alias("member"), F.coalesce("grp", "m").alias("grp"))
    return label
