"""The order of columns, from the order of their members on the sequences.

Arcs lead from a column to the next one on some sequence. Where they form no cycle, a column stands at the length of the
longest way to it, so all arcs run forward. Columns that lead to each other form a cyclic part; of its arcs those are left
out that run against the mean positions of its columns. What then still runs against the order is a feedback arc, so there
are none outside cyclic parts. The arcs are distinct pairs of neighbouring columns, whatever the number of sequences; they
are put into order by connected parts of their graph, which are bounded by the width of an alignment, many to a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.operators import graph
from strandflow.operators.chains import heaviest_chain
from strandflow.operators.columns import order_edges
from strandflow.operators.ranks import dense_index
from strandflow.session import cut

#: Arcs of one task: parts are put together up to about as many.
TASK_ARCS = 20_000


def _levels(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest way from a start to each of n vertices along arcs a -> b, and how many arcs into it were not reached (0 unless a cycle is before it)."""
    by = np.argsort(a, kind="stable")
    to, start = b[by], np.searchsorted(a[by], np.arange(n + 1))
    left, level = np.bincount(b, minlength=n), np.zeros(n, np.int64)
    front, depth = np.flatnonzero(left == 0), 0
    while len(front):
        level[front] = depth
        counts = start[front + 1] - start[front]
        at = np.repeat(start[front] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        ends, times = np.unique(to[at], return_counts=True)
        left[ends] -= times
        front, depth = ends[left[ends] == 0], depth + 1
    return level, left


def _cyclic_parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each vertex the number of its cyclic part, -1 where it is on no cycle."""
    part = np.full(n, -1)
    core = np.flatnonzero((_levels(n, a, b)[1] > 0) & (_levels(n, b, a)[1] > 0))  # neither before nor after all cycles
    inside = np.zeros(n, bool)
    inside[core] = True
    keep = inside[a] & inside[b]
    out: dict[int, list[int]] = {v: [] for v in core.tolist()}
    for x, y in zip(a[keep].tolist(), b[keep].tolist()):
        out[x].append(y)
    seen, low, stack, on = {}, {}, [], set()
    for root in out:
        if root in seen:
            continue
        walk = [(root, iter(out[root]))]
        seen[root] = low[root] = len(seen)
        stack.append(root)
        on.add(root)
        while walk:
            v, nexts = walk[-1]
            for y in nexts:
                if y not in seen:
                    seen[y] = low[y] = len(seen)
                    stack.append(y)
                    on.add(y)
                    walk.append((y, iter(out[y])))
                    break
                if y in on:
                    low[v] = min(low[v], seen[y])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == seen[v]:
                    members = _top(stack, v)
                    del stack[-len(members) :]
                    on.difference_update(members)
                    if len(members) > 1:
                        part[members] = min(members)
    return part


def _top(stack: list[int], v: int) -> list[int]:
    i = len(stack) - 1
    while stack[i] != v:
        i -= 1
    return stack[i:]


def leveled(c1: np.ndarray, c2: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of arcs c1 -> c2, x being mean positions; their levels; the place among them of the smallest one of their cyclic part, or -1."""
    ids, at = np.unique(np.concatenate([c1, c2]), return_inverse=True)
    a, b = at[: len(c1)], at[len(c1) :]
    x = np.zeros(len(ids))
    x[a], x[b] = x1, x2
    part = _cyclic_parts(len(ids), a, b)
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((ids, x))] = np.arange(len(ids))
    against = (part[a] >= 0) & (part[a] == part[b]) & (place[a] > place[b])
    return ids, _levels(len(ids), a[~against], b[~against])[0], part


def _leveled(t: pa.Table) -> pa.Table:
    """clustid, level, cycle (smallest column of its cyclic part, or null) for arcs (c1, c2, x1, x2), x being mean positions."""
    ids, level, part = leveled(*(t[c].to_numpy() for c in ("c1", "c2", "x1", "x2")))
    return pa.table({"clustid": ids, "level": level, "cycle": pa.array(ids[part], mask=part < 0)})


def levels(placed: DataFrame) -> DataFrame:
    """clustid, level, cycle of the columns of placed (seqnum, seqpos, clustid): the longest way of kept arcs to a column, and its cyclic part."""
    arcs = cut(order_edges(placed).select("c1", "c2"))
    mean = placed.groupBy("clustid").agg(F.round(F.avg("seqpos"), 9).alias("x"))
    parts = cut(graph.components(arcs.select(F.col("c1").alias("src"), F.col("c2").alias("dst"))))
    side = lambda c, x: mean.select(F.col("clustid").alias(c), F.col("x").alias(x))
    with_ends = arcs.join(side("c1", "x1"), "c1").join(side("c2", "x2"), "c2").join(parts.select(F.col("vertex").alias("c1"), "component"), "c1")
    buckets = max(1, arcs.count() // TASK_ARCS)
    kind = dict(arcs.dtypes)["c1"]
    found = with_ends.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).groupBy("bucket").applyInArrow(_leveled, f"clustid {kind}, level long, cycle {kind}")
    return placed.select("clustid").distinct().join(found, "clustid", "left").select("clustid", F.coalesce("level", F.lit(0)).alias("level"), "cycle")


def column_order(placed: DataFrame, group: str | None = None, leveled: DataFrame | None = None) -> DataFrame:
    """clustid, col: 0-based places by (group, level, clustid); the columns of a group, if given, stand together. leveled: levels(placed), where it is at hand."""
    x = levels(placed) if leveled is None else leveled
    if group:
        x = x.join(placed.groupBy("clustid").agg(F.min(group).alias("g")), "clustid")
    keys = [*(["g"] if group else []), "level", "clustid"]
    df = dense_index(x.select(F.struct(*keys).alias("key")), "key", "col")
    return df.select("key.clustid", "col")


def is_acyclic(placed: DataFrame) -> bool:
    """Whether the order graph of placed has no cycle."""
    return levels(placed).filter("cycle is not null").isEmpty()


def feedback_arcs(placed: DataFrame, order: DataFrame) -> DataFrame:
    """c1, c2, weight: arcs of the order graph that run against order. Without them the graph has no cycle; a graph without one has none of them."""
    a = order.select(F.col("clustid").alias("c1"), F.col("col").alias("k1"))
    b = order.select(F.col("clustid").alias("c2"), F.col("col").alias("k2"))
    return order_edges(placed).join(a, "c1").join(b, "c2").filter("k1 > k2").select("c1", "c2", "weight")


def weaker_ends(arcs: DataFrame, placed: DataFrame, ratio: float = 2.0) -> DataFrame:
    """clustid of the end of a feedback arc whose strength in the order graph is `ratio` times less than the other end's."""
    power = order_edges(placed).select(F.explode(F.array("c1", "c2")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("s"))
    both = arcs.join(power.select(F.col("c").alias("c1"), F.col("s").alias("t1")), "c1").join(power.select(F.col("c").alias("c2"), F.col("s").alias("t2")), "c2")
    less = F.when(F.col("t1") >= ratio * F.col("t2"), F.col("c2")).when(F.col("t2") >= ratio * F.col("t1"), F.col("c1"))
    return both.select(less.alias("clustid")).filter("clustid is not null").distinct()


def consistent(placed: DataFrame, order: DataFrame) -> DataFrame:
    """placed without the members that step back in order: each sequence keeps its heaviest increasing chain of columns.

    A column weighs its members. A group is one sequence. The arcs of the result all run forward.
    """
    size = placed.groupBy("clustid").agg(F.count("*").cast("double").alias("w"))
    df = placed.select("seqnum", "seqpos", "clustid").join(order.select("clustid", "col"), "clustid").join(size, "clustid")

    def run(t: pa.Table) -> pa.Table:
        return t.take(heaviest_chain(t["seqpos"].to_numpy(), t["col"].to_numpy(), t["w"].to_numpy()))

    return df.groupBy("seqnum").applyInArrow(run, df.schema).select("seqnum", "seqpos", "clustid")
