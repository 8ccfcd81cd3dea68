"""Central vertices of every component at once: betweenness and hub scores.

edges (src, dst, …) are undirected. Small components are worked on as arrays, many to a task. Of those whose edges a task can
hold the sources are dealt to tasks, and hub scores come from one. In still larger ones all sources advance one step per job by joins, so there are as many jobs as the widest component has steps; their rows are
(source, vertex) pairs of one component, as exact betweenness asks, so call it with the components that are over-large
for their sequences, which is what the filter is for. Hub scores of large components come from repeated joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators import graph, parts
from strandflow.session import cut, drop_cut

#: Steps over edges from all its sources that a task of betweenness is given.
TASK_STEPS = 10_000_000


def _both(edges: DataFrame) -> DataFrame:
    e = edges.filter("src <> dst").select("src", "dst")
    return cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())


def betweenness(edges: DataFrame, limit: int = parts.LIMIT) -> DataFrame:
    """vertex, n (size of its component), betweenness divided by (n-1)(n-2)/2 (0 where n < 3). Unweighted."""
    found, large = parts.by_part(edges.select("src", "dst", F.lit(1.0).alias("w")), parts.between, "n long, betweenness double", limit)
    found = found.drop("component")
    if large is None:
        return found
    held, rest = _by_size(large)
    found = found if held is None else found.unionByName(_by_sources(held))
    return found if rest is None else found.unionByName(_by_joins(rest.select("src", "dst")))


def _by_size(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """edges with their component and its number of edges: of the components whose edges a task can hold, and of the others (None: there are none)."""
    part = graph.components(edges).withColumnRenamed("vertex", "src")
    e = edges.select("src", "dst").join(part, "src")
    e = cut(e.join(e.groupBy("component").agg(F.count("*").alias("size")), "component").select("component", "size", "src", "dst"))
    sides = (e.filter(F.col("size") <= parts.ARRAY_EDGES), e.filter(F.col("size") > parts.ARRAY_EDGES))
    return tuple(None if x.isEmpty() else x for x in sides)


def _by_sources(edges: DataFrame) -> DataFrame:
    """Betweenness of components with all edges in a task, which counts the shortest ways from a part of the sources; each edge once, without loops."""
    tasks = F.greatest(F.lit(1), F.least(F.col("size") * F.col("size") / F.lit(TASK_STEPS), F.greatest(F.lit(8), F.lit(4 * TASK_STEPS) / F.col("size")))).cast("int")
    dealt = edges.withColumn("tasks", tasks).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))

    def run(t: pa.Table) -> pa.Table:
        src, dst = t["src"].to_numpy(), t["dst"].to_numpy()
        order = np.lexsort((dst, src))
        ids, at = np.unique(np.concatenate([src[order], dst[order]]), return_inverse=True)
        n = len(ids)
        got = parts.shares(n, at[: len(src)], at[len(src) :], np.arange(t["task"][0].as_py(), n, t["tasks"][0].as_py()))
        return pa.table({"vertex": ids, "n": np.full(n, n), "b": got})

    total = dealt.groupBy("component", "task").applyInArrow(run, "vertex long, n long, b double").groupBy("vertex", "n").agg((F.sum("b") / 2).alias("b"))
    share = F.when(F.col("n") > 2, F.col("b") / ((F.col("n") - 1) * (F.col("n") - 2) / 2)).otherwise(0.0)
    return total.select("vertex", "n", F.round(share, 6).alias("betweenness"))


def _by_joins(edges: DataFrame) -> DataFrame:
    e = _both(edges)
    first = e.select(F.col("src").alias("s")).distinct()
    levels = [cut(first.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")))]
    while True:
        step = levels[-1].join(e.withColumnRenamed("src", "v"), "v").groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        for past in levels[-2:]:  # a neighbour of a level is in it, or one step nearer or further
            step = step.join(past.select("s", "v"), ["s", "v"], "left_anti")
        step = cut(step)
        if step.isEmpty():
            break
        levels.append(step)
    sums, delta = [], None
    for i in range(len(levels) - 1, 0, -1):
        here = levels[i]
        here = here.withColumn("delta", F.lit(0.0)) if delta is None else here.join(delta, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        here = cut(here)
        sums.append(here.select("s", "v", "delta"))
        up = here.join(e.withColumnRenamed("src", "v"), "v").select("s", F.col("dst").alias("v"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
        delta = up.join(levels[i - 1], ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("share") * F.col("paths")).alias("delta"))
    if not sums:
        return first.select(F.col("s").alias("vertex"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("betweenness"))
    rows = sums[0]
    for more in sums[1:]:
        rows = rows.unionByName(more)
    total = rows.groupBy("v").agg((F.count("*") + 1).alias("n"), (F.sum("delta") / 2).alias("b"))
    share = F.when(F.col("n") > 2, F.col("b") / ((F.col("n") - 1) * (F.col("n") - 2) / 2)).otherwise(0.0)
    return total.select(F.col("v").alias("vertex"), "n", F.round(share, 6).alias("betweenness"))


def without_brokers(edges: DataFrame, cutoff: float = 0.10, small: int = 5) -> DataFrame:
    """edges between vertices with a betweenness below cutoff; components of at most `small` vertices stay as they are."""
    keep = cut(betweenness(edges).filter((F.col("n") <= small) | (F.col("betweenness") < cutoff)).select("vertex"))
    return edges.join(keep.withColumnRenamed("vertex", "src"), "src", "left_semi").join(keep.withColumnRenamed("vertex", "dst"), "dst", "left_semi")


def hub_scores(edges: DataFrame, limit: int = parts.LIMIT, rounds: int = 200, tol: float = 1e-4) -> DataFrame:
    """vertex, component, hub: principal eigenvector of the squared adjacency of each component, greatest entry 1.

    In large components a round multiplies six times; rounds end when no score changes by more than tol. Raises after `rounds`.
    """
    found, large = parts.by_part(edges.select("src", "dst", F.lit(1.0).alias("w")), parts.hubs, "hub double", limit)
    if large is None:
        return found
    held, rest = _by_size(large)
    if held is not None:
        found = found.unionByName(held.groupBy("component").applyInArrow(_hubs, "vertex long, component long, hub double"))
    if rest is None:
        return found
    e, groups = _both(rest), graph.components(rest)
    v = cut(groups.withColumn("hub", F.lit(1.0)))
    step = lambda x: e.join(x.select(F.col("vertex").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.sum("hub").alias("hub"))
    for _ in range(rounds):
        raw = v.select("vertex", "component").join(step(step(step(step(step(step(v)))))), "vertex")
        top = raw.groupBy("component").agg(F.max("hub").alias("top"))
        nxt = cut(raw.join(top, "component").select("vertex", "component", (F.col("hub") / F.col("top")).alias("hub")))
        moved = nxt.join(v.select("vertex", F.col("hub").alias("old")), "vertex").agg(F.max(F.abs(F.col("hub") - F.col("old")))).first()[0]
        drop_cut(v)
        v = nxt
        if moved < tol:
            return found.unionByName(v)
    raise RuntimeError(f"hub scores still change after {rounds} rounds")


def _hubs(t: pa.Table) -> pa.Table:
    src, dst = t["src"].to_numpy(), t["dst"].to_numpy()
    order = np.lexsort((dst, src))
    ids, at = np.unique(np.concatenate([src[order], dst[order]]), return_inverse=True)
    return pa.table({"vertex": ids, "component": np.full(len(ids), t["component"][0].as_py()), **parts.sparse_hubs(len(ids), at[: len(src)], at[len(src) :], np.ones(len(src)))})


def without_weak_hubs(edges: DataFrame, least: float = 0.2) -> DataFrame:
    """edges between vertices with a hub score above `least`; a component none of whose edges would be left stays whole."""
    scores = cut(hub_scores(edges))
    side = lambda c: scores.select(F.col("vertex").alias(c), F.col("hub").alias(f"h_{c}"))
    df = edges.join(side("src"), "src").join(side("dst"), "dst").join(scores.select(F.col("vertex").alias("src"), "component"), "src")
    df = df.withColumn("strong", (F.col("h_src") > least) & (F.col("h_dst") > least))
    some = df.filter("strong").select("component").distinct().withColumn("some", F.lit(True))
    return df.join(some, "component", "left").filter("strong or some is null").select(*edges.columns)
