"""Work on the connected parts of a graph: many small parts to a task, each as arrays; large ones are left to joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators import graph
from strandflow.session import cut, small_side

#: Vertices of a part up to which it is one array of n x n values in a task; edges sought for a task.
LIMIT, TASK_EDGES = 512, 20_000
#: Edges of a larger part up to which a task holds them all; values of (source, vertex or edge) held at once.
ARRAY_EDGES, HELD = 1_000_000, 4_000_000


def by_part(edges: DataFrame, run: Callable[[int, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], columns: str, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """vertex, component and `columns` (as run gives them for every vertex of a part) of the parts of at most `limit` vertices, and the edges of the others.

    run gets the number of vertices and the edges a, b (places, each edge once, no loops) with weights w.
    """
    e = cut(graph.simplify(edges.filter("src is not null and dst is not null and w > 0").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")), "sum"))
    part = cut(graph.components(e))
    size = part.groupBy("component").agg(F.count("*").alias("n"))
    with_part = e.join(part.withColumnRenamed("vertex", "src"), "src")
    large = cut(size.filter(F.col("n") > limit).select("component"))
    some = not large.isEmpty()
    small = with_part.join(small_side(large), "component", "left_anti") if some else with_part
    buckets = max(1, e.count() // TASK_EDGES)
    schema = f"vertex long, component long, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]

    def task(t: pa.Table) -> pa.Table:
        comp, src, dst, w = (t[c].to_numpy() for c in ("component", "src", "dst", "w"))
        order = np.lexsort((dst, src, comp))
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            ids, place = np.unique(np.concatenate([src[at], dst[at]]), return_inverse=True)
            found = run(len(ids), place[: len(at)], place[len(at) :], w[at])
            out.append(pa.table({"vertex": ids, "component": np.full(len(ids), comp[at[0]]), **{n: ids[found[n]] if n == "community" else found[n] for n in names}}))
        return pa.concat_tables(out)

    found = small.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).groupBy("bucket").applyInArrow(task, schema)
    return found, with_part.join(small_side(large), "component", "left_semi").select("src", "dst", "w") if some else None


def adjacency(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray | float = 1.0) -> np.ndarray:
    m = np.zeros((n, n))
    m[a, b] = m[b, a] = w
    return m


def between(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Betweenness of every vertex, unweighted: shortest ways from all sources at once, level by level, and their shares back."""
    m, far = adjacency(n, a, b), np.full((n, n), -1)
    front = ways = np.eye(n)
    far[np.arange(n), np.arange(n)] = depth = 0
    while True:
        step = (front @ m) * (far < 0)
        if not step.any():
            break
        depth += 1
        far[step > 0] = depth
        ways, front = ways + step, step
    share = np.zeros((n, n))
    for d in range(depth, 0, -1):
        out = np.divide(1 + share, ways, out=np.zeros((n, n)), where=far == d)
        share += (out @ m) * ways * (far == d - 1)
    np.fill_diagonal(share, 0)
    total = share.sum(0) / 2
    return {"n": np.full(n, n), "betweenness": np.round(total / ((n - 1) * (n - 2) / 2), 6) if n > 2 else np.zeros(n)}


def _lists(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of all vertices one after the other, and where those of each begin."""
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")
    return np.concatenate([b, a])[order], np.searchsorted(ends[order], np.arange(n + 1))


def shares(n: int, a: np.ndarray, b: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Of every vertex its summed shares in the shortest ways from the sources, in memory of the edges times some sources at once."""
    to, begin = _lists(n, a, b)
    total, some = np.zeros(n), max(1, HELD // max(n, len(to)))
    for i in range(0, len(sources), some):
        own = sources[i : i + some]
        far, ways = np.full(len(own) * n, -1, np.int32), np.zeros(len(own) * n)
        front = np.arange(len(own)) * n + own
        far[front], ways[front], depth, levels = 0, 1, 0, []
        while len(front):
            v = front % n
            counts = begin[v + 1] - begin[v]
            at = np.repeat(begin[v] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            of = np.repeat(np.arange(len(front)), counts)
            keys = (front - v)[of] + to[at]
            new = far[keys] < 0
            keys, of = keys[new], of[new]
            nxt, into = np.unique(keys, return_inverse=True)
            far[nxt], depth = depth + 1, depth + 1
            ways[nxt] = np.bincount(into, ways[front[of]], minlength=len(nxt))
            levels.append((front, nxt, of, into))
            front = nxt
        share = np.zeros(len(own) * n)
        for here, nxt, of, into in reversed(levels):
            share[here] = ways[here] * np.bincount(of, ((1 + share[nxt]) / ways[nxt])[into], minlength=len(here))
        share[np.arange(len(own)) * n + own] = 0
        total += share.reshape(len(own), n).sum(0)
    return total


def sparse_hubs(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """hubs() without an n x n array."""
    ends, other = np.concatenate([a, b]), np.concatenate([b, a])
    return _hubs(n, lambda x: np.bincount(ends, x[other], minlength=n))


def hubs(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Hub scores: the vector that two steps along the edges keep, from equal values on, greatest entry 1."""
    m = adjacency(n, a, b)
    return _hubs(n, lambda x: m @ x)


def _hubs(n: int, step: Callable[[np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    x = np.ones(n)
    for _ in range(10_000):
        y = step(step(x))
        y /= y.max()
        done = np.abs(y - x).max() < 1e-9
        x = y
        if done:
            break
    return {"hub": x}


def walks(steps: int) -> Callable[[int, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]:
    """Communities by random walks: the two linked ones whose merging adds least to the spread of walks are merged, ties by their
    smallest vertices, until one is left; the state of greatest modularity counts."""

    def run(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        m = adjacency(n, a, b, w)
        strength, degree = m.sum(1), (m > 0).sum(1)
        walk = m + np.diag(strength / degree)  # a walk may stay
        d = walk.sum(1)
        x = np.linalg.matrix_power(walk / d[:, None], steps) / np.sqrt(d)
        size, inside, vol, alive = np.ones(n), np.zeros(n), strength.copy(), np.ones(n, bool)
        total, links, of = strength.sum() / 2, m.copy(), np.arange(n)
        gap = np.full((n, n), np.inf)

        def measure(i: int, others: np.ndarray) -> None:
            far = size[i] * size[others] / (size[i] + size[others]) * ((x[others] - x[i]) ** 2).sum(1)
            low, high = np.minimum(i, others), np.maximum(i, others)
            gap[low, high] = np.round(far, 12)

        for i in range(n):
            measure(i, np.flatnonzero(links[i] > 0))
        quality = lambda: round(float((inside[alive] / total - (vol[alive] / (2 * total)) ** 2).sum()), 9)
        best, found = quality(), of.copy()
        for _ in range(n - 1):
            i, j = divmod(int(gap.argmin()), n)
            if not np.isfinite(gap[i, j]):
                break
            x[i] = (size[i] * x[i] + size[j] * x[j]) / (size[i] + size[j])
            inside[i] += inside[j] + links[i, j]
            size[i], vol[i] = size[i] + size[j], vol[i] + vol[j]
            links[i] += links[j]
            links[:, i] = links[i]
            links[i, i] = links[j] = links[:, j] = 0
            gap[j], gap[:, j], gap[i], gap[:, i] = np.inf, np.inf, np.inf, np.inf
            alive[j] = False
            of[of == j] = i
            measure(i, np.flatnonzero(links[i] > 0))
            if (now := quality()) > best:
                best, found = now, of.copy()
        return {"community": found}

    return run
