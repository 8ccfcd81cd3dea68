"""Chains inside a pair of sequences: longest increasing and heaviest non-crossing matchings, by Fenwick tree."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heaviest_chain(p1: np.ndarray, p2: np.ndarray, w: np.ndarray) -> list[int]:
    """Places of a chain strictly increasing in both coordinates with the greatest weight; ties to the smaller end."""
    order = np.lexsort((p2, p1)).tolist()
    rank = {v: i + 1 for i, v in enumerate(sorted(set(p2.tolist())))}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(rank) + 1)
    label, back = [0.0] * len(order), [-1] * len(order)
    for _, same in groupby(order, key=lambda i: p1[i]):
        same = list(same)  # edges of one source see only earlier sources
        for i in same:
            best, j = (0.0, -1), rank[p2[i]] - 1
            while j > 0:
                best = max(best, tree[j], key=lambda x: x[0])
                j -= j & -j
            label[i], back[i] = best[0] + float(w[i]), best[1]
        for i in same:
            j = rank[p2[i]]
            while j <= len(rank):
                if label[i] > tree[j][0]:
                    tree[j] = (label[i], i)
                j += j & -j
    end = max(range(len(order)), key=lambda i: (round(label[i], 9), -p2[i], -p1[i]), default=-1)
    chain = []
    while end >= 0:
        chain.append(end)
        end = back[end]
    return chain[::-1]


def longest_increasing(values: np.ndarray) -> list:
    """The longest strictly increasing subsequence; of several the one that ends in the smallest value."""
    tails, at, back = [], [], []
    for i, v in enumerate(values.tolist()):
        k = bisect_left(tails, v)
        back.append(at[k - 1] if k else -1)
        tails[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(values[i])
        i = back[i]
    return out[::-1]


#: What rows (p1, p2, sim) of a pair stay: the heaviest chain, the longest one, or the longest increasing run of targets.
KEEP = {
    "weighted": heaviest_chain,
    "longest": lambda p1, p2, w: heaviest_chain(p1, p2, np.ones(len(w))),
    "increasing": lambda p1, p2, w: np.flatnonzero(np.isin(p2, longest_increasing(p2))).tolist(),
}


def rows_by_pair(s1: np.ndarray, p1: np.ndarray, s2: np.ndarray, p2: np.ndarray, w: np.ndarray, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], list[int]]) -> np.ndarray:
    """Places of the rows that keep(p1, p2, w) names in each pair (s1, s2)."""
    by = np.lexsort((p2, p1, s2, s1))
    a, b = s1[by], s2[by]
    ends = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(by)]
    return by[np.array([i + k for i, j in zip(ends, ends[1:]) for k in keep(p1[by[i:j]], p2[by[i:j]], w[by[i:j]])], int)]


def _by_pair(edges: DataFrame, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], list[int]]) -> DataFrame:
    """The rows of edges (s1, p1, s2, p2, sim) that keep(p1, p2, sim) names in each pair (s1, s2); many pairs to a task."""
    df = edges.select("s1", "p1", "s2", "p2", "sim").filter("s1 <> s2")
    buckets = max(1, df.count() // 50_000)

    def run(t: pa.Table) -> pa.Table:
        s1, s2 = (np.unique(t[c].to_numpy(), return_inverse=True)[1] for c in ("s1", "s2"))  # names or numbers
        p1, p2, w = (t[c].to_numpy() for c in ("p1", "p2", "sim"))
        return t.take(rows_by_pair(s1, p1, s2, p2, w, keep)).select(["s1", "p1", "s2", "p2", "sim"])

    return df.withColumn("bucket", F.pmod(F.xxhash64("s1", "s2"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, df.schema)


def chains(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """The rows of edges (s1, p1, s2, p2, sim) that form the best non-crossing chain of their pair (s1, s2)."""
    return _by_pair(edges, KEEP["weighted" if weighted else "longest"])


def increasing_hits(edges: DataFrame) -> DataFrame:
    """The rows of edges whose target position is in the longest increasing run of target positions, in the order of query positions, of their pair.

    The run decides by value: a position hit twice is kept twice.
    """
    return _by_pair(edges, KEEP["increasing"])


def chain_sizes(edges: DataFrame, weighted: bool = False) -> DataFrame:
    value = F.round(F.sum("sim"), 6) if weighted else F.count("*")
    return chains(edges, weighted).groupBy("s1", "s2").agg(value.alias("value"))
