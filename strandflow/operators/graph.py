"""Graph operators on edge frames (src, dst, w)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.session import cut, drop_cut


def simplify(edges: DataFrame, how: str = "max") -> DataFrame:
    """Undirected edges without loops, parallel ones combined by max, min, sum, or first: the one of the smallest `at`, if edges have it, else of (src, dst, w)."""
    rank = F.struct(*([c for c in ("at",) if c in edges.columns] or ["src", "dst", "w"]))
    combine = {"max": F.max, "min": F.min, "sum": F.sum, "first": lambda w: F.min_by(w, rank)}[how]
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(combine("w").alias("w"))


def strength(edges: DataFrame) -> DataFrame:
    """vertex, degree, strength."""
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex"), "w").groupBy("vertex").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def _stars(batches, chunk: int | None):
    """(vertex, root) of the parts that the edges of every chunk of rows form; root is the smallest vertex of the part."""
    held, rows = [], 0

    def flush():
        ends = np.concatenate([np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for b in held], axis=1)
        ids, at = np.unique(ends, return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(ids))
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while (higher := root[root] != root).any():
                root[higher] = root[root[higher]]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["src", "dst"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if chunk and rows >= chunk:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def components(edges: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """vertex, component (its smallest vertex) of edges between long ids; null ends and loops are left out.

    Every chunk of edges is reduced to stars where it lies. Up to `chunk` edges of stars are put together in one task;
    more are sent to their vertices, whose several roots are the edges of the next, smaller round.
    """
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src is not null and dst is not null and src <> dst")
    up: list[DataFrame] = []
    while True:
        stars = cut(e.mapInArrow(lambda batches: _stars(batches, chunk), "src long, dst long"))
        if stars.limit(chunk + 1).count() <= chunk:
            last = cut(stars.coalesce(1).mapInArrow(lambda batches: _stars(batches, None), "src long, dst long"))
            break
        parents = cut(stars.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("most")))
        up.append(parents.select("src", "dst"))
        several = parents.filter("dst <> most").select("src", F.col("dst").alias("least"))
        e = cut(stars.join(several, "src").filter("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct())
        drop_cut(stars)
    found = last.select(F.col("src").alias("vertex"), F.col("dst").alias("component"))
    for parents in reversed(up):
        above = found.select(F.col("vertex").alias("dst"), "component")
        found = parents.join(above, "dst", "left").select(F.col("src").alias("vertex"), F.coalesce("component", "dst").alias("component"))
    return found


def outliers(strengths: DataFrame, cutoff: float = -5.0, weak: float = 0.8) -> DataFrame:
    """(grp, vertex, strength) -> z of each vertex against the others of its group and whether it is dropped."""
    whole = strengths.groupBy("grp").agg(F.count("*").alias("n"), F.sum("strength").alias("total"), F.stddev_pop("strength").alias("sd"))
    rest = (F.col("total") - F.col("strength")) / (F.col("n") - 1)
    df = strengths.join(whole, "grp").withColumn("z", F.when((F.col("n") > 3) & (F.col("sd") > 1e-9), (F.col("strength") - rest) / F.col("sd")))
    return df.select("grp", "vertex", F.round("strength", 6).alias("strength"), F.round("z", 4).alias("z"), F.coalesce((F.col("z") < cutoff) & (F.col("strength") / (F.col("n") - 1) <= weak), F.lit(False)).alias("dropped"))
