"""Communities by short random walks, of all components at once.

Components of up to parts.LIMIT vertices are worked on as arrays, many to a task: there one pair is merged at a time. In
larger ones clusters that are alike as starting points of short walks are merged. In every round all pairs of linked clusters that are
each other's nearest merge at once, and all linked clusters with the same walk (gap 0) whatever their number; other ties are
ordered by a hash, so that many pairs merge. Rounds go on until no link is left; a hub with many equal leaves takes one
round a leaf, as a round takes one leaf into it. Per component the round of greatest modularity is taken. Rows are bounded by each vertex's neighbourhood of `steps` steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.operators import graph, parts
from strandflow.session import cut


def communities(edges: DataFrame, steps: int = 3, limit: int = parts.LIMIT) -> DataFrame:
    """vertex, community (its smallest vertex) for undirected edges (src, dst, w); parallel edges are added, loops, null ends and w <= 0 left out."""
    found, large = parts.by_part(edges, parts.walks(steps), "community long", limit)
    found = found.drop("component")
    return found if large is None else found.unionByName(_by_rounds(large, steps))


def _by_rounds(edges: DataFrame, steps: int, rounds: int = 10_000) -> DataFrame:
    """The communities of large components. Raises where links are left after `rounds` rounds; every round merges at least one pair."""
    e = cut(graph.simplify(edges.filter("src is not null and dst is not null and w > 0").select("src", "dst", "w"), "sum"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    power = graph.strength(e)
    loops = power.select(F.col("vertex").alias("src"), F.col("vertex").alias("dst"), (F.col("strength") / F.col("degree")).alias("w"))  # a walk may stay
    walk = both.unionByName(loops)
    deg = cut(walk.groupBy("src").agg(F.sum("w").alias("d")))
    step = cut(walk.join(deg, "src").select(F.col("src").alias("k"), F.col("dst").alias("to"), (F.col("w") / F.col("d")).alias("t")))
    x = step.select(F.col("k").alias("c"), F.col("to").alias("k"), F.col("t").alias("p"))
    for _ in range(steps - 1):
        x = cut(x.join(step, "k").groupBy("c", F.col("to").alias("k")).agg(F.sum(F.col("p") * F.col("t")).alias("p")))
    x = cut(x.join(deg.withColumnRenamed("src", "k"), "k").select("c", "k", (F.col("p") / F.sqrt("d")).alias("p")))
    part = cut(graph.components(e))
    member = cut(part.select("vertex", F.col("vertex").alias("c")))
    nodes = cut(power.join(part, "vertex").select(F.col("vertex").alias("c"), "component", F.lit(1.0).alias("s"), F.col("strength").alias("vol"), F.lit(0.0).alias("inside")))
    whole = cut(nodes.groupBy("component").agg((F.sum("vol") / 2).alias("m")))
    links, levels = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), []
    for level in range(rounds):
        q = nodes.join(whole, "component").groupBy("component").agg(F.round(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("vol") / (2 * F.col("m")), F.lit(2))), 9).alias("q"))
        levels.append((cut(q.withColumn("level", F.lit(level))), member.withColumn("level", F.lit(level))))
        if links.isEmpty():
            break
        size = nodes.join(x.groupBy("c").agg(F.sum(F.col("p") * F.col("p")).alias("len")), "c").select("c", "s", "len")
        at = lambda n: size.select(F.col("c").alias(n), F.col("s").alias(f"s{n}"), F.col("len").alias(f"l{n}"))  # noqa: E731, B023
        to = lambda n: x.select(F.col("c").alias(n), "k", F.col("p").alias(f"p{n}"))  # noqa: E731, B023
        dots = links.select("a", "b").join(to("a"), "a").join(to("b"), ["b", "k"]).groupBy("a", "b").agg(F.sum(F.col("pa") * F.col("pb")).alias("dot"))
        far = links.join(dots, ["a", "b"], "left").join(at("a"), "a").join(at("b"), "b")
        gap = F.round(F.col("sa") * F.col("sb") / (F.col("sa") + F.col("sb")) * (F.col("la") + F.col("lb") - 2 * F.coalesce("dot", F.lit(0.0))), 12)
        far = cut(far.select("a", "b", gap.alias("gap")))
        tie = F.xxhash64("a", "b", F.lit(level))
        nearest = far.select(F.explode(F.array("a", "b")).alias("c"), F.struct("gap", tie.alias("tie"), "a", "b").alias("best")).groupBy("c").agg(F.min("best").alias("best"))
        mutual = nearest.groupBy("best.a", "best.b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")  # the least pair of all always is
        # Of clusters with equal walks none is nearer than the others: they are one, with all that are linked so.
        equal = graph.components(far.filter("gap <= 0").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        alike = cut(equal.select(F.col("vertex").alias("c"), F.col("component").alias("into")))
        other = mutual.join(alike.select(F.col("c").alias("a")), "a", "left_anti").join(alike.select(F.col("c").alias("b")), "b", "left_anti")
        into = cut(alike.filter("c <> into").unionByName(other.select(F.col("b").alias("c"), F.col("a").alias("into"))))
        moved = lambda df, n="c": df.join(into.select(F.col("c").alias(n), "into"), n, "left").withColumn(n, F.coalesce("into", n)).drop("into")  # noqa: E731, B023
        x = cut(moved(x.join(nodes.select("c", "s"), "c")).groupBy("c", "k").agg(F.sum(F.col("s") * F.col("p")).alias("p")).join(moved(nodes).groupBy("c").agg(F.sum("s").alias("s")), "c").select("c", "k", (F.col("p") / F.col("s")).alias("p")))
        bare = moved(moved(links, "a"), "b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
        bare = cut(bare)
        gained = bare.filter("a = b").select(F.col("a").alias("c"), F.col("w").alias("more"))
        nodes = cut(moved(nodes).groupBy("c", "component").agg(F.sum("s").alias("s"), F.sum("vol").alias("vol"), F.sum("inside").alias("inside")).join(gained, "c", "left").withColumn("inside", F.col("inside") + F.coalesce("more", F.lit(0.0))).drop("more"))
        member = cut(moved(member))
        links = bare.filter("a <> b")
    else:
        raise RuntimeError(f"links are left after {rounds} rounds")
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    best = union([q for q, _ in levels]).groupBy("component").agg(F.max_by("level", F.struct("q", -F.col("level"))).alias("level"))
    return union([m for _, m in levels]).join(part, "vertex").join(best, ["component", "level"]).select("vertex", F.col("c").alias("community"))


def sequence_groups(edges: DataFrame, cutoff: float = -5.0, steps: int = 3) -> DataFrame:
    """vertex, community of similar sequences, edges (src, dst, w) being their similarities; community is null for those put aside.

    Sequences much less similar to their group than its others are put aside and the rest grouped again, until none is.
    Where every sequence of a connected part would be alone, the part is one group.
    """
    e = cut(graph.simplify(edges.filter("src is not null and dst is not null and w > 0").select("src", "dst", "w")))
    every = e.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    while True:  # every round but the last puts some aside
        found = communities(e, steps).join(graph.components(e), "vertex")
        alone = F.min((F.col("community") == F.col("vertex")).cast("int")).over(Window.partitionBy("component")) == 1
        groups = cut(found.select("vertex", F.when(alone, F.col("component")).otherwise(F.col("community")).alias("community")))
        side = lambda n: groups.select(F.col("vertex").alias(n), F.col("community").alias(f"g{n}"))  # noqa: E731, B023
        inner = e.join(side("src"), "src").join(side("dst"), "dst").filter("gsrc = gdst")
        bad = cut(graph.outliers(graph.strength(inner).join(groups, "vertex").withColumnRenamed("community", "grp"), cutoff).filter("dropped").select("vertex"))
        if bad.isEmpty():
            break
        e = cut(e.join(bad.withColumnRenamed("vertex", "src"), "src", "left_anti").join(bad.withColumnRenamed("vertex", "dst"), "dst", "left_anti"))
    return every.join(groups, "vertex", "left")
