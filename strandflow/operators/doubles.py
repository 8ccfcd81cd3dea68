"""Columns with a sequence twice: which of its residues stays, and over-large columns taken apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.operators import centrality, columns, communities, graph
from strandflow.session import cut

KEYS = ["clustid", "seqnum"]


def _split(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Residues that are alone of their sequence in the column, and the doubled ones."""
    df = members.withColumn("times", F.count("*").over(Window.partitionBy(*KEYS)))
    return df.filter("times = 1").drop("times"), df.filter("times > 1").drop("times")


def by_consistency(members: DataFrame, most: int = 5, add_back: bool = True) -> DataFrame:
    """members (clustid, seqnum, seqpos) with doubled residues decided by the columns next to them.

    The residues before and after the single members lie in a number of columns each. A candidate passes at tolerance i if
    those before, or those after, are at most i with its own; its support is how many members say so. At the smallest i up to
    `most` at which some candidate passes, the one of greatest support stays if there is only one; otherwise all stay
    (add_back) or none. A residue in several columns counts with the greatest clustid when it is a neighbour.
    """
    at = columns.one_column(members)
    near = lambda by, name: at.select("seqnum", (F.col("seqpos") + by).alias("seqpos"), F.col("clustid").alias(name))
    df = members.select("clustid", "seqnum", "seqpos").join(near(1, "p"), ["seqnum", "seqpos"], "left").join(near(-1, "n"), ["seqnum", "seqpos"], "left")
    single, twice = _split(df)
    sets = single.groupBy("clustid").agg(F.collect_set("p").alias("ps"), F.collect_set("n").alias("ns"), F.count("p").alias("np"), F.count("n").alias("nn"))
    df = twice.join(sets, "clustid", "left")
    for own, known, size, kinds, said in (("p", "ps", "np", "kp", "sp"), ("n", "ns", "nn", "kn", "sn")):
        known_in = F.coalesce(F.array_contains(known, F.col(own)), F.lit(False)).cast("int")
        df = df.withColumn(kinds, F.coalesce(F.size(known), F.lit(0)) + F.when(F.col(own).isNull(), 0).otherwise(1 - known_in)).withColumn(said, F.coalesce(size, F.lit(0)) + known_in)
    pair = Window.partitionBy(*KEYS)
    df = df.withColumn("i", F.min(F.greatest(F.least("kp", "kn"), F.lit(1))).over(pair))
    support = F.when(F.col("kp") <= F.col("i"), F.col("sp")).otherwise(0) + F.when(F.col("kn") <= F.col("i"), F.col("sn")).otherwise(0)
    df = df.withColumn("support", F.when((F.col("i") <= most) & (F.least("kp", "kn") <= F.col("i")), support))
    df = df.withColumn("best", F.max("support").over(pair)).withColumn("winners", F.sum((F.col("support") == F.col("best")).cast("int")).over(pair))
    stays = (F.col("winners") == 1) & (F.col("support") == F.col("best"))
    stays = stays | F.coalesce(F.col("winners") != 1, F.lit(True)) if add_back else stays
    return single.select(*KEYS, "seqpos").unionByName(df.filter(stays).select(*KEYS, "seqpos"))


def by_scores(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with, of doubled residues, the one of greatest summed similarity (edges s1, p1, s2, p2, sim) to the single members of
    the column, ties to the smaller position; a sequence of which none is above 0 leaves the column.
    """
    single, twice = _split(members.select(*KEYS, "seqpos"))
    both = edges.select("s1", "p1", "s2", "p2", "sim").unionByName(edges.select(F.col("s2").alias("s1"), F.col("p2").alias("p1"), F.col("s1").alias("s2"), F.col("p1").alias("p2"), "sim"))
    to = single.select("clustid", F.col("seqnum").alias("s2"), F.col("seqpos").alias("p2"))
    of = twice.select("clustid", F.col("seqnum").alias("s1"), F.col("seqpos").alias("p1"))
    score = both.join(of, ["s1", "p1"]).join(to, ["clustid", "s2", "p2"]).groupBy("clustid", F.col("s1").alias("seqnum"), F.col("p1").alias("seqpos")).agg(F.round(F.sum("sim"), 6).alias("score"))
    return single.unionByName(columns.keep_best(score.filter("score > 0")).select(*KEYS, "seqpos"))


def first_pass(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members without doubles: a doubled column loses what other columns have too; what is still double is decided by
    consistency, then by the strength of the residues in the column (edges s1, p1, s2, p2, sim)."""
    state = columns.completeness(members).select("clustid", "complete")
    df = members.select(*KEYS, "seqpos").join(state, "clustid").withColumn("times", F.count("*").over(Window.partitionBy("seqnum", "seqpos")))
    trimmed = cut(by_consistency(cut(df.filter("complete or times = 1").select(*KEYS, "seqpos"))))
    return columns.keep_best(columns.inner_scores(trimmed, edges)).select(*KEYS, "seqpos")


def _over(vertices: DataFrame, small: int = 0) -> DataFrame:
    """component and over, of vertices (vertex, seqnum, component): more than 1.2 residues a sequence, and more than `small`."""
    df = columns.completeness(vertices.withColumnRenamed("component", "clustid"))
    return df.select(F.col("clustid").alias("component"), (F.col("over") & (F.col("members") > small)).alias("over"))


def _parts(edges: DataFrame, seqs: DataFrame, small: int = 0) -> DataFrame:
    """vertex, component, over for the vertices of edges."""
    part = graph.components(edges).join(seqs, "vertex")
    return cut(part.join(_over(part, small), "component").select("vertex", "component", "over"))


def taken_apart(edges: DataFrame, seqs: DataFrame, cutoff: float = 0.10, hub: float = 0.2, rounds: int = 25) -> DataFrame:
    """vertex, clustid (smallest vertex) of edges (src, dst, w), where seqs (vertex, seqnum) tells the sequence of a vertex.

    A component is a column. One of more than 1.2 residues a sequence loses its brokers (betweenness from cutoff up); parts
    of it of up to 5 vertices, or not over-large any more, are columns. Of the others, vertices of a hub score up to `hub`
    are dropped, what is still over-large is divided into communities of random walks, and all that is left over-large goes
    through the same again, until nothing changes; then it is a column as it is. All components are worked on at once.
    """
    e = cut(edges.filter("src <> dst and w > 0").select("src", "dst", "w"))
    done: list[DataFrame] = []
    ends = lambda x, over: x.join(over.withColumnRenamed("vertex", "src"), "src", "left_semi").join(over.withColumnRenamed("vertex", "dst"), "dst", "left_semi")
    named = lambda part: part.select("vertex", F.col("component").alias("clustid"))
    part = _parts(e, seqs)
    for _ in range(rounds):
        done.append(named(part.filter("not over")))
        e = cut(ends(e, part.filter("over").select("vertex")))
        n = e.count()
        if not n:
            break
        e = cut(centrality.without_brokers(e, cutoff))
        part = _parts(e, seqs, 5)
        done.append(named(part.filter("not over")))
        e = cut(ends(e, part.filter("over").select("vertex")))
        strong = cut(centrality.without_weak_hubs(e, hub))
        part = _parts(strong, seqs)
        done.append(named(part.filter("not over")))
        e = cut(ends(strong, part.filter("over").select("vertex")))
        group = cut(communities.communities(e))
        side = lambda c: group.select(F.col("vertex").alias(c), F.col("community").alias(f"g_{c}"))
        e = cut(e.join(side("src"), "src").join(side("dst"), "dst").filter("g_src = g_dst").select("src", "dst", "w"))
        part = _parts(e, seqs)
        if e.count() == n:
            done.append(named(part.filter("over")))
            part = part.filter("not over")
            done.append(named(part))
            break
    else:
        raise RuntimeError(f"over-large columns are left after {rounds} rounds")
    return reduce(DataFrame.unionByName, done)
