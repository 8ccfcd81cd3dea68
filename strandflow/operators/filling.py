"""Placing the residues that the first columns leave open, and joining alignments of groups.

order is (clustid, col) with the columns of a file standing together, as column_order(group="fasta") gives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.operators import columns, graph, hits
from strandflow.operators.chains import chains
from strandflow.operators.ranks import dense_index
from strandflow.session import cut


def open_residues(residues: DataFrame, placed: DataFrame, order: DataFrame) -> DataFrame:
    """seqnum, seqpos of unplaced residues with the places prev and next of the nearest columns on their sequence (null at ends)."""
    df = columns.flanks(residues, placed).filter("clustid is null").select("seqnum", "seqpos", "prev_clust", "next_clust")
    at = lambda c, p: order.select(F.col("clustid").alias(c), F.col("col").alias(p))
    return df.join(at("prev_clust", "prev"), "prev_clust", "left").join(at("next_clust", "next"), "next_clust", "left").select("seqnum", "seqpos", "prev", "next")


def gap_islands(open_: DataFrame, placed: DataFrame, order: DataFrame, residues: DataFrame) -> DataFrame:
    """open_ with fasta and island: gaps that lie over a common column, directly or through others, share one.

    The spaces between columns are vertices; two neighbouring spaces are joined where some gap lies over the column
    between them, so distinct gaps are expanded by columns and never compared with each other. Island ids are places;
    the gap before the first column of a file is -place - 1; files without columns have island null.
    """
    files = residues.select("seqnum", "fasta").distinct()
    ends = placed.select("seqnum", "clustid").join(files, "seqnum").join(order, "clustid").groupBy("fasta").agg(F.min("col").alias("first"), F.max("col").alias("last"))
    df = open_.join(files, "seqnum").join(ends, "fasta", "left")
    spans = df.filter("first is not null").select("first", "last", F.coalesce("prev", F.col("first") - 1).alias("a"), F.coalesce("next", F.col("last") + 1).alias("b")).distinct()
    covered = spans.filter("b - a > 1").select("first", F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)).alias("col")).distinct()
    left = F.when(F.col("col") == F.col("first"), -F.col("first") - 1).otherwise(F.col("col") - 1)
    joined = graph.components(covered.select(left.cast("long").alias("src"), F.col("col").cast("long").alias("dst")))
    space = F.when(F.col("prev").isNull(), -F.col("first") - 1).otherwise(F.col("prev")).cast("long")
    return df.withColumn("vertex", space).join(joined, "vertex", "left").select("fasta", "seqnum", "seqpos", "prev", "next", F.coalesce("component", "vertex").alias("island"))


def cluster_islands(islands: DataFrame, residues: DataFrame, minscore: float = 0.5, least: int = 2) -> DataFrame:
    """New columns (seqnum, seqpos, clustid) of reciprocal best hits inside the islands, each sequence once, from `least` members.

    clustid is the smallest idx of the column, so it differs from all others. Residues called X take no part.
    """
    scope = residues.filter("seqaa <> 'X'").select("idx", "seqnum", "seqpos", "emb").join(islands.select("seqnum", "seqpos", "fasta", "island"), ["seqnum", "seqpos"])
    # an island is one search group; neighbours() splits it into blocks, so a large one is spread
    scope = scope.withColumn("fasta", F.concat_ws("/", "fasta", "island"))
    found = hits.reciprocal(hits.neighbours(scope, 1, True, minscore).drop("rank"))
    return first_columns(found, least)


def first_columns(found: DataFrame, least: int = 2) -> DataFrame:
    """Columns of reciprocal hits: components, doubled sequences reduced to the residue with the greatest summed similarity."""
    parts = graph.components(found.select(F.col("q").alias("src"), F.col("t").alias("dst")))
    ends = found.select(F.col("q").alias("vertex"), F.col("q_seq").alias("seqnum"), F.col("q_pos").alias("seqpos"), "sim").unionByName(found.select(F.col("t").alias("vertex"), F.col("t_seq").alias("seqnum"), F.col("t_pos").alias("seqpos"), "sim"))
    score = ends.groupBy("vertex", "seqnum", "seqpos").agg(F.round(F.sum("sim"), 6).alias("score"))
    best = columns.keep_best(score.join(parts, "vertex").withColumnRenamed("component", "clustid"))
    size = best.groupBy("clustid").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return best.join(size, "clustid", "left_semi").select("seqnum", "seqpos", "clustid")


def best_columns(open_: DataFrame, placed: DataFrame, order: DataFrame, sims: DataFrame, least: float = 0.5) -> DataFrame:
    """Open residues given to the column strictly between their flanks with the greatest mean similarity above `least`.

    sims (s1, p1, s2, p2, sim) holds both directions. A column takes one residue of a sequence, the most similar one.
    """
    near = sims.join(open_.select(F.col("seqnum").alias("s1"), F.col("seqpos").alias("p1"), "prev", "next"), ["s1", "p1"])
    to = placed.join(order, "clustid").select(F.col("seqnum").alias("s2"), F.col("seqpos").alias("p2"), "clustid", "col")
    near = near.join(to, ["s2", "p2"]).filter("(prev is null or prev < col) and (next is null or col < next)")
    mean = near.groupBy(F.col("s1").alias("seqnum"), F.col("p1").alias("seqpos"), "clustid").agg(F.round(F.avg("sim"), 6).alias("score")).filter(F.col("score") > least)
    one = mean.withColumn("n", F.row_number().over(Window.partitionBy("seqnum", "seqpos").orderBy(F.desc("score"), "clustid"))).filter("n = 1").drop("n")
    return columns.keep_best(one)


def singletons(residues: DataFrame, placed: DataFrame) -> DataFrame:
    """A column of its own for each unplaced residue: seqnum, seqpos, clustid = -idx - 2, below all other ids."""
    return residues.select("seqnum", "seqpos", "idx").join(placed.select("seqnum", "seqpos"), ["seqnum", "seqpos"], "left_anti").select("seqnum", "seqpos", (-F.col("idx") - 2).alias("clustid"))


def squish(placed: DataFrame, order: DataFrame, edges: DataFrame, repeats: int = 20) -> DataFrame:
    """placed with neighbouring columns merged where they share no sequence and each is the other's most similar neighbour.

    Repeated on the result, up to `repeats` times, until nothing merges.
    """
    placed, order = placed.select("seqnum", "seqpos", "clustid"), order.select("clustid", "col")
    for _ in range(repeats):
        c = columns.squish_candidates(placed, order, edges)
        ends = c.select(F.explode(F.array("c1", "c2")).alias("v"), "c1", "weight")
        best = ends.groupBy("v").agg(F.max_by("c1", F.struct("weight", -F.col("c1"))).alias("c1"))
        pairs = best.groupBy("c1").agg(F.count("*").alias("n")).filter("n = 2").select((F.col("c1") + 1).alias("col"), "c1")
        to = cut(pairs.join(order, "col").select("clustid", "c1").join(order.select(F.col("col").alias("c1"), F.col("clustid").alias("into")), "c1").select("clustid", "into"))
        if to.isEmpty():
            break
        placed = cut(placed.join(to, "clustid", "left").select("seqnum", "seqpos", F.coalesce("into", "clustid").alias("clustid")))
        rest = order.join(to, "clustid", "left_anti").select(F.struct("col", "clustid").alias("key"))
        order = cut(dense_index(rest, "key", "place").select("key.clustid", F.col("place").alias("col")))
    return placed


def column_means(placed: DataFrame, order: DataFrame, residues: DataFrame) -> DataFrame:
    """clustid, col, emb: the mean vector of each column."""
    rows = placed.join(residues.select("seqnum", "seqpos", "emb"), ["seqnum", "seqpos"]).select("clustid", F.posexplode("emb").alias("i", "x"))
    mean = rows.groupBy("clustid", "i").agg(F.avg("x").alias("x")).groupBy("clustid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("emb"))
    return mean.join(order, "clustid")


def merge_orders(left: DataFrame, right: DataFrame, minscore: float = 0.5) -> DataFrame:
    """unit, side (0 left, 1 right), clustid, col of two alignments put into one in every unit, from their column_means with a unit.

    The matched columns are the heaviest non-crossing chain of the pairs from minscore up; between two matches stand first
    the left columns, then the right ones. Every column of both sides comes out once; matched ones share their col, which is
    numbered over all units, those of a unit together.
    """
    one = lambda df, s: df.select(F.col("unit").alias("fasta"), F.xxhash64("unit", F.lit(s)).alias("seqnum"), F.lit(s).alias("side"), F.col("col").alias("seqpos"), (F.col("col").cast("long") * 2 + s).alias("idx"), "emb")
    every = one(left, 0).unionByName(one(right, 1))
    near = hits.neighbours(every.withColumn("seqnum", F.col("side")), 2**31 - 1, True, minscore).filter("q_seq = 0")
    unit = left.select(F.col("col").alias("q_pos"), F.col("unit").alias("s1"))
    match = chains(near.join(unit, "q_pos").select("s1", F.col("q_pos").alias("p1"), F.lit("").alias("s2"), F.col("t_pos").alias("p2"), "sim"), weighted=True).select(F.col("s1").alias("unit"), "p1", "p2")
    # a left column keeps its place; an unmatched right one stands just before the next matched left column
    w = Window.partitionBy("unit").orderBy("col")  # one row per column of one alignment
    r = right.join(match.withColumnRenamed("p2", "col"), ["unit", "col"], "left").select("unit", "clustid", "col", "p1")
    nxt = F.coalesce(F.first("p1", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(2**31 - 1))
    r = r.withColumn("before", nxt)
    spot = F.when(F.col("p1").isNotNull(), F.struct("unit", F.col("p1").alias("a"), F.lit(-1).alias("b"))).otherwise(F.struct("unit", (F.col("before") - 1).alias("a"), F.col("col").alias("b")))
    both = left.select("unit", F.lit(0).alias("side"), "clustid", F.struct("unit", F.col("col").alias("a"), F.lit(-1).alias("b")).alias("key")).unionByName(r.select("unit", F.lit(1).alias("side"), "clustid", spot.alias("key")))
    return both.join(dense_index(both.select("key").distinct(), "key", "col"), "key").select("unit", "side", "clustid", "col")


def merge_groups(placed: DataFrame, order: DataFrame, residues: DataFrame, minscore: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """placed and order with the alignments of the groups of a file put into one; placed has fasta and grp.

    The groups of a file are merged two by two, larger ones first, in all files at once; matched columns take the left clustid.
    """
    size = placed.groupBy("fasta", "grp").agg(F.count("*").alias("n"))
    rank = size.withColumn("r", F.row_number().over(Window.partitionBy("fasta").orderBy(F.desc("n"), "grp")) - 1).select("fasta", "grp", "r")
    placed = cut(placed.join(rank, ["fasta", "grp"]).select("fasta", "r", "seqnum", "seqpos", "clustid"))
    while placed.agg(F.max("r")).first()[0]:
        means = column_means(placed, order, residues).join(placed.select("clustid", "fasta", "r").distinct(), "clustid")
        means = cut(means.select(F.concat_ws("/", "fasta", (F.col("r") / 2).cast("int")).alias("unit"), (F.col("r") % 2).alias("side"), "clustid", "col", "emb"))
        merged = cut(merge_orders(means.filter("side = 0"), means.filter("side = 1"), minscore))
        into = merged.groupBy("col").agg(F.min_by("clustid", "side").alias("into"))
        named = cut(merged.join(into, "col").select("clustid", "into", "col"))
        placed = cut(placed.join(named.select("clustid", "into"), "clustid").select("fasta", (F.col("r") / 2).cast("int").alias("r"), "seqnum", "seqpos", F.col("into").alias("clustid")))
        order = named.select(F.col("into").alias("clustid"), "col").distinct()
    return placed.drop("r"), order
