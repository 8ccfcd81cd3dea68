"""Operators on column assignments (clustid, seqnum, seqpos): duplicates, order, gaps, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def completeness(members: DataFrame) -> DataFrame:
    """clustid, members, sequences, complete (no sequence twice), allowed (1.2 x sequences), over (larger than allowed)."""
    df = members.groupBy("clustid").agg(F.count("*").alias("members"), F.count_distinct("seqnum").alias("sequences"))
    return df.withColumns({"complete": F.col("members") == F.col("sequences"), "allowed": F.round(1.2 * F.col("sequences"), 6)}).withColumn("over", F.col("members") > F.col("allowed"))


def doubled(members: DataFrame) -> DataFrame:
    return members.groupBy("clustid", "seqnum").agg(F.count("*").alias("times")).filter("times > 1")


def keep_best(scored: DataFrame) -> DataFrame:
    """Of the residues of a sequence in a column the one with the greatest score, then the smallest position."""
    best = Window.partitionBy("clustid", "seqnum").orderBy(F.desc("score"), "seqpos")
    return scored.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


def inner_scores(members: DataFrame, edges: DataFrame) -> DataFrame:
    """score: summed weights of a residue's edges (s1, p1, s2, p2, sim) inside its column."""
    both = edges.select("s1", "p1", "s2", "p2", "sim").unionByName(edges.select(F.col("s2").alias("s1"), F.col("p2").alias("p1"), F.col("s1").alias("s2"), F.col("p1").alias("p2"), "sim"))
    a = members.select("clustid", F.col("seqnum").alias("s1"), F.col("seqpos").alias("p1"))
    b = members.select(F.col("clustid").alias("c2"), F.col("seqnum").alias("s2"), F.col("seqpos").alias("p2"))
    inside = both.join(a, ["s1", "p1"]).join(b, ["s2", "p2"]).filter("clustid = c2").groupBy("clustid", F.col("s1").alias("seqnum"), F.col("p1").alias("seqpos")).agg(F.round(F.sum("sim"), 6).alias("score"))
    return members.join(inside, ["clustid", "seqnum", "seqpos"], "left").fillna(0.0, ["score"])


def one_column(members: DataFrame) -> DataFrame:
    """A residue given to several columns keeps the greatest clustid (the last one assigned)."""
    return members.groupBy("seqnum", "seqpos").agg(F.max("clustid").alias("clustid"))


def unshared(members: DataFrame) -> DataFrame:
    """Without residues that are in several columns."""
    return members.withColumn("n", F.count("*").over(Window.partitionBy("seqnum", "seqpos"))).filter("n = 1").drop("n")


def without_subsets(members: DataFrame) -> DataFrame:
    """clustid of the columns not contained in another (of equal ones the smallest clustid stays).

    A containing column shares every residue, so candidates come from a join on residues, not from all pairs.
    """
    size = members.groupBy("clustid").agg(F.count("*").alias("n"))
    a, b = members.alias("a"), members.alias("b")
    shared = a.join(b, (F.col("a.seqnum") == F.col("b.seqnum")) & (F.col("a.seqpos") == F.col("b.seqpos")) & (F.col("a.clustid") != F.col("b.clustid"))).groupBy(F.col("a.clustid").alias("clustid"), F.col("b.clustid").alias("other")).agg(F.count("*").alias("c"))
    inside = shared.join(size, "clustid").filter("c = n").join(size.select(F.col("clustid").alias("other"), F.col("n").alias("m")), "other").filter("m > n or clustid > other")
    return size.join(inside.select("clustid").distinct(), "clustid", "left_anti").select("clustid", F.col("n").alias("members"))


def path(placed: DataFrame) -> DataFrame:
    """placed (seqnum, seqpos, clustid) with the column before and after on the sequence."""
    w = Window.partitionBy("seqnum").orderBy("seqpos")
    return placed.withColumns({"prev": F.lag("clustid").over(w), "next": F.lead("clustid").over(w)})


def order_edges(placed: DataFrame) -> DataFrame:
    """c1, c2, weight: columns that follow each other on sequences."""
    return path(placed).filter("next is not null and next <> clustid").groupBy(F.col("clustid").alias("c1"), F.col("next").alias("c2")).agg(F.count("*").alias("weight"))


def vote(placed: DataFrame, share: float = 0.5) -> DataFrame:
    """The most common next column of each column, kept if at least `share` of the members agree; ties to the smaller."""
    size = placed.groupBy("clustid").agg(F.count("*").alias("n"))
    top = Window.partitionBy("c1").orderBy(F.desc("weight"), "c2")
    best = order_edges(placed).withColumn("r", F.row_number().over(top)).filter("r = 1").drop("r")
    return best.join(size, best.c1 == size.clustid).filter(F.col("weight") >= share * F.col("n")).select("c1", "c2", "weight")


def flanks(residues: DataFrame, placed: DataFrame) -> DataFrame:
    """Every residue with its column (null if unplaced) and the nearest columns before and after it on the sequence."""
    w = Window.partitionBy("seqnum").orderBy("seqpos")
    df = residues.select("seqnum", "seqpos").join(placed, ["seqnum", "seqpos"], "left")
    before = F.last("clustid", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("clustid", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumns({"prev_clust": before, "next_clust": after, "rank": F.count("clustid").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def gaps(residues: DataFrame, placed: DataFrame) -> DataFrame:
    """Maximal runs of unplaced residues: seqnum, prev_clust, next_clust (null at the ends), first, last, size."""
    open_ = flanks(residues, placed).filter("clustid is null")
    return open_.groupBy("seqnum", "rank", "prev_clust", "next_clust").agg(F.min("seqpos").alias("first"), F.max("seqpos").alias("last"), F.count("*").alias("size")).drop("rank")


def by_file(order: DataFrame, placed: DataFrame) -> DataFrame:
    """clustid, fasta, col of order(clustid, col) with the columns of a file, the first of their members', numbered from 0; width is their number."""
    w = Window.partitionBy("fasta")
    df = order.join(placed.groupBy("clustid").agg(F.min("fasta").alias("fasta")), "clustid")
    return df.select("clustid", "fasta", (F.row_number().over(w.orderBy("col")) - 1).alias("col"), F.count("*").over(w).cast("int").alias("width"))


def alignment(placed: DataFrame, residues: DataFrame, order: DataFrame) -> DataFrame:
    """fasta, seqnum, row: the letters of each sequence in the columns of a file (order as by_file gives it), '-' where it has none.

    Only a sequence's own columns are shuffled; the dashes between them are made by their distances.
    """
    w = Window.partitionBy("fasta", "seqnum").orderBy("col")
    at = placed.join(residues.select("seqnum", "seqpos", "seqaa"), ["seqnum", "seqpos"]).join(order, "clustid").groupBy("fasta", "seqnum", "width", "col").agg(F.min(F.struct("seqpos", "seqaa")).getField("seqaa").alias("aa"))
    piece = at.withColumn("piece", F.concat(F.repeat(F.lit("-"), F.col("col") - F.coalesce(F.lag("col").over(w), F.lit(-1)) - 1), "aa"))
    row = piece.groupBy("fasta", "seqnum", "width").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "piece"))), lambda x: x["piece"]), "").alias("row"))
    return row.select("fasta", "seqnum", F.rpad("row", F.col("width"), F.lit("-")).alias("row"))


def stranded(placed: DataFrame, order: DataFrame) -> DataFrame:
    """clustid of the columns of which some member has neither its previous residue in the column before nor its next one in the column after."""
    w = Window.partitionBy("seqnum").orderBy("seqpos")
    df = placed.join(order, "clustid")
    df = df.withColumns({"pc": F.lag("col").over(w), "pp": F.lag("seqpos").over(w), "nc": F.lead("col").over(w), "np": F.lead("seqpos").over(w)})
    tied = ((F.col("pc") == F.col("col") - 1) & (F.col("pp") == F.col("seqpos") - 1)) | ((F.col("nc") == F.col("col") + 1) & (F.col("np") == F.col("seqpos") + 1))
    return df.groupBy("clustid").agg(F.min(F.coalesce(tied, F.lit(False)).cast("int")).alias("tied")).filter("tied = 0").select("clustid")


def from_alignment(rows: DataFrame, letters: str = "row") -> DataFrame:
    """seqnum, seqpos, clustid of alignment rows (seqnum, row): the letters that are no gap, clustid being the place in the row.

    The inverse of alignment(): seqpos counts the letters of a row from 0.
    """
    at = rows.select("seqnum", F.posexplode(F.split(letters, "")).alias("clustid", "aa")).filter("aa <> '-' and aa <> ''")
    return at.select("seqnum", (F.row_number().over(Window.partitionBy("seqnum").orderBy("clustid")) - 1).alias("seqpos"), "clustid")


def squish_candidates(placed: DataFrame, order: DataFrame, edges: DataFrame) -> DataFrame:
    """c1, c2, weight: neighbouring columns that share no sequence, with the summed positive similarities between them."""
    at = placed.join(order, "clustid")
    seqs = at.select("col", "seqnum").distinct()
    clash = seqs.join(seqs.select((F.col("col") - 1).alias("col"), "seqnum"), ["col", "seqnum"]).select("col").distinct()
    side = at.select("seqnum", "seqpos", "col")
    both = edges.select("s1", "p1", "s2", "p2", "sim").unionByName(edges.select(F.col("s2").alias("s1"), F.col("p2").alias("p1"), F.col("s1").alias("s2"), F.col("p1").alias("p2"), "sim")).filter("sim > 0")
    left = side.select(F.col("seqnum").alias("s1"), F.col("seqpos").alias("p1"), "col")
    right = side.select(F.col("seqnum").alias("s2"), F.col("seqpos").alias("p2"), F.col("col").alias("col2"))
    return both.join(left, ["s1", "p1"]).join(right, ["s2", "p2"]).filter("col2 = col + 1").groupBy("col").agg(F.round(F.sum("sim"), 6).alias("weight")).join(clash, "col", "left_anti").select(F.col("col").alias("c1"), (F.col("col") + 1).alias("c2"), "weight")
