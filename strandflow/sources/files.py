"""Files that the analyses read and write: FASTA by groups, Clustal, CSV tables, lists of heads, saved PCA models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators import columns, order

SIMILARITIES = "seq1 int, seq2 int, seqsim double, seqlen1 int, seqlen2 int, correctedseqsim double"
MATCHES = "fasta string, seq1 int, seq2 int, aa1 string, aa2 string, weight double"
NETWORK = "c1 int, c2 int, aas1 string, aas2 string, gidx1 int, gidx2 int, weight long, feedback string"
# Fixed values of the Clustal format: the first line, letters of a row, and the width of a name.
CLUSTAL, LETTERS, NAME, NAME_WIDTH = "CLUSTAL X (1.81) multiple sequence alignment", 50, 30, 36


def write_similarities(df: DataFrame, path: str) -> None:
    """SIMILARITIES as CSV with a header."""
    df.select("seq1", "seq2", "seqsim", "seqlen1", "seqlen2", "correctedseqsim").write.mode("overwrite").csv(path, header=True)


def write_matches(df: DataFrame, path: str) -> None:
    """MATCHES as CSV without a header."""
    df.select("fasta", "seq1", "seq2", "aa1", "aa2", "weight").write.mode("overwrite").csv(path)


def order_network(placed: DataFrame, residues: DataFrame) -> DataFrame:
    """NETWORK: the arcs of the order graph, the labels of the members of both columns, their places, and whether the arc runs back."""
    o = order.column_order(placed)
    label = residues.select("seqnum", "seqpos", F.concat_ws("-", "seqnum", "seqpos", "seqaa").alias("aa"))
    members = placed.join(label, ["seqnum", "seqpos"]).groupBy("clustid").agg(F.concat_ws("_", F.array_sort(F.collect_list("aa"))).alias("aas")).join(o, "clustid")
    side = lambda c, i: members.select(F.col("clustid").alias(c), F.col("aas").alias(f"aas{i}"), F.col("col").alias(f"gidx{i}"))
    arcs = columns.order_edges(placed).join(side("c1", 1), "c1").join(side("c2", 2), "c2")
    return arcs.withColumn("feedback", F.when(F.col("gidx1") > F.col("gidx2"), "yes").otherwise("no")).select("c1", "c2", "aas1", "aas2", "gidx1", "gidx2", "weight", "feedback")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """The rows of all CSV files under path (a glob or several folders may be given), with the path of their file."""
    return spark.read.schema(schema).option("header", header).csv(path).select("*", F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("path"))


def clustal_lines(rows: DataFrame, name: str = "name") -> DataFrame:
    """fasta, block, place, line of Clustal files, one for each fasta, from rows (fasta, seqnum, name, row) of equal length."""
    cut_name = F.rpad(F.regexp_replace(F.substring(name, 1, NAME), " ", "_"), NAME_WIDTH, " ")
    blocks = F.sequence(F.lit(0), F.floor((F.length("row") - 1) / LETTERS).cast("int"))
    body = rows.filter("length(row) > 0").withColumn("block", F.explode(blocks))
    body = body.select("fasta", "block", F.col("seqnum").cast("long").alias("place"), F.concat(cut_name, F.expr(f"substring(row, block * {LETTERS} + 1, {LETTERS})")).alias("line"))
    after = body.select("fasta", "block").distinct().select("fasta", "block", F.lit(2**40).alias("place"), F.lit("").alias("line"))
    first = body.select("fasta").distinct().select("fasta", F.lit(-1).alias("block"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("place"), F.lit(x).alias("line")) for i, x in enumerate([CLUSTAL, "", ""])))).alias("x")).select("fasta", "block", "x.place", "x.line")
    return body.unionByName(after).unionByName(first)


def write_clustal(rows: DataFrame, path: str, name: str = "name") -> None:
    """A folder fasta=… for each file; the lines are in the order of its part files."""
    lines = clustal_lines(rows, name).repartitionByRange("fasta", "block").sortWithinPartitions("fasta", "block", "place")
    lines.select("fasta", F.col("line").alias("value")).write.mode("overwrite").partitionBy("fasta").text(path)


def write_group_fasta(df: DataFrame, path: str) -> None:
    """A folder grp=… of FASTA files for each group of (grp, name, seq); what has no group is in grp=excluded."""
    grp = F.coalesce(F.col("grp").cast("string"), F.lit("excluded")).alias("grp")
    df.select(grp, F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").partitionBy("grp").text(path)


def read_heads(spark: SparkSession, path: str, per_layer: int = 16) -> list[int]:
    """Indices of the heads of a list with one layerN_headM a line."""
    n = lambda i: F.regexp_extract("value", r"layer(-?\d+)_head(\d+)", i).cast("int")
    found = spark.read.text(path).filter(F.col("value").rlike(r"layer-?\d+_head\d+")).select((n(1) * per_layer + n(2)).alias("head"))
    return [r["head"] for r in found.collect()]  # a line a head of one model


def save_vectors(df: DataFrame, path: str) -> None:
    """Vectors (idx, emb and what else the frame has) as Parquet, to be read by spark.read.parquet."""
    df.write.mode("overwrite").parquet(path)


def pca_coordinates(reduced: DataFrame, k: int = 7) -> DataFrame:
    """idx, seqnum, seqpos, seqaa and the first k coordinates x1 … xk of reduced."""
    return reduced.select("idx", "seqnum", "seqpos", "seqaa", *(F.get("reduced", F.lit(i)).alias(f"x{i + 1}") for i in range(k)))
