"""The tables as typed, de-duplicated frames. A key counts once; late and repeated rows have the same content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = r"^\s*([0-9]+)\s*-\s*([0-9]+)\s*-\s*([A-Za-z]?)\s*$"
DIM = 48


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def usable(vector: Column, dim: int = DIM) -> Column:
    """Right length, no null or NaN, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return (F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0)


def once(df: DataFrame, key: str) -> DataFrame:
    """df with one row for each key. Only the keys are shuffled and the rows of repeated ones, which are few; wide rows stay where they are."""
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    return df.join(repeated, key, "left_anti").unionByName(df.join(repeated, key, "left_semi").dropDuplicates([key]))


def residues(spark: SparkSession, folder: str, vectors: bool = True, single: bool = False) -> DataFrame:
    """One row per residue: seqnum, seqindex, seqpos, seqaa (upper case, null as X), idx, fasta and, of usable vectors, emb (double, or as stored)."""
    df = table(spark, folder, "residues").filter("idx is not null and seqnum is not null and seqpos is not null")
    cols = ["seqnum", "seqindex", "seqpos", F.upper(F.coalesce("seqaa", F.lit("X"))).alias("seqaa"), "idx", "fasta"]
    if not vectors:
        return df.select(*cols).dropDuplicates(["idx"])
    df = once(df.select(*cols, "aa_embeddings"), "idx").filter(usable(F.col("aa_embeddings")))
    return df.withColumn("emb", F.col("aa_embeddings") if single else F.col("aa_embeddings").cast("array<double>")).drop("aa_embeddings")


def sequence_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """seqnum, fasta, seqlen, emb of the sequences with a usable vector and a residue row."""
    emb = table(spark, folder, "seq_emb").filter(F.col("seqnum").isNotNull() & usable(F.col("sequence_embeddings"))).select("seqnum", F.col("sequence_embeddings").alias("v"))
    emb = once(emb, "seqnum").select("seqnum", F.col("v").cast("array<double>").alias("emb"))
    size = residues(spark, folder, vectors=False).groupBy("seqnum").agg(F.min("fasta").alias("fasta"), F.count("*").alias("seqlen"))
    return emb.join(size, "seqnum")


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """rbh rows with readable labels and a number as sim, once per unordered pair of residues: (s1, p1) < (s2, p2), greatest sim."""
    part = lambda c, i: F.expr(f"try_cast(regexp_extract({c}, r'{LABEL}', {i}) as int)")
    df = table(spark, folder, "rbh").filter("sim is not null and not isnan(sim)").select(F.struct(part("aa1", 1).alias("s"), part("aa1", 2).alias("p")).alias("x"), F.struct(part("aa2", 1).alias("s"), part("aa2", 2).alias("p")).alias("y"), "sim")
    df = df.filter("x.s is not null and y.s is not null and x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "sim")
    return df.groupBy("x", "y").agg(F.max("sim").alias("sim")).select(F.col("x.s").alias("s1"), F.col("x.p").alias("p1"), F.col("y.s").alias("s2"), F.col("y.p").alias("p2"), "sim")


def columns(spark: SparkSession, folder: str) -> DataFrame:
    """Column assignments (clustid, seqnum, seqpos), each once, without -1 and nulls."""
    return table(spark, folder, "clusters").filter("clustid is not null and clustid <> -1 and seqnum is not null and seqpos is not null").select("clustid", "seqnum", "seqpos").distinct()


def read_fasta(spark: SparkSession, path: str, truncate: int | None = None, minlength: int = 1, padding: int = 0) -> DataFrame:
    """seqnum (order in the file), name (header up to the first blank), seq, spaced, path of FASTA files; wrapped lines are joined.

    spaced has `padding` X before and after the sequence and blanks between all letters.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("v"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    cut = F.split("v", r"\r?\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(cut, F.lit(1)), F.lit("")), r"\s", "")
    seq = F.substring(seq, 1, truncate) if truncate else seq
    df = raw.select(F.split(F.trim(F.get(cut, F.lit(0))), r"\s+")[0].alias("name"), seq.alias("seq"), "path", "at").filter(F.length("seq") >= minlength)
    from pyspark.sql import Window

    return df.select((F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).alias("seqnum"), "name", "seq", F.array_join(F.split(F.concat(F.lit("X" * padding), "seq", F.lit("X" * padding)), ""), " ").alias("spaced"), "path")


def write_fasta(df: DataFrame, path: str) -> None:
    """One record of (name, seq) per row, as text; the row order is that of the frame."""
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)
