"""Dimension reduction and batch correction of residue vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca_model(df: DataFrame, k: int, vec: str = "emb", sample: int | None = None, seed: int = 7):
    """A pipeline model that centres vectors and gives their k leading principal coordinates; .write().save() and PipelineModel.load() keep it.

    With `sample` it is fitted on about as many rows, drawn with replacement. Needs k rows or more.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler

    n = df.count()
    if n < k:
        raise ValueError(f"fewer than {k} rows")
    rows = df.sample(True, sample / n, seed) if sample and sample < n else df
    return Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c"), PCA(k=k, inputCol="_c", outputCol="_p")]).fit(_as_vectors(rows, vec))


def _as_vectors(df: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_v", array_to_vector(F.col(vec)))


def apply_pca(model, df: DataFrame, vec: str = "emb") -> DataFrame:
    """df with `reduced`, the coordinates that the model gives."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(_as_vectors(df, vec)).withColumn("reduced", vector_to_array("_p")).drop("_v", "_c", "_p")


def pca(df: DataFrame, k: int, vec: str = "emb", sample: int | None = None) -> DataFrame:
    """df with `reduced`: the k leading principal coordinates of the centred vectors (signs are arbitrary)."""
    return apply_pca(pca_model(df, k, vec, sample), df, vec)


def _shrink(batches):
    """Empirical-Bayes location and scale of each (batch, dim), from its moments alone; iterated to a relative change of 1e-4."""
    for t in batches:
        n, gh, dh, gbar, t2, a, b = (t[c].to_numpy(float) for c in ("n", "gamma", "delta", "gbar", "t2", "a", "b"))
        g, d = gh.copy(), dh.copy()
        for _ in range(200):
            g2 = (t2 * n * gh + d * gbar) / np.maximum(t2 * n + d, 1e-300)
            d2 = (0.5 * ((n - 1) * dh + n * (gh - g2) ** 2) + b) / (n / 2 + a - 1)
            change = max(np.max(np.abs(g2 - g) / np.maximum(np.abs(g), 1e-12), initial=0), np.max(np.abs(d2 - d) / np.maximum(d, 1e-12), initial=0))
            g, d = g2, d2
            if change <= 1e-4:
                break
        yield pd.DataFrame({"fasta": t["fasta"], "seqnum": t["seqnum"], "dim": t["dim"], "shift": g, "scale": np.sqrt(np.maximum(d, 1e-12)), "grand": t["grand"], "sd": t["sd"]})


def unit_dimensions(df: DataFrame) -> DataFrame:
    """(fasta, …, emb) with every dimension of unit length over the residues of a file; one without values other than 0 stays."""
    length = df.select("fasta", F.posexplode("emb").alias("dim", "x")).groupBy("fasta", "dim").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    lengths = length.groupBy("fasta").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "l"))), lambda s: s["l"]).alias("ls"))  # one entry per dimension
    return df.join(lengths, "fasta").withColumn("emb", F.zip_with("emb", "ls", lambda x, l: F.when(l > 0, x / l).otherwise(x))).drop("ls")


def combat(df: DataFrame, reference: int | None = None, unit: bool = False) -> DataFrame:
    """(fasta, seqnum, idx, emb) with emb adjusted for location and scale of each sequence within its file.

    With reference, a seqindex-like number found in seqnum, the other sequences of its file are adjusted to that one, which stays
    as it is; unit gives every dimension unit length over the file first.

    All statistics are grouped aggregates over (file, sequence, dimension); only they are iterated. Sequences of fewer than
    two residues, and dimensions without variance, stay as they are.
    """
    df = unit_dimensions(df) if unit else df
    x = df.select("fasta", "seqnum", F.posexplode("emb").alias("dim", "x"))
    batch = x.groupBy("fasta", "seqnum", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("vp"), F.var_samp("x").alias("vs")).filter("n > 1")
    whole = batch.groupBy("fasta", "dim").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sqrt(F.sum(F.col("n") * F.col("vp")) / F.sum("n")).alias("sd")).filter("sd > 0")
    if reference is not None:
        own = batch.filter(F.col("seqnum") == reference).select("fasta", "dim", F.col("mean").alias("g"), F.sqrt("vp").alias("s")).filter("s > 0")
        whole = whole.join(own, ["fasta", "dim"], "left").select("fasta", "dim", F.coalesce("g", "grand").alias("grand"), F.coalesce("s", "sd").alias("sd"))
        batch = batch.filter(F.col("seqnum") != reference)
    std = batch.join(whole, ["fasta", "dim"]).withColumns({"gamma": (F.col("mean") - F.col("grand")) / F.col("sd"), "delta": F.col("vs") / (F.col("sd") * F.col("sd"))})
    prior = std.groupBy("fasta", "seqnum").agg(F.avg("gamma").alias("gbar"), F.var_pop("gamma").alias("t2"), F.avg("delta").alias("m"), F.var_pop("delta").alias("s2")).filter("s2 > 0")
    prior = prior.withColumns({"a": (2 * F.col("s2") + F.col("m") * F.col("m")) / F.col("s2"), "b": (F.col("m") * F.col("s2") + F.pow("m", F.lit(3))) / F.col("s2")})
    fitted = std.join(prior, ["fasta", "seqnum"]).mapInPandas(_shrink, "fasta string, seqnum int, dim int, shift double, scale double, grand double, sd double")
    stats = fitted.groupBy("fasta", "seqnum").agg(F.map_from_entries(F.collect_list(F.struct("dim", F.struct("shift", "scale", "grand", "sd")))).alias("s"))  # one entry per dimension
    move = lambda v, i: F.when(F.col("s")[i].isNull(), v).otherwise(((v - F.col("s")[i]["grand"]) / F.col("s")[i]["sd"] - F.col("s")[i]["shift"]) / F.col("s")[i]["scale"] * F.col("s")[i]["sd"] + F.col("s")[i]["grand"])
    return df.join(stats, ["fasta", "seqnum"], "left").withColumn("emb", F.when(F.col("s").isNull(), F.col("emb")).otherwise(F.transform("emb", move))).drop("s")
