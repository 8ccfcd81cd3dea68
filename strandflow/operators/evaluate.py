"""Evaluation against reference matches, and the summaries made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def scores(found: DataFrame, labels: DataFrame) -> DataFrame:
    """protein, tp, fp, fn, precision, recall, f1 of found (protein, aa1, aa2) against labels (…, label 1 or 0). 0 where undefined."""
    keys = ["protein", "aa1", "aa2"]
    both = found.select(*keys, F.lit(1).alias("hit")).distinct().join(labels.select(*keys, "label"), keys, "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit, true = F.col("hit").isNotNull(), F.col("label") == 1
    df = both.filter("label is not null").groupBy("protein").agg(n(hit & true).alias("tp"), n(hit & ~true).alias("fp"), n(~hit & true).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    df = df.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6)})
    return df.withColumn("f1", F.round(ratio(2 * p * r, p + r), 6))


def win_table(long: DataFrame, entity: str, alg: str, score: str, algs: list[str]) -> DataFrame:
    """entity with one score column per algorithm: the pivot of a long table, values listed."""
    return long.groupBy(entity).pivot(alg, algs).agg(F.round(F.max(score), 6))


def bins(value: Column, width: float = 0.1, top: float = 0.6) -> Column:
    """Lower bound of the bin of value, capped before grouping."""
    return F.least(F.floor(value / width) * width, F.lit(top))


def head(df: DataFrame, n: int, *by: Column) -> DataFrame:
    """The first n rows in the order `by`, with their place from 1: sorted and cut on Spark, numbered after that."""
    return df.orderBy(*by).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*by)))


def sample(df: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """n rows drawn at random; the seed and the keys decide, not the partitions."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
