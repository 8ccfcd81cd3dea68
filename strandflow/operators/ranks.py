"""Dense numbering of ids without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.session import cut


def dense_index(ids: DataFrame, key: str, name: str) -> DataFrame:
    """key, name: 0-based places of distinct, ordered keys: ranges are numbered inside, and start at the sizes of those before."""
    parts = cut(ids.repartitionByRange(key).select(key, F.spark_partition_id().alias("part")))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "start")
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return parts.withColumn("place", place).join(F.broadcast(starts), "part").select(key, (F.col("place") + F.col("start")).cast("int").alias(name))


def starts(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """sizes with start: the sum of `size` of the smaller keys, which are distinct; in ranges as dense_index()."""
    parts = cut(sizes.repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(key)
    whole = parts.groupBy("part").agg(F.sum(size).alias("s"))  # one row per partition
    before = whole.withColumn("before", F.sum("s").over(Window.orderBy("part")) - F.col("s")).select("part", "before")
    return parts.withColumn("start", F.sum(size).over(own) - F.col(size)).join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")
