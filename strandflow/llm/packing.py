"""Filling fixed-capacity containers with items: cost-balanced packing of documents by token counts.

The cost of a sequence is LINEAR x tokens + QUADRATIC x sum of squared document lengths (attention within documents).
Documents are hashed into shards of about SHARD pieces, so no task sees them all. In a shard as many containers are
opened as the tokens need at least; pieces go, in descending size, each into the container of the lowest cost among those
with room that it fills to within SLACK tokens of the tightest (all with room, as the plain rule has it, left 3.7 % of the
rests' space unused on the test documents, this 0.3 %); a piece that fits nowhere opens a container. A document longer than the capacity is cut into full containers
and a rest; no other is cut.

Defined results: documents without tokens (null, empty) are placed with 0 tokens in a container; a null id is ignored;
ties go to the smaller id and container; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.session import cut

CAPACITY, SHARD, SLACK = 2048, 20_000, 400
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
PACKED = "container long, doc_id long, part int, start long, n_tokens int"


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece; sizes are descending and at most capacity."""
    bins = max(1, math.ceil(sizes.sum() / capacity))
    room, cost, at = np.full(bins, capacity, np.int64), np.zeros(bins), np.zeros(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        left = np.where(room >= n, room - n, capacity + SLACK + 1)
        tight = int(left.min())
        if tight > capacity:
            j = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        else:
            j = int(np.where(left <= tight + SLACK, cost, np.inf).argmin())
        at[i] = j
        room[j] -= n
        cost[j] += LINEAR * n + QUADRATIC * n * n
    return at


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Rows of PACKED for sizes(doc_id, n)."""
    sizes = cut(sizes.filter("doc_id is not null").select("doc_id", F.greatest("n", F.lit(0)).alias("n")))
    shards = max(1, math.ceil(sizes.count() / shard))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, n = table["doc_id"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], n[order]
        full = n // capacity
        rest = n - full * capacity
        own = np.repeat(np.arange(len(ids)), full)
        part = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
        open_ = np.flatnonzero((rest > 0) | (n == 0))
        open_ = open_[np.argsort(-rest[open_], kind="stable")]
        at = fill(rest[open_], capacity)
        used = int(at.max()) + 1 if len(at) else 0
        base = key[0].as_py() << 32
        column = lambda a, b: np.concatenate([a, b])
        return pa.table({
            "container": base + column(at, used + np.arange(len(own))), "doc_id": column(ids[open_], ids[own]), "part": column(full[open_], part).astype(np.int32),
            "start": column(full[open_] * capacity, part * capacity), "n_tokens": column(rest[open_], np.full(len(own), capacity)).astype(np.int32),
        })

    spread = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition(shards, "shard")  # small in bytes: keep the tasks apart
    return spread.groupBy("shard").applyInArrow(run, PACKED)
