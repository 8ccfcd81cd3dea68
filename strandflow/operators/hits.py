"""Exact similarity search within each file, in blocks, and the hits made of it.

A file's residues are hashed into blocks of about BLOCK, a sequence (or a piece of BLOCK of it) in one; every unordered
pair of blocks of a file is one group of at most two blocks and gives the hits of both directions, so a large file is
spread over many tasks and no group grows with it. Inside, NumPy multiplies in single precision; what can be among the
best is computed again in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.session import cut

#: Rows of a block, error of single precision, products that are held at once.
BLOCK, SLACK, SLICE = 16_384, 1e-5, 1 << 21
HITS = "fasta string, q bigint, q_seq int, q_pos int, t bigint, t_seq int, t_pos int, sim double"


def _cosines(x: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", x[q[i : i + 65_536]], x[t[i : i + 65_536]]) for i in range(0, len(q), 65_536))])


def _kept(x: np.ndarray, idx: np.ndarray, seq: np.ndarray, a: np.ndarray, b: np.ndarray, v: np.ndarray, k: int, per_target: bool, minscore: float):
    """q, t, sim, rank: of each row of a the k best of its rows b (of each sequence), in the order of (a, seq, idx of b) with rough similarities v."""
    if per_target and k == 1 and len(a):  # what cannot be the best of its sequence goes before it is computed again
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (seq[b[1:]] != seq[b[:-1]])])
        near = v >= np.repeat(np.maximum.reduceat(v, first), np.diff(np.r_[first, len(v)])) - SLACK
        a, b = a[near], b[near]
    sim = np.round(_cosines(x, a, b), 6)
    ok = sim >= minscore
    a, b, sim = a[ok], b[ok], sim[ok]
    group = seq[b] if per_target else np.zeros(len(b), int)
    order = np.lexsort((idx[b], -sim, group, a))
    a, b, sim, group = a[order], b[order], sim[order], group[order]
    at = np.arange(len(a))
    start = np.r_[True, (np.diff(a) != 0) | (np.diff(group) != 0)] if len(a) else np.zeros(0, bool)
    rank = at - np.maximum.accumulate(np.where(start, at, 0)) + 1
    keep = rank <= k
    return a[keep], b[keep], sim[keep], rank[keep]


def _near(y: np.ndarray, seq: np.ndarray, qs: np.ndarray, ts: np.ndarray, k: int, per_target: bool, minscore: float, own: bool):
    """By slices of qs the places in qs and ts of the pairs that can be among the k best of a row of qs (of each sequence), and their rough similarities."""
    lowest, wide, high = np.float32(max(minscore, -2) - SLACK), len(ts) // 16, y[ts].T
    left, right = (np.searchsorted(seq[ts], seq[qs], side) for side in ("left", "right"))
    n = max(1, SLICE // max(1, len(ts)))
    for i in range(0, len(qs), n):
        s, floor = y[qs[i : i + n]] @ high, lowest
        if not own:
            for r in np.flatnonzero(right[i : i + n] > left[i : i + n]):
                s[r, left[i + r] : right[i + r]] = -4
        if qs is ts:
            s[np.arange(len(s)), i + np.arange(len(s))] = -4
        if not per_target and k < len(ts):
            # The k-th of the maxima of disjoint groups is not above the k-th best.
            tops = s[:, : wide * 16].reshape(len(s), 16, wide).max(1) if wide > k else s
            floor = np.maximum(np.partition(tops, tops.shape[1] - k, 1)[:, [tops.shape[1] - k]] - SLACK, floor)
        at = np.flatnonzero(s >= floor)
        a, b = np.divmod(at, len(ts))
        yield i + a, b, s.ravel()[at]


def _ranked(table: pa.Table, k: int, per_target: bool, minscore: float, own: bool, mutual: bool) -> pa.Table:
    side = table["b"].to_numpy()
    cols = {c: table[c].to_numpy() for c in ("idx", "seqnum", "seqpos")}
    idx, seq = cols["idx"], cols["seqnum"]
    emb = table["emb"].combine_chunks()
    x = (emb.flatten().to_numpy() if isinstance(emb, pa.Array) else np.concatenate([c.flatten().to_numpy() for c in emb.chunks])).reshape(len(side), -1).astype(np.float64)
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    y, order = x.astype(np.float32), np.lexsort((idx, seq))
    one, two = (order[side[order] == e] for e in (side.min(), side.max()))
    # A group holds the rows of its two blocks, or of one of them alone where the other has no row.
    same = table["i"][0].as_py() == table["j"][0].as_py()
    kept = lambda a, b, v: _kept(x, idx, seq, a, b, v, k, per_target, minscore)
    parts = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))]
    if same or side.min() != side.max():
        back, held = [], 0  # what is near one way is so the other way; too many are found again
        for a, b, v in _near(y, seq, one, one if same else two, k, per_target, minscore, own):
            parts.append(kept(one[a], (one if same else two)[b], v))
            held += len(a)
            back = [*back, (a, b, v)] if per_target and not same and held <= 2 * SLICE else []
        if back and held <= 2 * SLICE:
            a, b, v = (np.concatenate(e) for e in zip(*back))
            by = np.lexsort((a, b))
            parts.append(kept(two[b[by]], one[a[by]], v[by]))
        elif not same:
            parts += [kept(two[a], one[b], v) for a, b, v in _near(y, seq, two, one, k, per_target, minscore, own)]
    q, t, sim, rank = (np.concatenate(p) for p in zip(*parts))
    if mutual:
        both = np.isin(q * len(side) + t, t * len(side) + q) & (seq[q] < seq[t])
        q, t, sim, rank = q[both], t[both], sim[both], rank[both]
    name = table["fasta"].take(pa.array(q))
    return pa.table([name, *(pa.array(cols[c][i]) for i in (q, t) for c in ("idx", "seqnum", "seqpos")), pa.array(sim), pa.array(rank.astype(np.int32))], names=["fasta", "q", "q_seq", "q_pos", "t", "t_seq", "t_pos", "sim", "rank"])


def _searched(residues: DataFrame, k: int, per_target: bool, minscore: float, own: bool, block: int, mutual: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """HITS with rank of the files of which every group gives the final rows, and of the others (None: there are none), whose
    groups give the best of parts of what is ranked together. With mutual, the former are only hits both ways, once, with q_seq < t_seq."""
    sizes = residues.groupBy("fasta").agg(F.ceil(F.count("*") / block).cast("int").alias("m"), (F.max(F.floor(F.col("seqpos") / block)) > F.min(F.floor(F.col("seqpos") / block))).alias("long"))
    sizes = cut(sizes.withColumn("apart", (F.col("m") > 1) & (F.col("long") if per_target else F.lit(True))).drop("long"))

    def found(of: DataFrame, both: bool) -> DataFrame:
        rows = residues.select("fasta", "idx", "seqnum", "seqpos", "emb").join(of, "fasta")
        rows = rows.withColumn("b", F.pmod(F.xxhash64("seqnum", F.floor(F.col("seqpos") / block)), F.col("m")).cast("int"))
        pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumns({"i": F.least("b", "other"), "j": F.greatest("b", "other")}).drop("other", "m")
        return pairs.groupBy("fasta", "i", "j").applyInArrow(lambda g: _ranked(g, k, per_target, minscore, own, both), HITS + ", rank int")

    apart = sizes.filter("apart").select("fasta", "m")
    some = not apart.isEmpty()
    return found(sizes.filter("not apart").select("fasta", "m") if some else sizes.select("fasta", "m"), mutual), found(apart, False) if some else None


def neighbours(residues: DataFrame, k: int, per_target: bool, minscore: float = -2.0, own: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows of HITS with rank: the k nearest residues of each residue in its file, or of each other sequence of it.

    Ties go to the smaller idx, which is one residue's alone; similarities are rounded to 6 places; a residue is never its
    own neighbour. Only what several groups have a part of is ranked again: hits of files with a sequence in several pieces
    or, without per_target, in several blocks.
    """
    final, parts = _searched(residues, k, per_target, minscore, own, block)
    if parts is None:
        return final
    by = ["q", "t_seq"] if per_target else ["q"]
    return final.unionByName(parts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sim"), "t"))).filter(F.col("rank") <= k))


def reciprocal_hits(residues: DataFrame, minscore: float = 0.7, block: int = BLOCK) -> DataFrame:
    """reciprocal(best_hits(residues, minscore)). Where no sequence is in several pieces both directions meet in one group, and only the pairs leave it."""
    final, parts = _searched(residues, 1, True, minscore, False, block, mutual=True)
    final = final.drop("rank")
    if parts is None:
        return final
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("q", "t_seq").orderBy(F.desc("sim"), "t"))).filter("rank = 1").drop("rank")
    return final.unionByName(reciprocal(best).select(final.columns))


def clamped(sim, least: float = 0.001):
    """Similarity as an edge weight: below 0 it is `least`."""
    return F.when(sim < 0, least).otherwise(sim)


def best_hits(residues: DataFrame, minscore: float = 0.7) -> DataFrame:
    """The nearest residue of each other sequence of the file, from minscore up."""
    return neighbours(residues, 1, True, minscore).drop("rank")


def reciprocal(hits: DataFrame) -> DataFrame:
    """Pairs of residues that are each other's best hit, once, with q_seq < t_seq. Both directions meet in one aggregation, so hits are made once."""
    turned = F.col("q_seq") > F.col("t_seq")
    side = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    ends = [side(a, b).alias(a) for a, b in (("q", "t"), ("q_seq", "t_seq"), ("q_pos", "t_pos"), ("t", "q"), ("t_seq", "q_seq"), ("t_pos", "q_pos"))]
    both = hits.filter("q_seq <> t_seq").select("fasta", *ends, "sim")
    return both.groupBy(*both.columns).agg(F.count("*").alias("n")).filter("n = 2").drop("n")


def restricted(residues: DataFrame, scope: DataFrame, minscore: float = 0.5) -> DataFrame:
    """Best hits of the residues of scope(idx) inside the scope: only they are searched, so the best of them counts even if a better one lies outside."""
    return best_hits(residues.join(scope.select("idx"), "idx", "left_semi"), minscore)


def sequence_similarities(vectors: DataFrame, minscore: float = -2.0) -> DataFrame:
    """seq1 < seq2, seqsim, seqlen1, seqlen2, correctedseqsim for the pairs of sequences of one file from minscore up.

    The same blocks as for residues, so pairs below minscore never leave their task and a file is spread over many.
    The correction only lowers a similarity, so minscore may also serve for the corrected one.
    """
    from strandflow.functions.vectors import length_correction

    rows = vectors.select("fasta", "seqnum", F.lit(0).alias("seqpos"), F.col("seqnum").cast("long").alias("idx"), "emb")
    pairs = neighbours(rows, 1, True, minscore).filter("q_seq < t_seq").select(F.col("q_seq").alias("seq1"), F.col("t_seq").alias("seq2"), F.col("sim").alias("seqsim"))
    size = lambda s, n: vectors.select(F.col("seqnum").alias(s), F.col("seqlen").alias(n))
    df = pairs.join(size("seq1", "seqlen1"), "seq1").join(size("seq2", "seqlen2"), "seq2").select("seq1", "seq2", "seqsim", "seqlen1", "seqlen2")
    return df.withColumn("correctedseqsim", F.round(F.col("seqsim") * length_correction(F.col("seqlen1"), F.col("seqlen2")), 6))
