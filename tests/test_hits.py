import numpy as np
import pytest

from strandflow.operators import hits


def _residues(spark, lengths, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(9, 6))
    rows = [(f"f{s % 2}", s, p, [float(x) for x in (base[rng.integers(9)] + 0.3 * rng.normal(size=6)).round(2)]) for s, n in enumerate(lengths) for p in range(n)]
    return spark.createDataFrame([(f, i, s, p, v) for i, (f, s, p, v) in enumerate(rows)], "fasta string, idx long, seqnum int, seqpos int, emb array<double>")


def _wanted(res, minscore):
    """(q, t) -> similarity of the best hits, pair by pair."""
    rows = res.collect()
    unit = {r.idx: np.array(r.emb) / np.linalg.norm(r.emb) for r in rows}
    best = {}
    for a in rows:
        for b in rows:
            sim = round(float(unit[a.idx] @ unit[b.idx]), 6)
            if a.fasta == b.fasta and a.seqnum != b.seqnum and sim >= minscore:
                best[a.idx, b.seqnum] = min(best.get((a.idx, b.seqnum), (9, 0)), (-sim, b.idx))
    return {(q, t): -s for (q, _), (s, t) in best.items()}


@pytest.mark.parametrize("block, size", [(1000, 1 << 21), (40, 1 << 21), (8, 1 << 21), (40, 64)])
def test_best_and_reciprocal_hits_in_any_blocks(spark, monkeypatch, block, size):
    """Sequences whole or in pieces, files in one block or many, and slices too small to keep what is near both ways."""
    monkeypatch.setattr(hits, "SLICE", size)
    res = _residues(spark, [12, 17, 9, 30, 5, 21, 14]).cache()
    want = _wanted(res, 0.7)
    best = hits.neighbours(res, 1, True, 0.7, block=block)
    assert {(r.q, r.t): r.sim for r in best.collect()} == pytest.approx(want)
    mutual = {(r.q, r.t) for r in hits.reciprocal_hits(res, 0.7, block=block).collect()}
    seq = {r.idx: r.seqnum for r in res.collect()}
    assert mutual == {(q, t) for q, t in want if (t, q) in want and seq[q] < seq[t]}


def test_whole_sequences_are_not_ranked_again(spark):
    """What a group has ranked for good takes part in no further sort of all hits."""
    res = _residues(spark, [12, 17, 9])
    for df in (hits.best_hits(res), hits.reciprocal_hits(res), hits.neighbours(res, 3, False)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("block", [1000, 20])
def test_nearest_from_maxima_of_groups(spark, block):
    """The k nearest in one block, where maxima of groups give the bound, and in many."""
    res = _residues(spark, [12, 17, 9, 30, 5, 21, 14, 8], seed=2).cache()
    rows = res.collect()
    unit = {r.idx: np.array(r.emb) / np.linalg.norm(r.emb) for r in rows}
    want = {}
    for a in rows:
        near = sorted((-round(float(unit[a.idx] @ unit[b.idx]), 6), b.idx) for b in rows if a.fasta == b.fasta and a.idx != b.idx)[:2]
        want |= {(a.idx, t): i + 1 for i, (_, t) in enumerate(near)}
    assert {(r.q, r.t): r["rank"] for r in hits.neighbours(res, 2, False, own=True, block=block).collect()} == want
