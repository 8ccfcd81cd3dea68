import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandflow.operators import centrality, doubles, filling, order
from strandflow.plans.align import align

DIM = 64  # unrelated vectors stay below the gap score
RES = "seqnum int, seqindex int, seqpos int, seqaa string, idx long, fasta string, emb array<double>, clustid string, col string"


def planted(noise=0.05, length=24, seed=5):
    """Six copies of planted columns with some left out, in two files, and an unrelated sequence; truth by (seqnum, seqpos)."""
    rng = np.random.default_rng(seed)
    data, truth = [], {}
    for f in range(2):
        base = rng.standard_normal((length, DIM))
        for s in range(f * 10, f * 10 + 6):
            p = 0
            for c in range(length):
                if (s * 5 + c * 3) % 11:
                    truth[s, p] = (f, c)
                    data.append((s, s % 10, p, "A", s * 100 + p, f"f{f}", (base[c] + noise * rng.standard_normal(DIM)).tolist(), "x", "y"))
                    p += 1
    for p in range(8):
        data.append((9, 9, p, "A", 900 + p, "f0", rng.standard_normal(DIM).tolist(), None, None))
    return data, truth


def test_align_finds_planted_columns(spark):
    data, truth = planted()
    got = align(spark.createDataFrame(data, RES), chain="weighted").toPandas()
    assert len(got) == len(data) and not got.duplicated(["seqnum", "seqpos"]).any()
    got["truth"] = [truth.get((s, p), ("none", s * 100 + p)) for s, p in zip(got.seqnum, got.seqpos)]
    assert (got.groupby("col").truth.nunique() == 1).all() and (got.groupby("truth").col.nunique() == 1).all()
    assert (got.groupby("col").fasta.nunique() == 1).all()
    ordered = got[got.seqnum != 9].sort_values(["seqnum", "seqpos"])
    assert (ordered.groupby("seqnum").col.diff().dropna() > 0).all()


def test_align_of_nothing(spark):
    df = spark.createDataFrame(planted()[0][:3], RES)
    assert align(df.limit(0)).count() == 0
    assert align(df).count() == 3  # one sequence: columns of their own
    with pytest.raises(ValueError):
        align(df, chain="other")


def test_order_of_crossing_sequences(spark):
    """A swapped pair and a cycle leave columns whose arcs all run forward."""
    paths = {0: [1, 2, 3, 4], 1: [1, 2, 3, 4], 2: [1, 3, 2, 4], 3: [4, 1], 4: [7], 5: [2, 2, 3]}
    placed = spark.createDataFrame([(s, i, c) for s, p in paths.items() for i, c in enumerate(p)], "seqnum int, seqpos int, clustid int")
    o = order.column_order(placed)
    assert [r["clustid"] for r in o.orderBy("col").collect() if r["clustid"] != 7] == [1, 2, 3, 4]
    assert {(r["c1"], r["c2"]) for r in order.feedback_arcs(placed, o).collect()} == {(3, 2), (4, 1)}
    kept = order.consistent(placed, o)
    assert order.feedback_arcs(kept, o).count() == 0
    assert kept.count() == placed.count() - 3
    assert not order.is_acyclic(placed) and order.is_acyclic(kept)
    assert order.column_order(placed.limit(0)).count() == 0


def test_sequences_that_start_late(spark):
    """Without a cycle there is no feedback arc and no member is dropped, wherever the sequences start."""
    paths = {0: range(20), 1: range(14, 20), 2: range(15, 20), 3: range(16, 20), 4: [2, 9, 17]}
    placed = spark.createDataFrame([(s, i, c) for s, p in paths.items() for i, c in enumerate(p)], "seqnum int, seqpos int, clustid int")
    o = order.column_order(placed)
    assert [r["clustid"] for r in o.orderBy("col").collect()] == list(range(20))
    assert order.feedback_arcs(placed, o).count() == 0 and order.consistent(placed, o).count() == placed.count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 11), min_size=2, max_size=6), min_size=1, max_size=8), st.booleans())
def test_levels_against_all_ways(paths, acyclic):
    """Levels are longest ways, cyclic parts what leads to each other; only arcs inside such a part may run back."""
    paths = [sorted(set(p)) if acyclic else p for p in paths]
    arcs = sorted({(a, b) for p in paths for a, b in zip(p, p[1:]) if a != b})
    if not arcs:
        return
    at = {}
    for p in paths:
        for i, c in enumerate(p):
            at.setdefault(c, []).append(i)
    x = {c: sum(v) / len(v) for c, v in at.items()}
    got = {r["clustid"]: (r["level"], r["cycle"]) for r in order._leveled(pa.table({"c1": [a for a, _ in arcs], "c2": [b for _, b in arcs], "x1": [x[a] for a, _ in arcs], "x2": [x[b] for _, b in arcs]})).to_pylist()}
    reach = {c: {b for a, b in arcs if a == c} for c in got}
    for _ in got:
        reach = {c: r.union(*(reach[y] for y in r)) for c, r in reach.items()}
    for c, (_, cycle) in got.items():
        assert cycle == (min(y for y in reach[c] if c in reach[y]) if c in reach[c] else None)
    back = [(a, b) for a, b in arcs if (got[a][0], a) > (got[b][0], b)]
    assert all(got[a][1] is not None and got[a][1] == got[b][1] for a, b in back)
    if acyclic:
        best = {}
        way = lambda c: best.setdefault(c, max((way(a) + 1 for a, b in arcs if b == c), default=0))
        assert {c: v for c, (v, _) in got.items()} == {c: way(c) for c in got}


def test_betweenness_and_hubs(spark):
    two = [(a, b) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)]
    edges = [(*e, 1.0) for e in [*two, (3, 20), (20, 10), (3, 20), (5, 5), (30, 31)]]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    got = {r["vertex"]: r["betweenness"] for r in centrality.betweenness(df).collect()}
    assert got == {r["vertex"]: r["betweenness"] for r in centrality.betweenness(df, limit=1).collect()}
    assert got[20] == pytest.approx(16 / 28, abs=1e-5) and got[3] == pytest.approx(15 / 28, abs=1e-5) and got[0] == 0 and got[30] == 0
    kept = {(r["src"], r["dst"]) for r in centrality.without_brokers(df).collect()}
    assert kept == {e for e in two if 3 not in e and 10 not in e} | {(30, 31)}
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 4)] + [(1, 2, 1.0), (3, 9, 1.0), (9, 8, 1.0)], "src long, dst long, w double")
    a = np.zeros((10, 10))
    for r in star.collect():
        a[r["src"], r["dst"]] = a[r["dst"], r["src"]] = 1
    values, vectors = np.linalg.eigh(a @ a)
    want = np.abs(vectors[:, -1]) / np.abs(vectors[:, -1]).max()
    for limit in (1, 100):
        got = {r["vertex"]: r["hub"] for r in centrality.hub_scores(star, limit).collect()}
        assert all(got[v] == pytest.approx(want[v], abs=2e-3) for v in got)
    assert centrality.betweenness(df.limit(0)).count() == 0


def test_gap_islands(spark):
    """Gaps over a common column share an island, the ends of neighbouring files do not."""
    res = spark.createDataFrame([(s, p, f"f{s // 3}") for s in range(6) for p in range(5)], "seqnum int, seqpos int, fasta string")
    spots = {0: [1, 2, 3, None, 4], 1: [1, None, 3, 4, None], 2: [1, 2, 3, None, None], 3: [None, 5, 6, 7, 8], 4: [5, None, None, 8, 9], 5: [5, 6, None, 7, 8]}
    placed = spark.createDataFrame([(s, p, c) for s, cs in spots.items() for p, c in enumerate(cs) if c], "seqnum int, seqpos int, clustid int")
    o = spark.createDataFrame([(c, c - 1) for c in range(1, 10)], "clustid int, col int")
    got = {}
    for r in filling.gap_islands(filling.open_residues(res, placed, o), placed, o, res).collect():
        got.setdefault(r["island"], set()).add((r["seqnum"], r["seqpos"]))
    # (0, 3) lies between columns 3 and 4, (1, 4) after 4; the gap of sequence 2 is over column 4 and joins both
    assert sorted(map(sorted, got.values())) == [[(0, 3), (1, 4), (2, 3), (2, 4)], [(1, 1)], [(3, 0)], [(4, 1), (4, 2), (5, 2)]]


def test_merge_orders(spark):
    base = np.eye(12)
    one = lambda cols: spark.createDataFrame([(u, 100 * u + int(c), 50 * u + i, base[c].tolist()) for u in (0, 1) for i, c in enumerate(cols)], "unit string, clustid int, col int, emb array<double>")
    got = filling.merge_orders(one([0, 1, 2, 4, 6]), one([1, 3, 4, 5, 6, 7])).toPandas().sort_values(["col", "side"])
    want = [(0, 0), (0, 1), (1, 1), (0, 2), (1, 3), (0, 4), (1, 4), (1, 5), (0, 6), (1, 6), (1, 7)]
    assert list(zip(got.side, got.clustid)) == want + [(s, 100 + c) for s, c in want]
    assert got.groupby("clustid").col.nunique().max() == 1


def test_align_in_groups(spark):
    """Groups of a file are aligned apart and merged; the columns that they share come together."""
    rng = np.random.default_rng(11)
    base, data, truth = rng.standard_normal((20, DIM)), [], {}
    tilt = rng.standard_normal(DIM)
    for s in range(9):
        shown = range(20) if s < 5 else range(5, 20)
        for p, c in enumerate(shown):
            truth[s, p] = c
            v = base[c] + 0.05 * rng.standard_normal(DIM) + (0.45 * tilt if s >= 5 else 0)
            data.append((s, s, p, "A", s * 100 + p, "f", v.tolist(), "x", "y"))
    got = align(spark.createDataFrame(data, RES), group=0.6).toPandas()
    assert len(got) == len(data) and not got.duplicated(["seqnum", "seqpos"]).any()
    got["truth"] = [truth[s, p] for s, p in zip(got.seqnum, got.seqpos)]
    assert (got.groupby("col").truth.nunique() == 1).mean() > 0.9
    assert (got.sort_values(["seqnum", "seqpos"]).groupby("seqnum").col.diff().dropna() > 0).all()


def test_doubles_by_consistency(spark):
    placed = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 7, 9), (1, 8, 2), (1, 9, 10)], "seqnum int, seqpos int, clustid int")
    cols = ["seqnum", "seqpos", "clustid"]
    assert {tuple(r) for r in doubles.by_consistency(placed).select(cols).collect()} == {tuple(r) for r in placed.filter("seqpos <> 8").collect()}
    even = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 2), (1, 5, 1), (1, 6, 2)], "seqnum int, seqpos int, clustid int")
    assert doubles.by_consistency(even).count() == 6 and doubles.by_consistency(even, add_back=False).count() == 2


def test_doubles_by_scores(spark):
    placed = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (1, 3, 1), (2, 0, 1), (2, 4, 1)], "seqnum int, seqpos int, clustid int")
    edges = spark.createDataFrame([(0, 0, 1, 0, 0.4), (0, 0, 1, 3, 0.6), (1, 0, 2, 0, 0.9), (0, 0, 2, 4, -0.1)], "s1 int, p1 int, s2 int, p2 int, sim double")
    assert {(r["seqnum"], r["seqpos"]) for r in doubles.by_scores(placed, edges).collect()} == {(0, 0), (1, 3)}
    assert {(r["seqnum"], r["seqpos"]) for r in doubles.first_pass(placed, edges).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_over_large_components_are_taken_apart(spark):
    """Three planted columns over ten sequences, joined by brokers and by stray links, come out as three."""
    def v(c, s):
        return c * 100 + s
    edges = [(v(c, a), v(c, b), 0.9) for c in range(3) for a in range(10) for b in range(a)] + [(v(0, 3), 900, 0.8), (900, v(1, 4), 0.8), (v(1, 7), v(2, 7), 0.8), (901, 902, 0.7)]
    seqs = [(v(c, s), s) for c in range(3) for s in range(10)] + [(900, 20), (901, 1), (902, 2)]
    got = doubles.taken_apart(spark.createDataFrame(edges, "src long, dst long, w double"), spark.createDataFrame(seqs, "vertex long, seqnum int")).toPandas()
    assert not got.vertex.duplicated().any()
    groups = got.groupby("clustid").vertex.apply(sorted).tolist()
    assert [901, 902] in groups and len(groups) == 4
    assert all(len({x // 100 for x in g}) == 1 and len(g) >= 8 for g in groups if g != [901, 902])


def test_large_parts_as_arrays_and_by_joins(spark, monkeypatch):
    """A ring with chords beyond the small limit: sources dealt to tasks give what one array gives, and what joins give."""
    ring = [(i, (i + 1) % 40, 1.0) for i in range(40)] + [(i, i + 7, 1.0) for i in range(0, 30, 3)] + [(100, 101, 1.0), (101, 102, 1.0)]
    df = spark.createDataFrame(ring, "src long, dst long, w double")
    between = lambda limit: {r["vertex"]: (r["n"], r["betweenness"]) for r in centrality.betweenness(df, limit).collect()}
    hubs = lambda limit: {r["vertex"]: r["hub"] for r in centrality.hub_scores(df, limit).collect()}
    want, scores = between(100), hubs(100)
    monkeypatch.setattr(centrality, "TASK_STEPS", 500)
    joins = []
    monkeypatch.setattr(centrality, "_by_joins", lambda e: joins.append(e))
    assert between(1) == {v: (n, pytest.approx(b, abs=1e-6)) for v, (n, b) in want.items()} and not joins
    assert hubs(1) == pytest.approx(scores, abs=1e-6)
    monkeypatch.undo()
    monkeypatch.setattr(centrality.parts, "ARRAY_EDGES", 10)
    assert between(1) == {v: (n, pytest.approx(b, abs=1e-6)) for v, (n, b) in want.items()}
