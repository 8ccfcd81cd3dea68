import glob
import itertools
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandflow.operators import chains, columns, graph, hits
from strandflow.plans import catalogue
from strandflow.sources import tables


def rows(frame: pd.DataFrame, cols: list[str]) -> list[tuple]:
    text = lambda v: "null" if v is None or v is pd.NA or isinstance(v, float) and v != v else str([text(x) for x in v]) if isinstance(v, (list, np.ndarray)) else repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.number)) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    got, want = catalogue.queries()[name](spark, folder).toPandas(), con.sql(catalogue.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 5)), max_size=9))
def test_heaviest_chain_against_all_subsets(edges):
    p1, p2, w = (np.array([e[i] for e in edges], int) for i in range(3))
    chain = chains.heaviest_chain(p1, p2, w) if edges else []
    best = 0
    for n in range(1, len(edges) + 1):
        for c in itertools.combinations(range(len(edges)), n):
            s = sorted(c, key=lambda i: p1[i])
            if all(p1[a] < p1[b] and p2[a] < p2[b] for a, b in zip(s, s[1:])):
                best = max(best, w[list(c)].sum())
    assert sum(w[i] for i in chain) == best
    assert all(p1[a] < p1[b] and p2[a] < p2[b] for a, b in zip(chain, chain[1:]))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (3, 2, 1.0), (9, 8, 1.0), (8, 10, 1.0), (5, 5, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (10, 8)}
    assert graph.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_components_in_rounds(spark, chunk):
    """Small chunks need several rounds of stars."""
    rng = np.random.default_rng(1)
    pairs = [*rng.integers(0, 60, (50, 2)).tolist(), *([i, i + 1] for i in range(100, 140)), *([200, 201 + i] for i in range(30)), [300, 300]]
    root = {v: v for p in pairs for v in p}
    find = lambda v: v if root[v] == v else find(root[v])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(v, find(v)) for a, b in pairs if a != b for v in (a, b)}
    assert {tuple(r) for r in graph.components(spark.createDataFrame(pairs, "src long, dst long"), chunk).collect()} == want


def test_planted_columns(spark):
    """Copies of planted column vectors come back as reciprocal best hits, whatever the blocks."""
    rng = np.random.default_rng(3)
    base, data = rng.standard_normal((30, 16)), []
    for s in range(6):
        for p in range(30):
            if (s * 7 + p) % 11:  # some columns are missing
                data.append((s, s, p, "A", s * 100 + p, "f", (base[p] + 0.05 * rng.standard_normal(16)).tolist()))
    df = spark.createDataFrame(data, "seqnum int, seqindex int, seqpos int, seqaa string, idx long, fasta string, emb array<double>")
    found = hits.reciprocal(hits.neighbours(df, 1, True, 0.7, block=40).drop("rank")).collect()
    want = {(a[4], b[4]) for a in data for b in data if a[0] < b[0] and a[2] == b[2]}
    assert {(r["q"], r["t"]) for r in found} == want


def test_gaps_at_the_ends(spark):
    res = spark.createDataFrame([(0, i) for i in range(6)], "seqnum int, seqpos int")
    placed = spark.createDataFrame([(0, 1, 7), (0, 4, 9)], "seqnum int, seqpos int, clustid int")
    assert {tuple(r) for r in columns.gaps(res, placed).collect()} == {(0, None, 7, 0, 0, 1), (0, 7, 9, 2, 3, 2), (0, 9, None, 5, 5, 1)}


def test_fasta_round_trip(spark, tmp_path):
    source = tmp_path / "a.fasta"
    source.write_text(">s1 first\nACDE\nFG\n>s2\r\nKL\n>empty\n")
    got = [tuple(r)[:3] for r in tables.read_fasta(spark, str(source)).orderBy("seqnum").collect()]
    assert got == [(0, "s1", "ACDEFG"), (1, "s2", "KL")]
    tables.write_fasta(tables.read_fasta(spark, str(source)), str(tmp_path / "out"))
    assert {tuple(r)[1:3] for r in tables.read_fasta(spark, str(tmp_path / "out")).collect()} == {("s1", "ACDEFG"), ("s2", "KL")}


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "fasta"
    assert set(entry.oracle_sql()) <= set(entry.queries())
