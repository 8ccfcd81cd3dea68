import numpy as np
import pytest

from strandflow.operators import chains, columns, reduce
from strandflow.sources import files, tables


def test_clustal_blocks(spark, tmp_path):
    rows = spark.createDataFrame([("a/1", 0, "first one of many with a long name", "A" * 60), ("a/1", 1, "b", "-" * 60), ("c", 2, "d", "K")], "fasta string, seqnum int, name string, row string")
    files.write_clustal(rows, str(tmp_path / "out"))
    lines = [r["line"] for r in files.clustal_lines(rows).filter("fasta = 'a/1'").orderBy("block", "place").collect()]
    assert lines == [files.CLUSTAL, "", "", "first_one_of_many_with_a_long_".ljust(36) + "A" * 50, "b".ljust(36) + "-" * 50, "", "first_one_of_many_with_a_long_".ljust(36) + "A" * 10, "b".ljust(36) + "-" * 10, ""]
    assert spark.read.text(str(tmp_path / "out")).count() == len(lines) + 5


def test_heads_and_groups(spark, tmp_path):
    (tmp_path / "heads.txt").write_text("layer-1_head3\nlayer2_head0\n\n")
    assert files.read_heads(spark, str(tmp_path / "heads.txt")) == [-13, 32]
    df = spark.createDataFrame([(1, "a", "AC"), (1, "b", "DE"), (None, "c", "FG")], "grp int, name string, seq string")
    files.write_group_fasta(df, str(tmp_path / "groups"))
    assert {r["name"] for r in tables.read_fasta(spark, str(tmp_path / "groups" / "grp=excluded")).collect()} == {"c"}
    assert {r["name"] for r in tables.read_fasta(spark, str(tmp_path / "groups" / "grp=1")).collect()} == {"a", "b"}


def test_padded_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">s1 first\nACDEFG\n>s2\nK\n")
    got = [tuple(r)[1:4] for r in tables.read_fasta(spark, str(tmp_path / "x.fasta"), truncate=4, minlength=2, padding=1).collect()]
    assert got == [("s1", "ACDE", "X A C D E X")]


def test_alignment_and_back(spark):
    rows = spark.createDataFrame([(3, "A--C"), (4, "-KL-")], "seqnum int, row string")
    assert sorted(tuple(r) for r in columns.from_alignment(rows).collect()) == [(3, 0, 0), (3, 1, 3), (4, 0, 1), (4, 1, 2)]


@pytest.mark.parametrize("values,want", [([], []), ([3, 1, 2], [1, 2]), ([5, 1, 6, 2], [1, 2]), ([2, 2, 2], [2]), ([1, 3, 2, 4, 0], [1, 2, 4])])
def test_longest_increasing(values, want):
    assert chains.longest_increasing(np.array(values, int)) == want


def test_increasing_hits_keep_a_value_hit_twice(spark):
    edges = spark.createDataFrame([(0, 0, 1, 5, 0.9), (0, 1, 1, 2, 0.9), (0, 2, 1, 2, 0.8), (0, 3, 1, 7, 0.9), (2, 0, 2, 1, 0.9)], "s1 int, p1 int, s2 int, p2 int, sim double")
    assert sorted((r["p1"], r["p2"]) for r in chains.increasing_hits(edges).collect()) == [(1, 2), (2, 2), (3, 7)]


def test_reference_sequence_stays(spark):
    rng = np.random.default_rng(2)
    data = [("f", s, s * 50 + i, (rng.standard_normal(6) * (s + 1) + s).tolist()) for s in range(3) for i in range(40)]
    df = spark.createDataFrame(data, "fasta string, seqnum int, idx long, emb array<double>")
    got = {r["idx"]: np.array(r["emb"]) for r in reduce.combat(df, reference=1).collect()}
    x = {d[2]: np.array(d[3]) for d in data}
    assert all(np.array_equal(got[i], x[i]) for i in range(50, 90))
    one, two = np.stack([got[i] for i in range(40)]), np.stack([got[i] for i in range(50, 90)])
    assert np.abs(one.mean(0) - two.mean(0)).max() < 0.5 and np.abs(one.std(0) / two.std(0) - 1).max() < 0.3
    unit = np.stack([r["emb"] for r in reduce.unit_dimensions(df).collect()])
    assert np.allclose((unit**2).sum(0), 1)
