import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.plans import align, arrays
from test_align import RES, planted

RULES = arrays.Rules(0.7, 0.5, 100, None, True, 0.10)


def rows(df):
    return {(r["seqnum"], r["seqpos"]): (r["clustid"], r["col"]) for r in df.collect()}


def crossing(seed=3, length=14):
    """One file of copies of planted columns with swapped and repeated parts, so that there are cycles, doubles and gaps."""
    rng = np.random.default_rng(seed)
    base, data = rng.standard_normal((length, 12)), []
    for s in range(7):
        shown = [c for c in range(length) if (s * 3 + c) % 6]
        shown = [*shown[5:], *shown[:5]] if s == 2 else [*shown, *shown[2:5]] if s == 4 else shown
        for p, c in enumerate(shown):
            data.append((s, s, p, "X" if (s, p) == (1, 3) else "A", s * 100 + p, "f", (base[c] + 0.5 * rng.standard_normal(12)).tolist(), "x", "y"))
    return data


def test_few_jobs(spark):
    """The number of jobs does not grow with the passes of filling: files that a task can hold are aligned in it."""
    sc = spark.sparkContext
    df = spark.createDataFrame(planted()[0], RES)
    sc.setJobGroup("aligned", "")
    try:
        assert align.align(df).count() == df.count()
        assert len(sc.statusTracker().getJobIdsForGroup("aligned")) < 40
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_arrays_against_joins(spark):
    """The residues of a file get the columns that the joins give them, over cycles, doubles, passes and stranded columns."""
    df = spark.createDataFrame(crossing(), RES).withColumn("file", F.concat(F.lit("/"), "fasta"))
    got = rows(arrays.aligned(df, RULES, True)[0])
    placed = align.by_joins(df, RULES)[0].select("seqnum", "seqpos", "clustid")
    assert got == rows(align._ordered(df, placed, True))


def test_blocks_and_files_that_are_too_large(spark, monkeypatch):
    data = planted()[0] + [(90 + s, 0, p, "A", 9000 + 10 * s + p, None, [1.0] * 64, "x", "y") for s in range(2) for p in range(3)]
    df = spark.createDataFrame(data, RES).withColumn("file", F.coalesce(F.concat(F.lit("/"), "fasta"), F.lit("")))
    whole, left = arrays.aligned(df, RULES, True)
    blocks, none = arrays.aligned(df, RULES, True, block=16)
    assert left is None and none is None and rows(whole) == rows(blocks) and whole.count() == len(data)
    assert whole.filter("file = '' and clustid >= 0").count() == 0  # without a file there are no hits
    monkeypatch.setattr(arrays, "PAIRS", 5)
    found, left = arrays.aligned(df, RULES, True, block=16)
    assert {r["file"] for r in left.collect()} == {"/f0", "/f1"} and found.filter("file <> ''").count() == 0
    in_task = arrays._align_many(df.toArrow(), RULES, True).to_pylist()
    assert {r["file"] for r in in_task if r["clustid"] is None} == {"/f0", "/f1"} and len(in_task) == 8


def test_files_do_not_decide_for_each_other():
    """Each file comes out of a task of many as it does alone."""
    data = [*crossing(), *((s + 50, i, p, a, x + 10_000, "g", v, c, d) for s, i, p, a, x, _, v, c, d in crossing(8))]
    names = ["seqnum", "seqindex", "seqpos", "seqaa", "idx", "file", "emb"]
    table = lambda of: pa.table({n: [r[k] for r in data if r[5] in of] for k, n in enumerate(names)})
    sets = lambda t: {tuple(r.values()) for r in t.to_pylist()}
    alone = [sets(arrays._align_many(table({f}), RULES, True)) for f in "fg"]
    assert sets(arrays._align_many(table({"f", "g"}), RULES, True)) == alone[0] | alone[1]
    with pytest.raises(arrays.TooLarge):
        arrays.similar(np.arange(4), np.arange(4), np.ones((4, 3)), 0.5, most=3)


def test_groups_merged_as_arrays_and_by_joins(spark):
    """The alignments of three groups of a file, and of the one group of another, come out of a task as they do by joins."""
    rng = np.random.default_rng(4)
    base, data, unit = rng.standard_normal((16, 12)), [], []
    for s in range(9):
        unit.append((s, s // 3 if s < 8 else 7))
        for p, c in enumerate(range(s % 3, 16 - s // 3)):
            data.append((s, s, p, "A", s * 100 + p, "f" if s < 8 else "g", (base[c] + 0.4 * rng.standard_normal(12)).tolist(), "x", "y"))
    res = spark.createDataFrame(data, RES).withColumn("file", F.concat(F.lit("/"), "fasta")).cache()
    unit = spark.createDataFrame(unit, "seqnum int, grp long")
    apart = res.join(unit, "seqnum").withColumn("file", F.concat_ws("/", "file", "grp")).drop("grp")
    placed = arrays.numbered(arrays.aligned(apart, RULES, False)[0]).select("seqnum", "seqpos", "clustid", "col").join(unit, "seqnum").cache()
    found, left = arrays.merged(res, placed, 0.5, True)
    with_group = placed.join(res.select("seqnum", "fasta").distinct(), "seqnum")
    joined = align.filling.merge_groups(with_group.drop("col"), placed.select("clustid", "col").distinct(), res, 0.5)[0].select("seqnum", "seqpos", "clustid")
    assert left is None and rows(arrays.numbered(found)) == rows(align._ordered(res, joined, True))
    assert joined.count() > 40 and joined.select("clustid").distinct().count() < placed.select("clustid").distinct().count()
    found, left = arrays.merged(res, placed, 0.5, True, most=20)
    assert {r["file"] for r in left.collect()} == {"/f"} and found.select("file").distinct().count() == 1
