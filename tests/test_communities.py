import itertools

import pytest

from strandflow.operators import communities

EDGES = "src long, dst long, w double"


def cliques(*groups):
    return [(a, b, 1.0) for g in groups for a, b in itertools.combinations(g, 2)]


@pytest.mark.parametrize("limit", [100, 1])
def test_communities(spark, limit):
    edges = cliques(range(5), range(10, 15), range(40, 43)) + [(4, 10, 1.0), (0, 1, 0.0), (7, 7, 1.0), (None, 3, 1.0), (50, 51, 0.5), (51, 50, 0.5)]
    got = {r["vertex"]: r["community"] for r in communities.communities(spark.createDataFrame(edges, EDGES), limit=limit).collect()}
    assert got == {v: g[0] for g in (range(5), range(10, 15), range(40, 43), range(50, 52)) for v in g}


def test_communities_of_nothing(spark):
    assert communities.communities(spark.createDataFrame([], EDGES)).count() == 0


def test_sequence_groups_put_outliers_aside(spark):
    edges = [(a, b, 0.9) for a, b in itertools.combinations(range(28), 2)] + [(28, i, 0.1) for i in range(6)]
    got = {r["vertex"]: r["community"] for r in communities.sequence_groups(spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {**dict.fromkeys(range(28), 0), 28: None}


def test_large_clique_of_equal_vertices(spark):
    edges = cliques(range(120), range(200, 203)) + [(119, 200, 0.5)]
    got = {r["vertex"]: r["community"] for r in communities.communities(spark.createDataFrame(edges, EDGES), limit=1).collect()}
    assert got == {**dict.fromkeys(range(120), 0), **dict.fromkeys(range(200, 203), 200)}
