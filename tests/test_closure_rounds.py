"""Reachability ends with an empty frontier only."""

from siltstone.operators import graph

EDGES = "project string, src string, dst string, path string, to string"


def test_a_long_chain_with_a_cycle(spark):
    """Node i + 1 imports node i; the last one is imported by the first of a cycle."""
    n = 25
    rows = [("p", f"n{i + 1}", f"n{i}", "x", "y") for i in range(n)] + [("p", "c0", f"n{n}", "x", "y"), ("p", "c1", "c0", "x", "y"), ("p", "c0", "c1", "x", "y"), ("q", "n5", "n0", "x", "y"), ("p", None, "n1", "x", "y")]
    edges = spark.createDataFrame(rows * 2, EDGES)
    changed = spark.createDataFrame([("p", "n0"), ("p", "n0"), ("p", "n3"), ("p", "alone")], "project string, path string")
    got = [tuple(r) for r in graph.affected(edges, changed).collect()]
    assert len(got) == len(set(got))
    assert set(got) - {("p", None)} == {("p", f"n{i}") for i in range(1, n + 1) if i != 3} | {("p", "c0"), ("p", "c1")}
    assert graph.affected(edges.where("false"), changed).collect() == [] == graph.affected(edges, changed.where("false")).collect()
