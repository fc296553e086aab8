"""Pairs on and below cycles of parent-child links."""

from graphloom.operators.hierarchy import descendant_counts, descendants, hierarchy


def test_descendants_on_and_below_a_cycle(spark):
    links = [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("s", "s"), ("s", "t"), ("r", "c")]
    paths = hierarchy(spark.createDataFrame(links, "parent string, child string"), with_paths=True, with_cycles=True)
    got = {tuple(r) for r in descendants(paths).collect()}
    assert got == {("a", "b", 1), ("b", "a", 1), ("b", "x", 1), ("a", "x", 2), ("x", "y", 1), ("b", "y", 2), ("a", "y", 3), ("s", "t", 1), ("r", "c", 1)}
    assert {r["node_id"]: r["n_descendants"] for r in descendant_counts(paths).collect()} == {"a": 3, "b": 3, "x": 1, "y": 0, "s": 1, "t": 0, "r": 1, "c": 0}
