"""Orphans below edges that have the same ends under several ids."""

from datetime import timedelta

import pytest

from graphloom.operators.orphans import orphan_cascade
from tests.helpers import T0, edge, node, tables


@pytest.mark.parametrize("dead", ["1", "2", "3"])
def test_any_dead_edge_of_a_pair_hands_down(spark, dead):
    gone = T0 + timedelta(days=10)
    at = {i: gone + timedelta(days=1) if i == dead else T0 + timedelta(days=1) for i in ("1", "2", "3")}
    nodes = [node("p", until=gone), node("c"), node("g")]
    links = [edge(i, "p", "c", "contains", at=t) for i, t in at.items()] + [edge("9", "c", "g", "contains", at=T0 + timedelta(days=1))]
    n, e, x = tables(spark, nodes, links)
    got = {(r["edge_id"], r["side"], r["relation"], r["hops"]) for r in orphan_cascade(e, n, x).collect()}
    assert got == {(dead, "source", "direct", 0), *((i, "target", "inherited", 1) for i in at), ("9", "source", "inherited", 1), ("9", "target", "inherited", 2)}
