"""Traversal against plain Python, and scenarios on hand-made graphs."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.api import GraphIndex
from graphloom.functions import dims
from graphloom.operators import coverage, graph, impact, incremental, search, traversal, validation
from tests.helpers import edge, node, tables


def make(spark, nodes, edges):
    n, e, x = tables(spark, nodes, edges)
    return graph.current_nodes(n, x), graph.current_edges(e)


def chain(spark):
    return make(spark, [node(f"f.py::{c}") for c in "abcd"], [edge(str(i), f"f.py::{a}", f"f.py::{b}", resolution=None) for i, (a, b) in enumerate(zip("abc", "bcd"))])


def test_callers_of_a_chain(spark):
    n, e = chain(spark)
    g = GraphIndex(n, e)
    assert [(r["id"][-1], r["distance"]) for r in g.callers("f.py::d", 3).collect()] == [("c", 1), ("b", 2), ("a", 3)]
    assert g.callers("f.py::d", 0).count() == 0
    assert [r["id"][-1] for r in g.callees("f.py::a", 2).collect()] == ["b", "c"]


def brute(edges, start, depth):
    near, frontier = {start: 0}, {start}
    for d in range(1, depth + 1):
        frontier = {a for a, b in edges if b in frontier} - near.keys()
        near |= {x: d for x in frontier}
    return {x: d for x, d in near.items() if d}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_reach_is_breadth_first(spark, seed):
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(40)}
    links = spark.createDataFrame([(b, a, 0.5) for a, b in pairs], "at string, to string, confidence double")
    starts = spark.createDataFrame([("n0",), ("n1",), ("missing",)], "root_id string")
    got = {(r["root_id"], r["id"]): r["distance"] for r in traversal.reach(starts, links, 3).collect()}
    assert got == {(s, x): d for s in ("n0", "n1") for x, d in brute(pairs, s, 3).items()}


def test_unresolved_edges_stop_traversal(spark):
    n, e = make(spark, [node("a"), node("b"), node("c")], [edge("1", "a", "b", resolution="dynamic_dispatch"), edge("2", "b", "c", resolution="name_match_candidate")])
    got = traversal.reach(spark.createDataFrame([("c",)], "root_id string"), traversal.steps(e, "incoming"), 3)
    assert [r["id"] for r in got.collect()] == ["b"]


def test_edges_first_wins_and_clean(spark):
    _, e = make(spark, [], [edge("2", "a", "b"), edge("1", " a", "b", "Call", 0.3), edge("3", None, "b"), edge("4", "a", " "), edge("5", "a", "c", confidence=None, resolution="unresolved"), edge("6", "a", "d", confidence=7.0)])
    got = {r["target"]: (r["edge_id"], r["confidence"]) for r in e.collect()}
    assert got == {"b": ("1", 0.3), "c": ("5", 0.2), "d": ("6", 1.0)}


def test_coverage_buckets(spark):
    n, e = make(
        spark,
        [node("a"), node("b"), node("c"), node("d"), node("tests/test_x.py::t")],
        [edge("1", "a", "t1", "tested_by", 0.8), edge("2", "b", "t1", "tested_by", 0.5), edge("3", "c", "t1", "tested_by", 0.0)],
    )
    got = {r["id"]: r["bucket"] for r in coverage.coverage_buckets(n, e).collect()}
    assert got == {"a": "high", "b": "low", "c": "unknown", "d": "none"}
    assert coverage.coverage_buckets(*make(spark, [], [])).count() == 0


def test_validation_order(spark):
    n, e, x = tables(spark, [node("a", "func"), node("b\\c", "widget")], [edge("1", "a", "nope", "odd"), edge("2", "a", "b/c", "odd"), edge("3", "a", "b\\c", "implements", 2.0, None), edge("4", None, None)])
    got = sorted((r["id"], r["reason"]) for r in validation.edge_issues(e, n, x).collect())
    assert got == [("1", "missing_target"), ("2", "invalid_type"), ("3", "backslash_path"), ("3", "confidence_clamped"), ("3", "resolution_missing"), ("3", "type_alias"), ("4", "missing_both")]
    assert {(r["id"], r["reason"]) for r in validation.node_issues(n).collect()} >= {("a", "type_alias"), ("b/c", "type_unknown")}


def test_class_without_calls_stands_for_its_methods(spark):
    n, e = make(spark, [node("f::C", "class"), node("f::C.m", "method"), node("g")], [edge("1", "g", "f::C.m")])
    found = impact.impact(spark.createDataFrame([("f::C",)], "root_id string"), n, e)
    assert [(r["id"], r["relation"], r["distance"]) for r in found.collect()] == [("g", "caller", 2)]


def test_risk_rules(spark):
    n, e = make(spark, [node("auth/save.py::f"), node("x"), node("y"), node("z"), node("p")], [edge(c, c, "auth/save.py::f") for c in "xyz"] + [edge("9", "p", "x")])
    g = GraphIndex(n, e)
    assert g.risk("auth/save.py::f", depth=1).first()["risk"] == "critical"
    assert g.risk("x", depth=1).first()["risk"] == "medium"
    assert g.pre_edit_check("auth/save.py").first()["risk"] == "critical"


def test_search_orders_and_misspellings(spark):
    n, e = make(spark, [node("src/a.py::login"), node("tests/test_a.py::login"), node("src/b.py::login_user"), node("src/c.py::logout")], [])
    g = GraphIndex(n, e)
    got = [r["id"] for r in g.search("login").orderBy("rank").collect()]
    assert got[0] == "src/a.py::login" and "src/b.py::login_user" in got
    assert g.search("lgoin").where("rank = 1").first()["id"].endswith("login")
    assert g.search("lgoin", fuzzy=False).count() == 0
    assert g.context("fix login of a user")["items"][0]["id"] in ("src/a.py::login", "src/b.py::login_user")


def test_names(spark):
    df = spark.createDataFrame([("parseHTTPHeader_v2", "The cache of a store")], "name string, text string")
    r = df.select(search.decompose(F.col("name")).alias("d"), search.tokenize(F.col("text")).alias("t"), search.token_estimate(F.col("text")).alias("e"), search.token_estimate(F.lit("")).alias("z")).first()
    assert (r["d"], r["t"], r["e"], r["z"]) == (["parse", "http", "header", "v"], ["cache", "store"], 5, 0)


def test_change_classes(spark):
    cols = "repo_id string, snapshot_no int, file_path string, sha256 string, structural_hash string, symbols_hash string, imports_hash string, calls_hash string"
    old = spark.createDataFrame([("r", 1, p, "1", "a", "a", "a", "a") for p in ("same", "cosmetic", "structural", "gone")], cols)
    new = spark.createDataFrame([("r", 2, "same", "1", "a", "a", "a", "a"), ("r", 2, "cosmetic", "2", "a", "a", "a", "a"), ("r", 2, "structural", "2", "a", "a", "a", None), ("r", 2, "new", "2", "a", "a", "a", "a")], cols)
    got = {r["file_path"]: r["change"] for r in incremental.classify(new, old).collect()}
    assert got == {"same": "NONE", "cosmetic": "COSMETIC", "structural": "STRUCTURAL", "gone": "DELETED", "new": "ADDED"}
    assert incremental.plan(incremental.classify(new, old)).first()["mode"] == "full"


def test_dimension_of_resolutions():
    r = {n: (t, c, b) for n, t, c, b in dims.resolution_rows()}
    assert len(r) == 128 and r["exact_ast_match"] == ("confirmed", 1.0, False) and r["direct_test_call"] == ("unresolved", 0.9, False) and r["dynamic_getattr"][2]
