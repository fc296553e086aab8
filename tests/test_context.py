"""Search beyond SQL, contexts within a budget, explanation and repair on small tables."""

import pytest
from pyspark.sql import functions as F

from graphloom.api import GraphIndex
from graphloom.operators import context, explain, graph, impact, integrity, search
from tests.helpers import edge, node, tables


@pytest.fixture(scope="module")
def index(spark):
    n = [
        node("src/app.py::save_token", docstring="Saves a token. And more.", location=(1, 9)), node("src/app.py::Store", "class", tags=["model"], location=(10, 20)), node("src/auth/login.py::login", location=(1, 5)), node("tests/test_app.py::test_save", "test"), node("src/app.py", "file"),
        node("src/other.py::login", location=(3, 4)),
    ]
    e = [edge("1", "src/auth/login.py::login", "src/app.py::save_token"), edge("2", "tests/test_app.py::test_save", "src/app.py::save_token"), edge("3", "src/app.py::save_token", "src/app.py::Store"), edge("4", "src/app.py::save_token", "external:os.write", resolution="external_package")]
    raw_n, raw_e, ext = tables(spark, n, e)
    return GraphIndex(graph.current_nodes(raw_n, ext).cache(), graph.current_edges(raw_e).cache())


def test_any_text_is_a_query(index):
    for q in ("foo(bar", "[x", "zz.*", "save_token", ""):
        found = search.multi_pass(index.nodes, [q], fuzzy=False).collect()
        assert (len(found) > 0) == (q == "save_token"), q
    assert search.phrases("foo(bar a_b") == [" foo bar ", " a b "]


def test_same_name_in_two_files_is_ambiguous(index):
    rows = search.multi_pass(index.nodes, ["login"], limit=1).collect()
    assert rows[0]["ambiguous"] and rows[0]["truncated"] and rows[0]["total"] == 2
    assert search.multi_pass(index.nodes, ["logn"]).first()["id"].endswith("::login")
    assert {r["kind"] for r in index.instead("src/app.py::save_tok").collect()} >= {"partial", "sibling"}


def test_pack_spends_its_budget(index):
    p = index.context("fix save_token in the store", budget=500)
    assert {i["id"] for i in p["items"] if i["relation"] == "entry_point"} >= {"src/app.py::save_token", "src/app.py::Store"}
    assert p["tests"] == ["tests/test_app.py::test_save"]
    assert "src/app.py::save_token" in context.markdown(p) and p["profile"]["intent"] == "fix_bug"
    first = index.scan("save_token")
    assert first["entries"][0]["id"] == "src/app.py::save_token"
    near = index.deepen(first["token"])
    assert {r["relation"] for r in near["near"]} >= {"test"}
    with pytest.raises(ValueError):
        context.state_of("x")


def test_shorter_forms_when_the_budget_ends():
    row = {"id": "a", "name": "a", "file_path": "f", "line_start": 1, "signature": "def a()", "docstring": "Does.", "code_preview": "x" * 4000, "relation": "caller", "confidence": 0.9, "tier": 4, "score": 0.5}
    b = context.Budget(100)
    got = context.select([row, row | {"id": "b", "relation": "caller", "confidence": 0.3, "tier": 5}], b, {"caller": "medium"})
    assert [g["mode"] for g in got] == ["summary", "reference"]


def test_profile():
    p = context.profile("Rename LoginService and add tests; without breaking the API")
    assert p["symbols"] == ["LoginService"] and p["intent"] == "refactor" and {"modify", "test"} <= set(p["operations"]) and "keep_api" in p["constraints"]
    assert context.strategy(p)["test"] == "high" and context.named_symbols("use JavaScript and MAX_SIZE in load_all") == ["load_all", "MAX_SIZE"]


def test_explanation(index, spark):
    row = index.explain("src/app.py::save_token").first()
    assert row["summary"] == "Saves a token." and row["n_callers"] == 2 and row["n_callees"] == 2
    assert {r["other"] for r in index.external_calls("src/app.py::save_token").collect()} == {"external:os.write"}
    assert explain.summaries(index.nodes).where("id like '%::login'").first()["origin"] == "type"
    codes = spark.createDataFrame([("No related tests detected.",), ("Security-sensitive path",), ("?",)], "r string").select(explain.reason_code(F.col("r"))).collect()
    assert [c[0] for c in codes] == ["missing_tests", "sensitive_path", "unknown"]


def test_risk_by_path_and_route(spark):
    n, e, x = tables(spark, [node("src/auth/save.py::f"), node("src/x.py::delete_all"), node("src/y.py::g", tags=["route"])], [edge(str(i), f"src/x.py::c{i}", "src/auth/save.py::f") for i in range(3)])
    n, e = graph.current_nodes(n, x), graph.current_edges(e)
    starts = spark.createDataFrame([(i,) for i in ("src/auth/save.py::f", "src/x.py::delete_all", "src/y.py::g", "gone")], "root_id string")
    got = {r["root_id"].split("::")[-1]: r["risk"] for r in impact.risk(starts, n, e, impact.impact(starts, n, e)).collect()}
    assert got == {"f": "high", "delete_all": "low", "g": "high", "gone": "unknown"}


def test_repair(spark):
    n, e, x = tables(spark, [node(" a\\b ", "func"), node("c")], [edge("1", "a/b", "c", "Call", 7.0), edge("2", "a/b", "gone"), edge("3", "a/b", "external:x"), edge("4", "a/b", "c", "odd")])
    rn, re_ = integrity.repair(n, e, x)
    assert {r["id"] for r in rn.collect()} == {"a/b", "c"} and {(r["id"], r["confidence"]) for r in re_.collect()} == {("1", 1.0), ("3", 0.9)}
    with pytest.raises(ValueError):
        integrity.repair(n.limit(0), e, x)
    assert [integrity.schema_status(v) for v in (None, 1, 2, 3)] == ["missing", "older", "current", "newer"]
