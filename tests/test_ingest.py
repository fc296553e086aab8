"""From source text to the graph, incremental steps and streams."""

import json

from pyspark.sql import functions as F

from graphloom.ingest.build import build_graph
from graphloom.ingest.extract import extract, fingerprint, routes
from graphloom.sources.tables import read_graph, read_graph_json, scan_tree, write_graph
from graphloom.streaming.watch import FILE_SCHEMA, edge_counts, follow_files, removed_since
from tests.helpers import EDGE, T0, edge

APP = '''
from lib.store import Store, save as keep
import os

class Service(Base):
    """Serves."""
    def run(self):
        self.check()
        keep(1)
        return os.path.join("a")

    def check(self):
        return helper()

def helper():
    return Store()

def test_helper():
    helper()
'''
STORE = "class Store:\n    pass\n\ndef save(x):\n    return x\n"


def files(spark, data):
    return spark.createDataFrame([(p, "r", 1, T0, len(c or b""), c, T0) for p, c in data.items()], FILE_SCHEMA)


def test_python_extraction():
    symbols, links = extract("app/main.py", APP.encode())
    assert [(s.type, s.name) for s in symbols] == [("file", "main.py"), ("class", "Service"), ("method", "run"), ("method", "check"), ("function", "helper"), ("test", "test_helper")]
    assert symbols[1].docstring == "Serves."
    calls = {(x.source.split("::")[-1], x.name, x.qualifier, x.module) for x in links if x.kind == "call"}
    assert {("Service.run", "check", "self", None), ("Service.run", "save", None, "lib.store"), ("helper", "Store", None, "lib.store"), ("Service.run", "join", "os.path", "os.path")} <= calls


def test_other_languages():
    java = b"package a;\nimport b.Helper;\nclass X extends Y implements Z {\n  /** Doc. */\n  int go(int a) { Helper.run(a); return this.stop(); }\n  int stop() { return 1; }\n}\n"
    s, x = extract("a/X.java", java)
    assert {(k.type, k.id) for k in s} == {("file", "a/X.java"), ("class", "a/X.java::X"), ("method", "a/X.java::X.go"), ("method", "a/X.java::X.stop")}
    assert {("call", "run", "Helper", "b.Helper"), ("call", "stop", "this", None), ("inherits", "Y", None, None), ("inherits", "Z", None, None)} <= {(k.kind, k.name, k.qualifier, k.module) for k in x}
    go = b'package p\n\nimport (\n\t"x/tools"\n)\n\ntype T struct {}\n\n// Run runs.\nfunc (t *T) Run(a int) int {\n\treturn tools.Do(a)\n}\n\nfunc TestRun(t int) {}\n'
    s, x = extract("p/t.go", go)
    assert ("method", "p/t.go::T.Run") in {(k.type, k.id) for k in s} and ("test", "p/t.go::TestRun") in {(k.type, k.id) for k in s}
    assert ("p/t.go::T.Run", "Do", "tools", "x/tools") in {(k.source, k.name, k.qualifier, k.module) for k in x}
    s, x = extract("w/a.ts", b"import { A } from '../lib/b';\nexport const f = (x: A): number => g(x);\nclass C { m(): void { f(1); } }\n")
    assert {"w/a.ts::f", "w/a.ts::C", "w/a.ts::C.m"} <= {k.id for k in s} and ("import", "A", "lib/b") in {(k.kind, k.name, k.module) for k in x}


def test_routes():
    got = lambda p, t, lang: [r[:3] for r in routes(p, t, lang)]
    assert got("a.py", '@app.get("/u/{i}")\nasync def one(i):\n    pass\n@bp.route("/x", methods=["POST"])\ndef two():\n    pass\n', "python") == [("GET", "/u/{i}", "one"), ("POST", "/x", "two")]
    assert got("a.js", "app.use('/api', r);\nr.get('/u', auth, show);\n", "javascript") == [("GET", "/api/u", "show")]
    assert got("a.ts", "@Controller('cats')\nclass C {\n  @Get(':id')\n  find() {}\n}\n", "typescript") == [("GET", "/cats/:id", "find")]
    assert got("pages/api/u/[id].ts", "export default h;", "typescript") == [("ALL", "/api/u/:id", None)]
    assert got("A.java", '@RestController\n@RequestMapping("/a")\nclass A {\n  @GetMapping("/b")\n  public String b() { return ""; }\n}\n', "java") == [("GET", "/a/b", "b")]
    assert got("m.go", 'v1 := r.Group("/v1")\nv1.POST("/u", auth, h.Create)\n', "go") == [("POST", "/v1/u", "h.Create")]
    assert got("C.cs", '[Route("api/[controller]")]\nclass UserController {\n  [HttpGet("{id}")]\n  public int Get(int id) { return 1; }\n}\napp.MapPost("/x", Make);\n', "csharp") == [("GET", "/api/user/{id}", "Get"), ("POST", "/x", "Make")]


def test_fingerprints_tell_cosmetic_from_structural():
    base = fingerprint("a.py", b"def f(x):\n    return g(x)\n")
    cosmetic = fingerprint("a.py", b"# note\ndef f(x):\n    '''Doc.'''\n    return   g(x)\n")
    assert base[0] != cosmetic[0] and base[1:] == cosmetic[1:]
    assert fingerprint("a.py", b"def f(x):\n    return h(x)\n")[1] != base[1]
    broken = fingerprint("a.py", b"def f(:\n")
    assert len(set(broken)) == 1
    assert len(set(fingerprint("a.py", None))) == 1


def test_build_resolves_by_joins(spark):
    n, e = build_graph(files(spark, {"app/main.py": APP.encode(), "lib/store.py": STORE.encode(), "empty.py": b"", "none.py": None, "node_modules/x.js": b"function f() {}"}))
    got = {(r["source"].split("/")[-1], r["target"].split("/")[-1], r["type"]): r["resolution"] for r in e.collect()}
    assert got[("main.py::Service.run", "main.py::Service.check", "calls")] == "self_method_resolved"
    assert got[("main.py::Service.run", "store.py::save", "calls")] == "imported_function_exact"
    assert got[("main.py::helper", "store.py::Store", "calls")] == "constructor_call_resolved"
    assert got[("main.py::Service.check", "main.py::helper", "calls")] == "same_file_exact"
    assert got[("main.py::Service.run", "external:os.path.join", "calls")] == "external_package"
    assert got[("main.py", "store.py", "imports")] == "import_resolved"
    assert got[("main.py::helper", "main.py::test_helper", "tested_by")] == "direct_test_call"
    assert got[("main.py::Service", "main.py::Service.run", "contains")] == "exact_ast_match"
    assert {r["id"] for r in n.where("type = 'file'").collect()} == {"app/main.py", "lib/store.py", "empty.py", "none.py"}


def test_stream_ends_where_a_full_build_does(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "graph")
    later = STORE + "\ndef extra():\n    return save(2)\n"
    files(spark, {"app/main.py": APP.encode(), "lib/store.py": STORE.encode(), "old.py": b"def old():\n    pass\n"}).coalesce(1).write.parquet(source)
    follow_files(spark, source, out, str(tmp_path / "cp")).awaitTermination(120)
    assert read_graph(spark, out)[0].where("id = 'old.py::old'").count() == 1
    files(spark, {"lib/store.py": later.encode(), "old.py": None}).coalesce(1).write.mode("append").parquet(source)
    follow_files(spark, source, out, str(tmp_path / "cp")).awaitTermination(120)
    n, _ = build_graph(files(spark, {"app/main.py": APP.encode(), "lib/store.py": later.encode()}))
    assert {r["id"] for r in read_graph(spark, out)[0].select("id").collect()} == {r["id"] for r in n.select("id").collect()}


def test_scan_and_json(spark, tmp_path):
    for p, t in (("repo/a/x.py", "def f():\n    pass\n"), ("repo/build/y.py", "1"), ("repo/readme.md", "#")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "secret.py").write_text("1")
    (tmp_path / "repo/a/link.py").symlink_to(tmp_path / "secret.py")
    found = scan_tree(spark, str(tmp_path / "repo"))
    assert [r["file_path"] for r in found.collect()] == ["a/x.py"]
    assert scan_tree(spark, str(tmp_path / "repo"), ("go",)).count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "type": "function"}], "edges": [{"source": "a", "target": "b", "type": "calls", "confidence": 0.5}]}))
    n, e = read_graph_json(spark, str(tmp_path / "g.json"))
    assert (n.first()["id"], e.first()["confidence"]) == ("a", 0.5)
    write_graph(n, e, str(tmp_path / "out"))
    assert read_graph(spark, str(tmp_path / "out"))[1].select(F.col("target")).first()[0] == "b"


def test_edge_stream_counts_redelivered_edges_once(spark, tmp_path):
    rows = [edge("1", "a", "b"), edge("1", "a", "b"), edge("2", "a", "b", "Call"), edge("3", "a", None)]
    spark.createDataFrame(rows, EDGE).write.parquet(str(tmp_path / "edges"))
    q = edge_counts(spark, str(tmp_path / "edges")).writeStream.outputMode("complete").format("memory").queryName("edge_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["type"], r["n"]) for r in spark.table("edge_counts").collect()] == [("calls", 2)]


def test_removed_files(spark):
    old, new = (spark.createDataFrame([(p,) for p in x], "file_path string") for x in (["a", "b", "a"], ["b"]))
    assert [r["file_path"] for r in removed_since(old, new).collect()] == ["a"]
