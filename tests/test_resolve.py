"""Ladders per language over small trees, and incremental steps against full builds."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.ingest.build import build_graph, facts, graph_of, patch_graph
from graphloom.ingest.resolve import drops, merge_resolved
from graphloom.plans.ingest import n_differing
from graphloom.runtime import cut, table, task_count
from graphloom.sources.tables import apply_files, pointer, read_graph, write_version
from tests.helpers import T0

FILES = "file_path string, repo_id string, batch_no int, content binary, loaded_at timestamp_ntz, id string"


def files(spark, tree, at=0):
    return spark.createDataFrame([(p, "r", 1, None if t is None else t.encode(), T0 + timedelta(days=at), "clash") for p, t in tree.items()], FILES)


TREES = {
    "python": (
        {
            "app/util/store.py": "class Store:\n    def save(self):\n        pass\n\ndef helper():\n    return Store()\n",
            "app/main.py": "from app.util.store import Store, helper as h\nfrom app.util import store\nimport os\n\nGLOBAL = Store()\n\nclass Service:\n    def __init__(self, s: Store):\n        self.s = s\n        self.t = Store()\n    def run(self, p: Store):\n        self.s.save()\n        p.save()\n        x = Store()\n        x.save()\n        GLOBAL.save()\n        Store().save()\n        h()\n        store.helper()\n        self.run(p)\n        os.getcwd()\n        nowhere()\n\nclass Child(Service):\n    pass\n\nclass Far(Store):\n    pass\n",
        },
        {
            ("Service.run", "Store.save"): "parameter_type_hint_resolved", ("Service.run", "helper"): "imported_function_exact", ("Service.run", "Service.run"): "self_method_resolved", ("Service.run", "external:os.getcwd"): "external_package",
            ("Service.run", "external:nowhere"): "unknown_external", ("Child", "Service"): "same_file_exact", ("Far", "Store"): "imported_class_exact", ("helper", "Store"): "same_file_exact",
        },
    ),
    "typescript": (
        {
            "src/lib/index.ts": "export function load() {}\nexport default class Box {}\n", "src/lib/api.ts": "export function get() {}\n",
            "src/app.ts": "import { load, gone } from './lib';\nimport * as api from './lib/api';\nimport x from 'left-pad';\nfunction own() {}\nclass A {\n  m() { this.n(); this.zz(); load(); api.get(); own(); x(); gone(); far(); }\n  n() {}\n}\n", "src/other.ts": "export function far() {}\n",
        },
        {("A.m", "A.n"): "this_method_exact", ("A.m", "unresolved:this.zz"): "object_method_unknown", ("A.m", "load"): "imported_symbol_exact", ("A.m", "get"): "namespace_import_exact", ("A.m", "own"): "same_file_exact", ("A.m", "external:left-pad.x"): "package_external", ("A.m", "far"): "name_match_candidate"},
    ),
    "java": (
        {
            "src/com/a/Util.java": "package com.a;\npublic class Util {\n  public static int make() { return 1; }\n}\n", "src/com/b/Near.java": "package com.b;\npublic class Near {\n}\n", "src/com/c/Other.java": "package com.c;\npublic class Other {\n  public void run() { }\n}\n",
            "src/com/b/Main.java": "package com.b;\nimport com.a.Util;\nimport java.util.List;\npublic class Main extends Near {\n  void go() { this.own(); own(); super.x(); Util.make(); obj.run(); List.of(); run(); }\n  void own() { }\n}\n",
        },
        {
            ("Main.go", "Main.own"): "same_file_exact", ("Main.go", "Util.make"): "static_method_exact", ("Main.go", "unresolved:super.x"): "interface_method_candidate", ("Main.go", "unresolved:obj.run"): "unknown_type_method",
            ("Main.go", "external:java.util.List.of"): "external_package", ("Main.go", "Other.run"): "name_match_candidate", ("Main", "Near"): "package_local_exact",
        },
    ),
    "go": (
        {
            "store/store.go": "package store\n\nfunc Open() {}\n\ntype DB struct {\n}\n\nfunc (d *DB) Close() { d.flush() }\n\nfunc (d *DB) flush() {}\n", "main/two.go": "package main\n\nfunc near() {}\n",
            "main/main.go": "package main\n\nimport (\n\t\"fmt\"\n\t\"example.com/app/store\"\n)\n\nfunc local() {}\n\nfunc run() {\n\tlocal()\n\tnear()\n\tstore.Open()\n\tfmt.Println()\n\tx.Close()\n\tx.Missing()\n}\n",
        },
        {
            ("run", "local"): "same_file_exact", ("run", "near"): "package_local_exact", ("run", "Open"): "package_function_exact", ("run", "external:fmt.Println"): "external_module", ("run", "DB.Close"): "unknown_receiver_method", ("run", "unresolved:x.Missing"): "embedded_method_candidate",
            ("DB.Close", "DB.flush"): "receiver_method_exact",
        },
    ),
    "csharp": (
        {
            "Lib/Util.cs": "namespace App.Lib;\npublic class Util {\n  public static int Make() { return 1; }\n}\n", "Core/Base.cs": "namespace App.Core;\npublic class Base {\n  public void Help() { }\n}\n",
            "Core/Main.cs": "using System;\nusing App.Lib;\nnamespace App.Core;\npublic class Main : Base {\n  public void Go() { this.Own(); Util.Make(); Base.Help(); text.Trim(); Nowhere(); }\n  public void Own() { }\n}\n",
        },
        {("Main.Go", "Main.Own"): "this_method_exact", ("Main.Go", "Util.Make"): "using_namespace_exact", ("Main.Go", "Base.Help"): "namespace_local_exact", ("Main.Go", "unresolved:text.Trim"): "extension_method_candidate", ("Main.Go", "external:Nowhere"): "unknown_symbol", ("Main", "Base"): "namespace_local_exact"},
    ),
}


@pytest.fixture(scope="module")
def built(spark):
    """All trees in one build, a repository for each language."""
    rows = [(f"{lang}/{p}", lang, 1, t.encode(), T0, "clash") for lang, (tree, _) in TREES.items() for p, t in tree.items()]
    n, e = build_graph(spark.createDataFrame(rows, FILES))
    return {r["id"] for r in n.collect()}, e.collect()


@pytest.mark.parametrize("lang", TREES)
def test_ladder(built, lang):
    want = TREES[lang][1]
    short = lambda i: i.split("::")[-1]
    got = {(short(r["source"]), short(r["target"])): r["resolution"] for r in built[1] if r["type"] in ("calls", "inherits") and r["source"].startswith(lang + "/")}
    assert {k: got.get(k) for k in want} == want


def test_targets_are_nodes_or_say_what_they_are(built):
    assert all(r["target"] in built[0] or r["target"].split(":")[0] in ("external", "unresolved", "package") for r in built[1])


def edge_set(df):
    return {(r["source"], r["target"], r["type"], r["confidence"], r["resolution"]) for r in df.collect()}


STEPS = [
    ({"b.py": "from a import helper_one\nimport a\n\ndef go():\n    helper_one()\n    a.late()\n"}, []),  # calls into an unchanged file
    ({"a.py": "def helper_one():\n    pass\n\ndef late():\n    pass\n"}, []),  # what an unchanged file calls appears
    ({"z.py": "def helper_one():\n    pass\n"}, ["a.py"]),  # moved: what an unchanged file imports goes
]


def test_steps_end_where_a_full_build_does(spark):
    tree = {"a.py": "def helper_one():\n    pass\n", "b.py": "def go():\n    pass\n", "c.ts": "import { d } from './d';\nd();\n", "test_a.py": "from a import helper_one\n\ndef test_helper_one():\n    helper_one()\n"}
    stored = facts(files(spark, tree))
    n, e = graph_of(stored)
    for i, (changed, removed) in enumerate(STEPS, 1):
        gone = spark.createDataFrame([(p,) for p in removed], "file_path string")
        n, e, stored = patch_graph(n, e, stored, files(spark, changed, i), gone)
        n, e = cut(n), cut(e)
        tree = {p: t for p, t in (tree | changed).items() if p not in removed}
    fn, fe = build_graph(files(spark, tree))
    assert edge_set(e) == edge_set(fe)
    assert {tuple(r) for r in n.drop("tags").collect()} == {tuple(r) for r in fn.drop("tags").collect()}
    assert ("b.py::go", "external:a.helper_one", "calls", 0.5, "external_package") in edge_set(e)


def test_a_step_leaves_no_edge_of_a_class_that_is_no_node(spark):
    tree = {"a.py": "class Box:\n    def put(self):\n        pass\n<<<<<<< here\n", "b.py": "def go():\n    pass\n"}
    stored = facts(files(spark, tree))
    n, e, _ = patch_graph(*graph_of(stored), stored, files(spark, {"b.py": "def went():\n    pass\n"}, 1), spark.createDataFrame([], "file_path string"))
    assert [r["source"] for r in e.collect() if r["target"] == "a.py::Box.put"] == ["a.py::Box"]
    assert not n.where("id = 'a.py::Box'").count()


def test_differing_rows_count_as_often_as_they_differ(spark):
    a = spark.createDataFrame([("x", ["t"]), ("x", ["t"]), ("y", None), (None, None)], "k string, tags array<string>")
    b = spark.createDataFrame([("x", ["t"]), ("y", ["t"]), (None, None)], "k string, tags array<string>")
    assert [n_differing(p, q).first()[0] for p, q in ((a, b), (b, a), (a, a), (a, a.limit(0)), (a.limit(0), a.limit(0)))] == [3, 3, 0, 4, 0]


def test_a_join_is_dealt_out_by_what_it_reads(spark, sf):
    t = table(spark, sf, "source_files")
    last = t.groupBy("repo_id").agg(F.max("batch_no").alias("last"))
    assert task_count(spark, t.join(last, "repo_id"), bytes_per_task=1 << 10) <= 2 * max(task_count(spark, t, bytes_per_task=1 << 10), task_count(spark))


def test_stored_steps_on_any_storage(spark, tmp_path):
    at = f"file:{tmp_path}/graph"
    none = spark.createDataFrame([], "file_path string")
    assert apply_files(spark, at, files(spark, {"a.py": "def helper_one():\n    pass\n"}), none, 0)
    assert apply_files(spark, at, files(spark, STEPS[0][0]), none, 1)
    assert not apply_files(spark, at, files(spark, STEPS[0][0]), none, 1)  # delivered again
    assert pointer(spark, at) == {"version": 2, "batch": 1}
    assert ("b.py::go", "a.py::helper_one", "calls", 0.9, "imported_function_exact") in edge_set(read_graph(spark, at)[1])
    for i in range(2, 6):
        write_version(spark, at, i, nodes=none, edges=none)
    assert sorted(p.name for p in (tmp_path / "graph").iterdir() if p.is_dir()) == ["v00000005", "v00000006"]


def test_merge_keeps_raw_edges_and_logs_the_rest(spark):
    raw = spark.createDataFrame([("a", "b", "calls", 0.3, "unresolved"), ("a", "c", "calls", 0.3, None)], "source string, target string, type string, confidence double, resolution string")
    done = spark.createDataFrame([("a", "b", "calls", 0.9, "import_resolved", "confirmed"), ("a", "d", "calls", 0.95, "same_file_exact", "confirmed"), ("a", "c", "calls", 0.35, "name_match_candidate", "possible"), ("a", "e", "calls", 0.2, "unresolved", "unresolved")], "source string, target string, type string, confidence double, resolution string, tier string")
    assert edge_set(merge_resolved(raw, done)) == {("a", "b", "calls", 0.9, "import_resolved"), ("a", "c", "calls", 0.3, None), ("a", "d", "calls", 0.95, "same_file_exact")}
    assert {(r["reason"], r["target"]) for r in drops(done).collect()} == {("framework_unresolved", "c"), ("external_unresolved", "e")}
