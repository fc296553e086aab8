"""Documentation pairs and marks of files that nobody writes by hand."""

import pytest

from graphloom.llm.handwritten import not_by_hand
from graphloom.llm.origin import marks
from graphloom.llm.pairs import documented
from graphloom.llm.statements import says_something
from tests.helpers import NODE, T0, node

FILES = "file_path string, repo_id string, content binary, loaded_at timestamp_ntz, node_id string, reason string, h1 bigint"


def files(spark, data):
    return spark.createDataFrame([(p, p.split("/")[0] if p else None, t.encode() if isinstance(t, str) else t, T0, "clash", "clash", 1) for p, t in data.items()], FILES)


EMPTY = ["", "   ", "TODO: describe parse record", "Parse the record.", "parse_record()", "Parses a late record", "Inherited.", "{@inheritDoc}", "<inheritdoc/>", "See above.", "See the docs of Reader.", "N/A", "...", "This is parse record.", "@param a\n@return", ":param a:\n:return:", '<param name="a"></param>', "Auto-generated stub.", "parse_record ...", "(no documentation)", "Add text here.", "Documentation follows below.", "Code goes here"]
REAL = ["Never returns null.", "Holds no harbor.", "该函数只读取一次。", "Liest nur einmal.", "Caller closes the record.", "parse_record works as follows. Stops after 9 errors.", "Mutates its argument!", "Retries twice (see the notes).", "Insert below the code.", "Follows source text."]


@pytest.mark.parametrize("doc", EMPTY)
def test_says_nothing(doc):
    assert not says_something(doc, "parseLateRecord", "a: int, b")
    assert not says_something(f"/**\n * {doc}\n */", "parse_late_record", "a, b")


@pytest.mark.parametrize("doc", REAL)
def test_says_something(doc):
    assert says_something(doc, "parseRecord", "a: int, b")
    assert says_something(f'"""{doc}"""', "parse_record", "a, b")


SOURCE = {
    "r/a.py": 'class A:\n    def m(self):\n        r"""Never blocks."""\n    def n(self):\n        x = 0\n        """Never blocks."""\ndef f():\n    # Never blocks.\n    pass\ndef g(): "Never blocks."\nasync def h(\n    a,\n):\n<<<<<<< HEAD\n    """Never blocks."""\n',
    "r/a.ts": "/** Never blocks. */\nexport const f = (a: number): number => a;\n/* Never blocks. */\nfunction g() {}\n/** Never blocks. */\n\nfunction h() {}\nclass C {\n  /** Never blocks. */\n  @dec()\n  private m(): void { const s = '/** x */'; }\n}\n",
    "r/A.java": "class A {\n  /** Never blocks. */\n  @Override\n  public int m(int a) { return 1; }\n  // Never blocks.\n  int n() { return 1; }\n}\n",
    "r/a.go": "package p\n\n// F never blocks.\nfunc F() {}\n\n// G never blocks.\n\nfunc G() {}\n\n/*\nNever blocks.\n*/\nfunc (t *T) H() {}\n",
    "r/A.cs": "class A {\n  /// <summary>\n  /// Never blocks.\n  /// </summary>\n  [Obsolete]\n  public int M() { return 1; }\n  /** Never blocks. */\n  int N() { return 1; }\n}\n",
    "r/merge.ts": "/** Never blocks. */\n=======\nfunction f() {}\n/**\n * TODO\n<<<<<<< HEAD\n */\nfunction g() {}\n",
    "r/wrong.js": "package p\n\n// F never blocks.\nfunc F(a int) int { return 1 }\n", "r/none.py": None, "r/empty.go": "",
}
WANT = {"r/a.py::A.m", "r/a.py::g", "r/a.py::h", "r/a.ts::f", "r/a.ts::C.m", "r/A.java::A.m", "r/a.go::F", "r/a.go::T.H", "r/A.cs::A.M", "r/wrong.js::F", "r/merge.ts::f"}


def test_pairs(spark):
    every = [f"r/a.py::{x}" for x in ("A.m", "A.n", "f", "g", "h")] + [f"r/a.ts::{x}" for x in ("f", "g", "h", "C.m")] + ["r/A.java::A.m", "r/A.java::A.n", "r/a.go::F", "r/a.go::G", "r/a.go::T.H", "r/A.cs::A.M", "r/A.cs::A.N", "r/wrong.js::F", "r/merge.ts::f", "r/merge.ts::g"]
    nodes = spark.createDataFrame([node(i, k) for i in every for k in ("func", "METHOD")] + [node("r/a.py::A", "class"), node(None)], NODE)
    f = files(spark, SOURCE)
    assert {r["node_id"] for r in documented(f, nodes).collect()} == WANT
    full = {r["node_id"]: (r["code"], r["documentation"]) for r in documented(f, nodes, full=True).collect()}
    assert set(full) == WANT and full["r/a.ts::f"] == ("export const f = (a: number): number => a;", "Never blocks.")
    assert documented(f, nodes.limit(0)).count() == documented(f.limit(0), nodes).count() == 0


BODY = "def fetch(a):\n    return a + 1\n\ndef store(b, c):\n    d = fetch(b)\n    if d is None:\n        return c\n    return merge(d, c, 17)\n\ndef other(q):\n    return [x for x in q if x != 115]\n"


def test_marks():
    why = lambda p, t: marks(p, t, {"py": "python", "js": "javascript", "go": "go", "ts": "typescript"}[p.rsplit(".", 1)[1]]).reason
    assert why("r/a.py", BODY) is None
    for head in ("Code generated by x. DO NOT EDIT.", "@generated by x", "AUTO-GENERATED FILE, do not modify", "Autogenerated from a.idl - changes will be lost", "This file was created automatically by x.", "machine generated output of x; edit the y instead", "<auto-generated>"):
        assert why("r/a.py", f"# Part of x.\n# {head}\n\n{BODY}") == "generated", head
    for head in ("First version was generated from a template, maintained by hand since.", "Writes generated clients; see the template next to this file.", "Replaces the vendored copy used until last year.", "The report name is generated from the batch date.\n# Do not edit the report by hand.", "Auto-generated stub."):
        assert why("r/a.py", f"# {head}\n\n{BODY}") is None, head
    assert why("r/a.py", f'BANNER = "# Code generated by x. DO NOT EDIT."\n{BODY}') is None
    for p in ("r/generated/a.py", "r/a_pb2.py", "r/b.gen.js", "r/zz_generated_a.go"):
        assert why(p, BODY) == "generated", p
    for p in ("r/code_generator.py", "r/generated_names.py", "r/generator/a.py", "r/vendors/a.py", "r/vendor_portal/a.py", "r/min_heap.py", "r/build_rules/a.py"):
        assert why(p, BODY) is None, p
    assert why("r/third_party/x/a.py", BODY) == "vendored" and why("r/a.py", f"# Vendored from x 1.2.3, unmodified.\n{BODY}") == "vendored"
    assert why("r/a.js", ";".join(f"var a{i}=function(b,c){{return b?c[b]||{i}:c.length}}" for i in range(40))) == "minified"
    assert why("r/a.py", "\n".join(f"x{i}=[{i},2,3];y{i}={{'a':0,'b':1}}\ndef f{i}(a,b):return a*{i}+b" for i in range(20))) == "minified"
    assert why("r/a.ts", "export const t: number[] = [\n" + ",\n".join(", ".join(str(k) for k in range(16)) for _ in range(20)) + "\n];\n") == "data"
    assert why("r/a.py", "DATA = [\n" + ",\n".join(f'    "{"Ab3" * 20}"' for _ in range(30)) + "\n]\n") == "data"
    assert why("r/a.py", f'SQL = "SELECT {", ".join(["a"] * 200)}"\n{BODY}') is None
    assert why("r/a.js", f"const p = /^({'|'.join(['ab'] * 100)})$/;\nfunction f(a) {{\n  return p.test(a);\n}}\n") is None


def test_copies_wherever_they_lie(spark):
    damaged = BODY[: BODY.index("def other")] + "def other(q):\n    return [x for"
    data = {
        "a/vendor/lib/x.py": BODY, "b/src/x.py": "# a note\n" + BODY.replace("    return a", "    # why\n    return a"), "c/src/broken.py": damaged, "d/src/own.py": BODY.replace("fetch", "load").replace("store", "save").replace("other", "more").replace("17", "18"),
        "d/src/tiny.py": "x = 1\n", "e/src/tiny.py": "x = 1\n", "f/none.py": None, "f/bad.py": b"\xff\xfe",
    }
    got = {r["file_path"]: r["reason"] for r in not_by_hand(files(spark, data)).collect()}
    assert got == {"a/vendor/lib/x.py": "vendored", "b/src/x.py": "vendored", "c/src/broken.py": "vendored"}
    twice = {r["file_path"] for r in not_by_hand(files(spark, {"a/p.py": BODY, "b/q.py": BODY, "b/r.py": BODY + "\nz = 1\n"})).collect()}
    assert twice == {"a/p.py", "b/q.py"}
    assert not_by_hand(files(spark, data).limit(0)).count() == 0
