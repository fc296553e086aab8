"""Lexers, local grammars and the chunked syntax check."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.ingest.lexing import CODE, lex
from graphloom.llm.grammar import parses
from graphloom.llm.validity import check_syntax, chunks, compose, failure_rates, state_map
from tests.helpers import T0

VALID = {
    "javascript": [
        "", "#!/usr/bin/env node\nlet a = 1\nconst b = a / 2 / 3\n", "import { A, B as C } from './x';\nexport default class D extends A { static x = 1; get y() { return `t ${this.x + `n`} u`; } async *z() {} }\n",
        "export const f = async (a, { b }, ...c) => { for (const x of c) { if (x) continue; else break } };\n", "const r = /[/\\]}]+/g.test(s) ? a : b;\n/* <<<<<<< ours\n*/\nlabel: while (1) { break label; }\n",
        "!function(){var a={b:1,'c':function(){return 2}};try{a()}catch(e){throw e}finally{}}();switch(x){case 1:a();default:b()}\n", "export { a, b };\nexport * from './y';\nvar t = [1, 2, 3,];\n",
    ],
    "typescript": [
        "interface A<T> extends B { x: T; y?: string[]; m(a: number): void }\ntype U = 'a' | { k: number };\nenum E { A = 1, B }\n", "export class C { private readonly a: Map<string, number> = new Map<string, number>(); constructor(private x: A) { super(); } get b(): number { return this.a!.size; } }\n",
        "export const f = (a: string, b?: number): Promise<void> => { return g<A>(a as any); };\nfunction h(this: A, ...r: unknown[]): r is string[] { return true; }\ndeclare const z: number;\nnamespace N { export let q = 1; }\n",
        "export async function go(q: Record<string, Array<number>>, w: (a: number) => string): Promise<Map<string, number>> {\n  return null;\n}\n",
    ],
    "java": [
        "package a.b;\n\nimport java.util.*;\nimport static x.Y.z;\n\n@Service(\"s\")\npublic final class C<T extends D> extends E implements F, G {\n  private static final int[] A = {1, 2, 3};\n  public C(int a) throws X { this.a = a; }\n  @Override\n  protected <R> Map<String, List<R>> m(final int a, String... b) {\n    for (int i = 0; i < 3; i++) { if (a > 1) continue; else return null; }\n    try (var r = open()) { do { x(); } while (true); } catch (A | B e) { throw new X(\"}\"); } finally { }\n    Runnable q = () -> { y(); };\n    var z = list.stream().map(x -> x + 1).toList();\n    switch (a) { case 1: break; default: return (int) b; }\n    char c = '{';\n    return new int[] {1};\n  }\n}\nenum Z { A(1), B { void f() {} }; int x; }\nrecord P(int x, int y) {}\n",
    ],
    "go": [
        "// doc\npackage p\n\nimport (\n\t\"a\"\n\tb \"c/d\"\n)\n\ntype T struct {\n\tx, y int\n\tf func(a int) error\n}\n\nvar m = map[string]int{\"a\": 1}\n\nfunc (t *T) F(a []string, b ...int) (int, error) {\n\tif x, ok := m[\"a\"]; ok && x > 1 {\n\t\treturn 1, nil\n\t} else if y {\n\t\tgo func() { z() }()\n\t}\n\tfor i, v := range []int{1, 2} {\n\t\tswitch v {\n\t\tcase 1, 2:\n\t\t\ti++\n\t\tdefault:\n\t\t\tbreak\n\t\t}\n\t}\n\tq := &T{x: 1, y: 2}\n\tdefer q.Close()\n\treturn len(`raw {`), nil\n}\n",
    ],
    "csharp": [
        "using System;\nusing X = A.B;\n\nnamespace N.M\n{\n    [Serializable]\n    public sealed class C<T> : D, IE where T : class\n    {\n        private readonly int a = 1;\n        public string P { get; set; } = \"x\";\n        public int Q => a;\n        public C(int b) : base(b) { }\n        [Obsolete]\n        internal static async Task<List<int>> M(IDictionary<string, int> d, params object[] r)\n        {\n            foreach (var x in d) { await F(x); }\n            var s = $\"{a} }}\";\n            var v = @\"c:\\\";\n            if (d is null) return null; else throw new E(nameof(d));\n            using (var f = Open()) { lock (this) { } }\n            var n = new[] { 1, 2 };\n            var o = new C<int>(1) { P = \"y\" };\n            Func<int, int> g = y => y + 1;\n            return default;\n        }\n        enum K { A = 1, B }\n    }\n}\n",
        "namespace A;\npublic record R(int X);\n",
    ],
    "python": ["", "def f():\n    return 1\n", "'''<<<<<<< ours'''\nmatch x:\n    case {'a': b}:\n        pass\n"],
}
OTHERS = ["[section]\nname = queue file\n", "CREATE TABLE a (\n  b INT\n);\nINSERT INTO a VALUES (1);\n", "<html>\n<body class=\"a\">\n<p>It isn't</p>\n</body>\n</html>\n", "# a guide\n\nThis text explains things.\n\n- one\n- two\n", "#!/bin/sh\nset -e\nif [ -z \"$A\" ]; then\n  exit 1\nfi\n"]


@pytest.mark.parametrize("lang", VALID)
def test_valid(lang):
    for t in VALID[lang]:
        assert parses(t, lang) is None, t


@pytest.mark.parametrize("lang", VALID)
def test_foreign_and_broken(lang):
    own = {"javascript": {"javascript", "typescript"}, "typescript": {"typescript"}}
    for other, texts in VALID.items():
        for t in texts:
            if t.strip() and other != lang and lang not in own.get(other, {other}) and not (other == "typescript" and lang == "typescript") and not (lang == "typescript" and other == "javascript"):
                assert parses(t, lang), (other, t)
    for t in OTHERS:
        assert parses(t, lang), t
    full = VALID[lang][-1 if lang in ("python", "javascript") else 0]
    assert parses(full + "\n<<<<<<< HEAD\n", lang) == "conflict marker"
    if lang != "python":
        assert parses(full[: full.rindex("}")], lang)
        assert parses(full + "}", lang)
    assert parses(full + '\n"open', lang)
    for head in {"javascript": ["export const a =", "import { A }", "class", "function f(a)"], "go": ["func", "import"], "java": ["public class"], "csharp": ["public class A"], "typescript": ["const f = (a: B): C"], "python": ["def f("]}[lang]:
        assert parses(full + "\n" + head, lang), head


def test_markup_in_expressions():
    t = "export const A = () => {\n  return <p className={a}>It isn't {b}</p>;\n};\n"
    assert parses(t, "javascript", markup=True) is None and parses(t + "<<<<<<< HEAD\n", "javascript", markup=True)
    assert parses("<html>\n<body class=\"a\">\n<p>It isn't</p>\n</body>\n</html>\n", "javascript", markup=True)


def test_null_bytes_and_go_needs_a_package():
    assert parses("a\0b", "python") and parses("", "go") and parses("// only a comment\n", "go")


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([t for ts in VALID.values() for t in ts if len(t) > 40]), st.integers(3, 60), st.sampled_from(list(VALID)))
def test_state_maps_compose(text, size, lang):
    maps = [json.loads(json.dumps(state_map(c, lang, i == 0))) for i, c in enumerate(chunks(text, size))]
    left = maps[0]
    for m in maps[1:]:
        left = compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = compose(m, right)
    assert tuple(map(str, left[CODE])) == tuple(map(str, right[CODE]))
    assert "".join(chunks(text, size)) == text
    tokens, end = lex(text, lang)
    if lang in VALID and text in VALID[lang]:
        assert left[CODE][0] in (end, CODE) and list(left[CODE][1]) == ["", "", False] and not left[CODE][2]


FILES = "file_path string, repo_id string, batch_no int, content binary, loaded_at timestamp_ntz, language string, no int, text string"


def rows(spark, data):
    return spark.createDataFrame([(p, "r", 1, c, T0, "clash", 1, "clash") for p, c in data], FILES)


def test_long_files_like_short_ones(spark):
    ext = {"python": "py", "javascript": "js", "typescript": "ts", "java": "java", "go": "go", "csharp": "cs"}
    data = [(f"{i}.{ext[k]}", t.encode()) for k, ts in VALID.items() for i, t in enumerate(ts)]
    data += [(f"x{i}.{e}", t.encode()) for i, t in enumerate(OTHERS) for e in ext.values()]
    data += [(f"b.{ext[k]}", (ts[-1] + "\n{").encode()) for k, ts in VALID.items()]
    whole = {r["file_path"]: r["complaint"] is None for r in check_syntax(rows(spark, data)).collect()}
    cut = {r["file_path"]: r["complaint"] is None for r in check_syntax(rows(spark, data), chunk_chars=20).collect()}
    assert whole == cut and len(whole) == len(data)
    assert all(whole[f"{i}.{ext[k]}"] for k, ts in VALID.items() for i in range(len(ts)))


def test_dirty_rows(spark):
    df = rows(spark, [("a.py", None), ("a.go", None), ("b.py", b"\xff\xfe"), ("c.py", "\ufeffx = 1\r\n".encode()), ("d.txt", b"x"), (None, b"x"), ("e.py", b"x = 1"), ("e.py", b"x = 1"), ("f.js", b"var a = 1\rvar b = 2\r")])
    got = {r["file_path"]: r["complaint"] for r in check_syntax(df).collect()}
    assert got == {"a.py": None, "a.go": "end", "b.py": "encoding", "c.py": None, "e.py": None, "f.js": None}
    assert check_syntax(df.limit(0)).count() == 0
    s = spark.createDataFrame([("r", 1, 2), ("r", 1, 2), ("r", 2, None)], "repo_id string, batch_no int, failed_files int")
    rate = {r["language"]: (r["n_files"], r["n_invalid"], r["reported_failed"]) for r in failure_rates(check_syntax(df), df, s).collect()}
    assert rate == {"python": (4, 1, 2), "go": (1, 1, 2), "javascript": (1, 0, 2)}
