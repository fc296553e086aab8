"""The same text has the same verdict in one chunk and in several."""

import pytest

from graphloom.llm.validity import _verdicts, check_syntax, verdict


def test_markup_is_one_chunk_at_any_length():
    text = "export const A = () => <b>it's</b>;\n" * 3
    assert [list(_verdicts(n)("a.jsx", 1, text.encode())) for n in (10, 10_000)] == [[("a.jsx", 1, "javascript", None, None, None, None)]] * 2


def test_short_files_pass_the_state_map():
    for path, text in (("a.js", "f(`${a"), ("a.py", "x = (1"), ("A.java", "class A {"), ("a.ts", "let a = 1;\n"), ("a.py", "")):
        (row,) = _verdicts(1000)(path, None, text.encode())
        assert (row[3] is None) == (text in ("let a = 1;\n", "")), path


@pytest.mark.parametrize("scale,size", [("sf0.001", 64), ("sf0.01", 4096)])
def test_chunk_size_never_matters(spark, scale, size):
    files = spark.read.parquet(f"/root/testdata/{scale}/source_files.parquet")
    whole = {r["file_path"]: r["complaint"] is None for r in check_syntax(files, 1 << 30).collect()}
    assert whole == {r["file_path"]: r["complaint"] is None for r in check_syntax(files, size).collect()}


COMPONENT = """export default function App({ items, on }) {
  const [a, setA] = useState(null);
  if (!items) {
    return <Spin size="l" />;
  }
  return (
    <Ctx.Provider value={{ a, setA }}>
      {/* c */}
      <ul className={cx('a', { b: a })} {...rest} onClick={(e) => { setA(e); }}>
        {items.map((i) => (
          <li key={i.id}>It's {i.name}, &nbsp; {i.n > 0 ? <b>{i.n}</b> : null}</li>
        ))}
        {a && <><i/>x</>}
      </ul>
    </Ctx.Provider>
  );
}
"""


def test_components():
    assert verdict(COMPONENT, "javascript", True) is None
    missed = [i for i in range(20, len(COMPONENT) - 2) if not verdict(COMPONENT[:i], "javascript", True)]
    assert len(missed) <= 3  # behind a whole statement
    for wrong in ("</ul>", "{...rest}", "value={{ a, setA }}", "</>"):
        assert verdict(COMPONENT.replace(wrong, wrong[:-1], 1), "javascript", True), wrong
    for tail in ("export function B( {", "const = 5 5;", "<<<<<<< HEAD"):
        assert verdict(f"{COMPONENT}{tail}\n", "javascript", True), tail


BROKEN = [
    ("go", "package p\nfunc f() { if { return } }\n"), ("go", "package p\nfunc f(a b c d) { g(1) }\n"), ("go", "package p\nfunc f() { g(1 2) }\n"), ("csharp", "class A { void F(int int x) { } }"),
    ("csharp", "class A { void F() { G(1 2 3); } }"), ("java", "class A { void f() { else { } } }"), ("java", "class A { void f() { break 5; } }"), ("typescript", "interface A { b c d e }"), ("typescript", "type T = { a: ; }"),
]
FINE = [
    ("java", "class A { int f() { if (a) if (b) return 1; else return 2; else if (c) return 3; else return 4; } }"), ("csharp", "class A { int F(this B b, int x = 1) { if (x is not null) G(x: 1, out var q, ref x); else H(); return 1; } }"),
    ("typescript", "const f = <T,>(x: T) => x;\ntype F = <T>(x: T) => void;\n"), ("go", "package p\nfunc (s *Store[T]) F(a, b int, c ...string) (int, error) {\n\tif v, ok := x.(T); ok {\n\t}\n\tfor {\n\t}\n\tfor k := range m {\n\t}\n\treturn 1, nil\n}\n"),
]


def test_closer_grammars():
    assert [verdict(t, lang) is not None for lang, t in BROKEN] == [True] * len(BROKEN)
    assert [verdict(t, lang) for lang, t in FINE] == [None] * len(FINE)
