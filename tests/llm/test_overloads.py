"""Overloads of which only a later one is documented."""

from graphloom.llm.pairs import _functions


def test_a_later_documented_overload_counts():
    text = "class A {\n  int f(int x) { return x; }\n  /** Adds both sides of the ledger. */\n  int f(int x, int y) { return x + y; }\n}\n"
    (row,) = _functions("A.java", text.encode(), True)
    assert row[0].startswith("A.java::") and "x + y" in row[1] and "ledger" in row[2]
