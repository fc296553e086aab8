"""What a task asks for, by ordered lists of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of each intent, in the order in which they are judged; a word of up to five letters must stand alone.
INTENTS = (
    ("write_tests", ("write test", "add test", "add tests", "test coverage", "pytest", "unit test", "integration test", "spec")),
    ("fix_bug", ("fix", "bug", "error", "wrong", "broken", "fails", "exception", "traceback", "issue", "incorrect", "crash")),
    ("refactor", ("refactor", "cleanup", "simplify", "extract", "rename", "move", "split", "deduplicate", "restructure", "reorganize")),
    ("analyze_impact", ("impact", "affected", "what breaks", "blast radius", "dependency", "depends on", "what depends")),
    ("understand_code", ("explain", "understand", "how does", "how works", "walk me through", "what does", "describe")),
    ("generate_docs", ("document", "docs", "readme", "write documentation", "generate docs", "api docs", "docstring")),
    ("modify_existing_behavior", ("change", "modify", "update", "adjust", "revise", "edit", "make", "improve", "enhance")),
    ("add_feature", ("add", "implement", "support", "introduce", "create", "enable", "new", "feature")),
    ("review_code", ("review", "audit", "check", "inspect", "verify", "security review", "code review")),
)
TEST_WORDS, WRITE_WORDS = ("test", "tests", "spec", "coverage", "pytest"), ("write", "add", "create")
SHORT = 5


def pattern(words: tuple[str, ...]) -> str:
    """A regular expression for any of the words; understood alike by Java and RE2."""
    short = "|".join(w for w in words if len(w) <= SHORT)
    long = "|".join(w for w in words if len(w) > SHORT)
    return "|".join(x for x in (f"(^|[^a-z0-9_])({short})($|[^a-z0-9_])" if short else "", f"({long})" if long else "") if x)


def intent(text: Column) -> Column:
    """The first intent with a word in the text; words for writing and for tests together ask for tests; without any the task is to understand."""
    t = F.lower(text)
    has = lambda words: F.coalesce(t.rlike(pattern(words)), F.lit(False))
    out = F.when(has(TEST_WORDS) & has(WRITE_WORDS), "write_tests")
    for name, words in INTENTS:
        out = out.when(has(words), name)
    return out.otherwise("understand_code")
