"""Identity rules of the graph: ids, paths and type names in their canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of edge types and what they stand for.
EDGE_ALIASES = {
    "implements": "inherits",
    "extends": "inherits",
    "uses": "depends_on",
    "tested": "tested_by",
    "routes": "routes_to",
    "import": "imports",
    "call": "calls",
    "inherit": "inherits",
    "reference": "references",
    "contain": "contains",
    "define_in": "defined_in",
    "depend_on": "depends_on",
    "route_to": "routes_to",
    "test_by": "tested_by",
}
EDGE_TYPES = ("contains", "defined_in", "imports", "calls", "inherits", "references", "tested_by", "routes_to", "depends_on")

#: Spellings of node types and what they stand for.
NODE_ALIASES = {
    "func": "function",
    "cls": "class",
    "iface": "class",
    "interface": "class",
    "enum": "class",
    "struct": "class",
    "var": "function",
    "const": "function",
    "typedef": "class",
}
NODE_TYPES = ("repository", "file", "module", "class", "function", "method", "import", "external_symbol", "test", "route", "controller", "service", "component")

BLANKS = " \t\r\n 　"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def clean_id(c: Column) -> Column:
    """An id with `/` as separator and without surrounding blanks; an empty one is null."""
    x = strip(F.replace(c, F.lit("\\"), F.lit("/")))
    return F.when(x != "", x)


def clean_path(c: Column) -> Column:
    """A path with `/` as separator, without surrounding blanks and leading `./`."""
    x = F.regexp_replace(clean_id(c), r"^(\./)+", "")
    return F.when(x != "", x)


def _alias(c: Column, aliases: dict[str, str]) -> Column:
    x = F.lower(strip(c))
    pairs = [F.lit(v) for kv in aliases.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), x), x)


def edge_type(c: Column) -> Column:
    """The canonical edge type; an unknown one stays as it is, in lower case."""
    return _alias(c, EDGE_ALIASES)


def node_type(c: Column) -> Column:
    return _alias(c, NODE_ALIASES)


def spellings(kinds: tuple[str, ...], aliases: dict[str, str]) -> list[str]:
    """Lower-case spellings that stand for one of these types, for a filter before anything else."""
    return [*kinds, *(k for k, v in aliases.items() if v in kinds)]


def hashed(prefix: str, *cols: Column) -> list[Column]:
    """128 bits in two columns that stand for a long key in shuffles and joins.

    Two different keys among n collide with a probability of about n*n / 2**129.
    """
    return [F.xxhash64(*cols).alias(f"{prefix}1"), F.xxhash64(F.lit(0x51ED270B), *cols).alias(f"{prefix}2")]
