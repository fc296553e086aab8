"""Comparing results of the two engines, and tables of a few rows."""

from __future__ import annotations

import os
from datetime import datetime

import duckdb
import pandas as pd

T0 = datetime(2024, 1, 1)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.removesuffix('.parquet')} as from '{folder}/{f}'")
    return c


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "None"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 6))
    return repr(list(v)) if hasattr(v, "__len__") and not isinstance(v, (str, bytes)) else repr(v)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(map(_cell, r)) for r in pdf.itertuples(index=False, name=None))


NODE = "id string, type string, name string, file_path string, module string, qualified_name string, language_id string, location struct<line_start: int, line_end: int>, signature string, docstring string, code_preview string, tags array<string>, repo_id string, indexed_at timestamp_ntz, removed_at timestamp_ntz"
EDGE = "id string, type string, source string, target string, confidence double, source_location struct<file_path: string, line_start: int, line_end: int>, metadata struct<call_expr: string, resolution: string>, repo_id string, indexed_at timestamp_ntz, loaded_at timestamp_ntz"
EXTERNAL = "id string, type string, name string, qualified_name string, indexed_at timestamp_ntz, removed_at timestamp_ntz"


def node(i: str | None, kind: str = "function", since=T0, until=None, **more) -> tuple:
    x = {"name": (i or "").rsplit("::", 1)[-1], "file_path": (i or "").split("::")[0], "tags": [], "repo_id": "r"} | more
    return (i, kind, x["name"], x["file_path"], None, x.get("qualified_name"), x.get("language_id", "python"), x.get("location"), None, x.get("docstring"), None, x["tags"], x["repo_id"], since, until)


def edge(i: str | None, source, target, kind: str = "calls", confidence=0.9, resolution="import_resolved", at=T0, loaded=T0) -> tuple:
    return (i, kind, source, target, confidence, None, (None, resolution) if resolution else None, "r", at, loaded)


def tables(spark, nodes=(), edges=(), external=()):
    return spark.createDataFrame(list(nodes), NODE), spark.createDataFrame(list(edges), EDGE), spark.createDataFrame(list(external), EXTERNAL)
