"""What a task needs of a graph: its profile, entries, selected context within a budget of tokens.

Tables are searched and scored as DataFrames; only ranked rows of a fixed number (limits below)
come to the driver, where the budget is spent item by item.
"""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.intents import INTENTS, pattern
from graphloom.operators import impact, search

LIMIT, ENTRIES, FILES = 200, 5, 8
LEAST, MOST = 100, 20_000
#: Words that look like symbols and are none; words of operations, domains and constraints.
NO_SYMBOLS = frozenset("javascript typescript python java golang rust postgresql mongodb redis docker kubernetes authentication authorization microservices serverless".split())
OPERATIONS = {"create": "add create implement introduce new", "modify": "change update modify refactor rename move", "remove": "delete remove drop deprecate", "fix": "fix bug broken error fail crash", "test": "test tests coverage", "explain": "explain understand how why where"}
DOMAINS = {"auth": "login auth token password session permission", "storage": "database store storage sql cache persist", "api": "api route endpoint http request", "config": "config setting environment option", "ui": "component page view render"}
CONSTRAINTS = {"keep_api": r"without (?:changing|breaking)|backward|compatib", "no_tests": r"no tests|without tests", "minimal": r"minimal|small(?:est)? change|only"}


def named_symbols(task: str) -> list[str]:
    """Names that a task writes like code: PascalCase, snake_case, UPPER_CASE."""
    found = [m for p in (r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b", r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b") for m in re.findall(p, task)]
    return [w for w in dict.fromkeys(found) if w.lower() not in NO_SYMBOLS]


def clauses(task: str) -> list[str]:
    return [c.strip() for c in re.split(r"[;,.]\s+|\s+(?:and then|and|then|also|but)\s+", task.lower()) if c.strip()]


def profile(task: str) -> dict:
    """Intent of the first clause, intents of the others, and signals of operations, domains and constraints."""
    intent = lambda text: next((n for n, w in INTENTS if re.search(pattern(w), text)), "understand_code")
    parts = clauses(task) or [""]
    words = lambda table: [k for k, ws in table.items() if re.search(r"\b(?:" + ws.replace(" ", "|") + r")\b", task.lower())]
    first = intent(parts[0])
    return {
        "intent": first, "secondary": [i for i in dict.fromkeys(map(intent, parts[1:])) if i != first], "operations": words(OPERATIONS), "domains": words(DOMAINS), "constraints": [k for k, p in CONSTRAINTS.items() if re.search(p, task.lower())],
        "symbols": named_symbols(task), "clauses": len(parts),
    }


def strategy(found: dict) -> dict[str, str]:
    """How much each relation matters for a profile."""
    out = {"entry_point": "critical", "callee": "high", "caller": "medium", "test": "medium", "model": "medium", "config": "low", "store": "medium"}
    if "test" in found["operations"] or found["intent"] == "write_tests":
        out["test"] = "high"
    if {"modify", "remove"} & set(found["operations"]) or "keep_api" in found["constraints"]:
        out["caller"] = "high"
    if "config" in found["domains"]:
        out["config"] = "high"
    if "no_tests" in found["constraints"]:
        out["test"] = "low"
    return out


def entries(nodes: DataFrame, task: str, k: int = ENTRIES, ids: list[str] | None = None) -> DataFrame:
    """Where a task begins: stated ids, else symbols that it names, else the most relevant ones; id, score."""
    score, _ = search.relevance_parts(task)
    symbols = nodes.where(~F.col("type").isin("file", "module", "external_symbol")).select("*", score.alias("relevance"))
    if ids:
        return symbols.where(F.col("id").isin(ids)).select("id", "relevance")
    named = F.col("name").isin(named_symbols(task) or [""])
    return symbols.where((F.col("relevance") > 0) | named).orderBy(F.desc(named.cast("int")), F.desc("relevance"), "id").limit(k).select("id", "relevance")


class Budget:
    """Tokens left; what is critical or high always fits."""

    def __init__(self, tokens: int):
        self.left = max(LEAST, min(tokens, MOST))

    def fits(self, cost: int, priority: str) -> bool:
        return cost <= self.left or priority in ("critical", "high")


def tokens(text: str | None) -> int:
    return max(1, len(text) // 4) if text else 0


def forms(row: dict) -> dict[str, str]:
    """A node as source, as summary and as reference."""
    place = f"{row['file_path'] or '?'}:{row['line_start'] or 0}"
    first = (row["docstring"] or "").strip().split("\n")[0]
    return {"full_source": row["code_preview"] or row["signature"] or row["id"], "summary": " — ".join(x for x in (row["signature"] or row["name"], first) if x), "reference": f"{row['name']} ({place})"}


def mode(relation: str, priority: str, confidence: float, cost: int, budget: Budget) -> str:
    """What to show of an item: source of entries, summaries of models, tests by confidence, references of what is unsure."""
    if priority == "critical" or relation == "entry_point":
        return "full_source"
    if relation in ("model", "config", "store"):
        return "summary"
    if relation == "test":
        return "full_source" if confidence >= 0.75 else "summary" if confidence >= 0.60 else "reference"
    if confidence < 0.60:
        return "reference"
    return "summary" if budget.left < cost and priority != "high" else "full_source"


def select(items: list[dict], budget: Budget, plan: dict[str, str]) -> list[dict]:
    """Spend the budget in order of tier and score; an item that doesn't fit is shown shorter, else left out."""
    out = []
    for r in sorted(items, key=lambda r: (r["tier"], -r["score"], r["id"])):
        priority, texts = plan.get(r["relation"], "low"), forms(r)
        chosen = mode(r["relation"], priority, r["confidence"], tokens(texts["full_source"]), budget)
        for m in ("full_source", "summary", "reference")[("full_source", "summary", "reference").index(chosen) :]:
            cost = tokens(texts[m])
            if budget.fits(cost, priority) or m == "reference" and cost <= budget.left:
                budget.left -= cost
                out.append({"id": r["id"], "relation": r["relation"], "file_path": r["file_path"], "score": r["score"], "mode": m, "text": texts[m], "tokens": cost})
                break
    return out


def pack(nodes: DataFrame, edges: DataFrame, task: str, budget: int = 6000, ids: list[str] | None = None) -> dict:
    """A context for a task: profile, entries, selected items, files in order of first use, tests, and what was left out."""
    found, spent = profile(task), Budget(budget)
    plan = strategy(found)
    begin = entries(nodes, task, ids=ids)
    columns = ["id", "name", "type", "file_path", "line_start", "signature", "docstring", "code_preview"]
    full = nodes.select(*[F.col(c) if c in nodes.columns else F.lit(None).cast("string").alias(c) for c in columns])
    first = [r.asDict() | {"relation": "entry_point", "confidence": 1.0, "tier": 0, "score": r["relevance"]} for r in begin.join(full, "id").collect()]  # at most ENTRIES or the ids stated
    around = impact.context_items(nodes, edges, begin, task).orderBy("tier", F.desc("score"), "id").limit(LIMIT)
    rest = [r.asDict() for r in around.join(full, "id").collect()]
    items = select(first + rest, spent, plan)
    files = list(dict.fromkeys(i["file_path"] for i in items if i["file_path"]))
    return {"task": task, "profile": found, "items": items, "files": files[:FILES], "tests": [i["id"] for i in items if i["relation"] == "test"], "left_out": len(first) + len(rest) - len(items), "tokens": sum(i["tokens"] for i in items)}


def markdown(made: dict) -> str:
    """A pack as Markdown."""
    out = [f"# {made['task']}", "", f"Intent: {made['profile']['intent']}. Tokens: {made['tokens']}.", ""]
    for i in made["items"]:
        out += [f"## {i['id']} ({i['relation']}, {i['mode']})", "", "```", i["text"], "```", ""]
    return "\n".join([*out, "Files: " + ", ".join(made["files"])])


def token(state: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(state, sort_keys=True).encode()).decode()


def state_of(text: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(text.encode()))
    except ValueError as wrong:
        raise ValueError("no continuation token") from wrong


def scan(nodes: DataFrame, task: str, k: int = 5) -> dict:
    """First stage: entries, their files and a token to go on with."""
    rows = [r.asDict() for r in entries(nodes, task, k).join(nodes.select("id", "name", "type", "file_path"), "id").orderBy(F.desc("relevance"), "id").collect()]
    return {"entries": rows, "files": list(dict.fromkeys(r["file_path"] for r in rows if r["file_path"]))[:k], "token": token({"task": task, "stage": "scan", "ids": [r["id"] for r in rows]})}


def deepen(nodes: DataFrame, edges: DataFrame, after: str, k: int = 5) -> dict:
    """Second stage: of what the token names the k surest callers, callees and tests each, one step away."""
    state = state_of(after)
    begin = nodes.where(F.col("id").isin(state["ids"] or [""])).select("id")
    near = impact.context_items(nodes, edges, begin, state["task"]).where(F.col("relation").isin("caller", "callee", "test"))
    rows = [r.asDict() for rel in ("caller", "callee", "test") for r in near.where(F.col("relation") == rel).orderBy(F.desc("confidence"), "id").limit(k).collect()]
    return {"near": rows, "token": token(state | {"stage": "deepen"})}


def reach_of(nodes: DataFrame, edges: DataFrame, after: str, k: int = 10) -> dict:
    """Third stage: what a change of the symbols reaches within two steps, and the greatest risk."""
    state = state_of(after)
    starts = nodes.where(F.col("id").isin(state["ids"] or [""])).select(F.col("id").alias("root_id"))
    found = impact.impact(starts, nodes, edges)
    risks = [r["risk"] for r in impact.risk(starts, nodes, edges, found).collect()]  # a row per symbol of the token
    callers = [r["id"] for r in found.where("relation = 'caller'").groupBy("id").agg(F.min("distance").alias("d")).orderBy("d", "id").limit(k).collect()]
    files = [r["file_path"] for r in impact.impact_files(found).groupBy("file_path").agg(F.min("distance").alias("d")).orderBy("d", "file_path").limit(k).collect()]
    return {"risk": max(risks, key=lambda r: impact.RISKS.index(r) if r in impact.RISKS else -1, default="unknown"), "callers": callers, "files": files, "token": token(state | {"stage": "impact"})}
