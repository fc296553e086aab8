"""The catalogue of questions about one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.operators import context, coverage, explain, graph, impact, integrity, search, traversal, validation
from graphloom.sources.tables import read_graph


class GraphIndex:
    """Nodes and edges with the questions one asks of them; every answer is a DataFrame.

    >>> g = GraphIndex.of_tables(spark, "/data")  # doctest: +SKIP
    >>> g.callers("src/app.py::login", depth=2).show()  # doctest: +SKIP
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges, self.spark = nodes, edges, nodes.sparkSession

    @classmethod
    def of_tables(cls, spark: SparkSession, folder: str) -> GraphIndex:
        read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
        return cls(graph.current_nodes(read("nodes"), read("external_nodes")), graph.current_edges(read("edges")))

    @classmethod
    def stored(cls, spark: SparkSession, folder: str) -> GraphIndex:
        return cls(*read_graph(spark, folder))

    def _start(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "root_id string")

    def resolve(self, name: str) -> DataFrame:
        """Candidates for an id or a name: exact ids first, then exact names, then parts; at most six."""
        q = name.lower()
        rank = F.when(F.lower("id") == q, 0).when(F.lower("name") == q, 1).when(F.contains(F.lower("id"), F.lit(q)), 2)
        return self.nodes.withColumn("rank", rank).where("rank is not null").orderBy("rank", "id").limit(6)

    def symbol(self, id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id)

    def search(self, query: str, limit: int = 20, offset: int = 0, min_score: float = 0.2, fuzzy: bool = True, **keep) -> DataFrame:
        """One page of ranked symbols. Further arguments are those of search_filter(): types, paths, exclude_paths, languages, layer, tests, external."""
        limit = max(1, min(limit, 100))
        return search.multi_pass(self.nodes, [query], limit, offset, min_score, fuzzy, search.search_filter(**keep) if keep else None).drop("query")

    def instead(self, query: str) -> DataFrame:
        """What to offer where nothing answers: symbols with such a name, of the same file, callers and callees of the best."""
        return search.fallback(self.nodes, self.edges, query)

    def find(self, query: str, limit: int = 5) -> DataFrame:
        return self.search(query, limit).select("id", "rank", "score").join(self.nodes, "id").select("rank", "score", "id", "type", "file_path", "line_start", "signature", "docstring").orderBy("rank")

    def callers(self, id: str, depth: int = 1, min_confidence: float = dims.MEDIUM, tests: bool = True, limit: int = 20) -> DataFrame:
        """Callers that are nodes of the graph; without tests these also end the way."""
        known = self.nodes if tests else self.nodes.where((F.col("type") != "test") & ~dims.is_test_path(F.col("file_path")))
        links = traversal.steps(self.edges, "incoming", ("calls",), min_confidence).join(known.select(F.col("id").alias("to")), "to", "left_semi")
        return traversal.reach(self._start(id), links, depth).orderBy("distance", "id").limit(limit)

    def callees(self, id: str, depth: int = 1, min_confidence: float = dims.MEDIUM) -> DataFrame:
        return traversal.callers_with_missing(self._start(id), self.edges, self.nodes, depth, min_confidence).orderBy("distance", "id")

    def neighbors(self, id: str, depth: int = 1, limit: int = 40, direction: str = "both", types: tuple[str, ...] | None = None, min_confidence: float = 0.0) -> DataFrame:
        links = traversal.steps(self.edges, direction, types, min_confidence, follow_unresolved=True)
        return traversal.reach(self._start(id), links, min(depth, 3)).orderBy("distance", F.desc("confidence"), "id").limit(min(limit, 100))

    def subgraph(self, id: str, depth: int = 1) -> DataFrame:
        return traversal.subgraph(self._start(id), self.edges, depth)

    def impact(self, *ids: str, depth: int = 2) -> DataFrame:
        return impact.impact(self._start(*ids), self.nodes, self.edges, depth)

    def risk(self, *ids: str, depth: int = 2) -> DataFrame:
        start = self._start(*ids)
        return impact.risk(start, self.nodes, self.edges, impact.impact(start, self.nodes, self.edges, depth))

    def pre_edit_check(self, *files: str, depth: int = 2) -> DataFrame:
        start = self.nodes.where(F.col("file_path").isin(*files) & F.col("type").isin(*dims.CALLABLES)).select(F.col("id").alias("root_id"))
        found = impact.impact(start, self.nodes, self.edges, depth)
        return impact.pre_edit(impact.risk(start, self.nodes, self.edges, found), found, self.nodes)

    def related_tests(self, id: str) -> DataFrame:
        return impact.related_tests(self.nodes, self.edges).where(F.col("id") == id)

    def external_calls(self, id: str) -> DataFrame:
        return impact.external_calls(self.nodes, self.edges).where(F.col("id") == id)

    def relationships(self, id: str, k: int = 5) -> DataFrame:
        near = self.edges.where((F.col("source") == id) | (F.col("target") == id))
        return explain.relationships(self.nodes, near, k).where(F.col("id") == id)

    def explain(self, id: str) -> DataFrame:
        """One row: the symbol with its summary, what its code uses, its relations counted, its tests and its risk."""
        one, near = self.symbol(id), self.edges.where((F.col("source") == id) | (F.col("target") == id))
        said = explain.summaries(one).drop("origin")
        counts = graph.relation_counts(self.nodes, near).drop("type").where(F.col("id") == id)
        out = one.join(said, "id", "left").join(counts, "id", "left").join(self.risk(id).select(F.col("root_id").alias("id"), "risk"), "id", "left")
        if "code_preview" in self.nodes.columns:
            out = out.join(explain.signals(one, near).drop("is_test_code"), "id", "left")
        return out

    def context(self, task: str, budget: int = 6000, ids: list[str] | None = None) -> dict:
        """Symbols for a task, as much of each as the budget of tokens leaves room for; see context.pack()."""
        return context.pack(self.nodes, self.edges, task, budget, ids)

    def scan(self, task: str) -> dict:
        return context.scan(self.nodes, task)

    def deepen(self, token: str) -> dict:
        return context.deepen(self.nodes, self.edges, token)

    def reach(self, token: str) -> dict:
        return context.reach_of(self.nodes, self.edges, token)

    def warnings(self) -> DataFrame:
        return integrity.graph_warnings(self.nodes, self.edges)

    def quality(self) -> DataFrame:
        return explain.quality(self.edges)

    def summary(self) -> DataFrame:
        return graph.repo_summary(self.nodes, self.edges)

    def stats(self) -> DataFrame:
        return graph.graph_stats(self.nodes, self.edges)

    def entry_points(self, k: int = 6) -> DataFrame:
        return graph.entry_points(self.nodes, self.edges, k)

    def coverage_gaps(self, limit: int = 50) -> DataFrame:
        return coverage.coverage_buckets(self.nodes, self.edges).where("bucket <> 'high'").orderBy("bucket", "id").limit(limit)

    def isolated(self) -> DataFrame:
        return validation.isolated_ratio(self.nodes, self.edges)
