"""References to records that do not exist: direct orphans and those that inherit it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import clean_id, edge_type, hashed, spellings, EDGE_ALIASES, strip
from graphloom.runtime import cut


def lives(records: DataFrame) -> DataFrame:
    """One row per id (as a hash) with the set of its lives [since, until).

    The set is built map-side first, so repeated deliveries of one id never travel. It has as
    many entries as the id has different lives.
    """
    rows = records.select(clean_id(F.col("id")).alias("id"), F.col("indexed_at").alias("since"), F.col("removed_at").alias("until")).where("id is not null")
    return rows.select(*hashed("r", F.col("id")), F.struct("since", "until").alias("life")).groupBy("r1", "r2").agg(F.collect_set("life").alias("lives"))


def _alive(lives_col: str) -> Column:
    return F.exists(F.col(lives_col), lambda x: (x["since"] <= F.col("t")) & (x["until"].isNull() | (x["until"] > F.col("t"))))


def _begun(lives_col: str) -> Column:
    return F.exists(F.col(lives_col), lambda x: x["since"] <= F.col("t"))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def edge_ends(edges: DataFrame) -> DataFrame:
    """Both ends of each edge that name a record: edge_id, side, r1, r2 (hash of the id), t, kind of edge."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), clean_id(F.col(s)).alias("ref")) for s in ("source", "target")])
    flat = edges.select(F.col("id").alias("edge_id"), F.col("indexed_at").alias("t"), F.inline(F.filter(sides, lambda x: x["ref"].isNotNull())))
    return flat.select("edge_id", "side", "t", *hashed("r", F.col("ref")))


def _earliest(ends: DataFrame, *fields: str) -> DataFrame:
    """One row per edge and side; of rows that differ the one of the earliest time, then of the least fields."""
    e = ends.groupBy("edge_id", "side").agg(F.min(F.struct("t", *fields)).alias("e"))
    return e.select("edge_id", "side", "e.t", *[f"e.{c}" for c in fields])


def direct_orphans(edges: DataFrame, nodes: DataFrame, external: DataFrame) -> DataFrame:
    """Round 0 of the cascade: ends whose id is not alive at the edge's time, with the reason.

    The few external symbols take most of the references; they are joined first (Spark broadcasts
    them only below spark.sql.autoBroadcastJoinThreshold) and what is alive there goes no further.
    The rest is joined with the lives of the nodes on a 128-bit hash of the id; adaptive skew
    handling splits the partition of an id that most edges refer to.
    """
    ends = edge_ends(edges)
    ext = lives(external).withColumnRenamed("lives", "x")
    rest = ends.join(ext, ["r1", "r2"], "left").where(~_yes(_alive("x")))
    rest = rest.select("edge_id", "side", "t", "r1", "r2", F.col("x").isNotNull().alias("known"), _yes(_begun("x")).alias("begun"))
    seen = rest.join(lives(nodes).withColumnRenamed("lives", "y"), ["r1", "r2"], "left").where(~_yes(_alive("y")))
    known = F.col("known") | F.col("y").isNotNull()
    begun = F.col("begun") | _yes(_begun("y"))
    kind = F.when(~known, "missing").when(begun, "deleted").otherwise("late")
    return _earliest(seen.withColumn("kind", kind), "kind", "r1", "r2")


def orphan_cascade(edges: DataFrame, nodes: DataFrame, external: DataFrame, rounds: int | None = None) -> DataFrame:
    """Orphan ends of edges: direct ones, and those that inherit it down the contains edges.

    An end is a direct orphan if its id has no life at the edge's indexed_at: `missing` (no
    record has the id), `deleted` (some life had begun) or `late` (all lives begin afterwards).
    A child whose parent is a direct orphan is an orphan by inheritance, so are its own children,
    and every end that refers to such a child. Each round is a semi-join of the contains edges
    with the children found in the round before; it ends when a round finds none (a cycle is
    passed once). Of edges with the same ends under several ids each counts. `rounds` stops it earlier.

    Null, empty and blank ids refer to nothing and give no rows. An edge without time has no alive
    end (missing or late). A record without indexed_at is never alive. Repeated rows of an edge
    give one row, at different times that of the earliest. Empty tables: every end is missing; no edges give no rows.

    Returns edge_id, side, kind, relation (direct, inherited), hops (0 for direct), t.
    """
    direct = direct_orphans(edges, nodes, external)
    direct = cut(direct)
    inside = F.lower(strip(F.col("type"))).isin(spellings(("contains",), EDGE_ALIASES))
    contains = edges.where(inside).select(F.col("id").alias("edge_id"), clean_id(F.col("source")).alias("p"), clean_id(F.col("target")).alias("c")).where("p is not null and c is not null")
    contains = contains.select("edge_id", *hashed("p", F.col("p")), *hashed("c", F.col("c")))
    links = cut(contains.drop("edge_id").dropDuplicates())
    found = cut(
        contains.join(direct.where("side = 'source'").select("edge_id"), "edge_id", "left_semi").select(F.col("c1").alias("r1"), F.col("c2").alias("r2"), F.lit(1).alias("hops")).dropDuplicates(["r1", "r2"])
    )
    frontier, n, size = found, 1, found.count()
    while size and (rounds is None or n < rounds):
        n += 1
        up = frontier.select(F.col("r1").alias("p1"), F.col("r2").alias("p2"))
        below = links.join(up, ["p1", "p2"], "left_semi").select(F.col("c1").alias("r1"), F.col("c2").alias("r2")).distinct()
        frontier = cut(below.join(found.select("r1", "r2"), ["r1", "r2"], "left_anti").withColumn("hops", F.lit(n)))
        size = frontier.count()
        found = found.unionByName(frontier)
    inherited = (
        edge_ends(edges)
        .join(found, ["r1", "r2"])
        .join(direct.select("edge_id", "side"), ["edge_id", "side"], "left_anti")
    )
    inherited = (
        _earliest(inherited, "hops")
        .select("edge_id", "side", F.lit("inherited").alias("kind"), F.lit("inherited").alias("relation"), "hops", "t")
    )
    return direct.select("edge_id", "side", "kind", F.lit("direct").alias("relation"), F.lit(0).alias("hops"), "t").unionByName(inherited)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan ends per referring column and month of the edge's time."""
    return (
        orphans.groupBy(F.concat(F.lit("edges."), F.col("side")).alias("reference"), F.date_format("t", "yyyy-MM").alias("month"))
        .agg(
            *[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("missing", "deleted", "late")],
            F.sum((F.col("relation") == "direct").cast("long")).alias("direct"),
            F.sum((F.col("relation") == "inherited").cast("long")).alias("inherited"),
        )
    )
