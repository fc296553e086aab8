"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import hashed
from graphloom.runtime import cut


def _links(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every id once with its parent or null, and the same as hashes."""
    flat = pairs.select(F.inline(F.array(F.struct(F.col("child").alias("id"), F.col("parent").alias("up")), F.struct(F.col("parent").alias("id"), F.lit(None).cast("string").alias("up"))))).where("id is not null")
    ids = cut(flat.groupBy("id").agg(F.min("up").alias("up")))
    return ids, ids.select(*hashed("k", F.col("id")), *[F.when(F.col("up").isNotNull(), h).alias(f"a{i}") for i, h in enumerate(hashed("", F.col("up")), 1)])


def _below_cycles(open_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """For nodes on a cycle or below one: k1, k2 and the smallest id on that cycle.

    Doubling carries the smallest id among the nodes that a pointer has passed. Once neither a
    smallest id nor the number of nodes that are pointed at changes, the latter are the nodes on
    cycles and each has passed its whole cycle.
    """
    names = ids.select(*hashed("k", F.col("id")), F.col("id").alias("m"), *hashed("a", F.col("up")))
    s = cut(names.join(open_rows.select("k1", "k2"), ["k1", "k2"], "left_semi"))
    image = -1
    while True:
        at = s.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("m").alias("n"))
        s = cut(s.join(at, ["a1", "a2"]).select("k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.least("m", "n").alias("m"), (F.col("n") < F.col("m")).alias("moved")))
        now = s.agg(F.count_if("moved").alias("moved"), F.count_distinct("a1", "a2").alias("image")).first()
        s = s.drop("moved")
        if not now["moved"] and now["image"] == image:
            on = s.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("m").alias("smallest"))
            return s.join(on, ["a1", "a2"]).select("k1", "k2", "smallest")
        image = now["image"]


def _above(open_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """For nodes on a cycle or below one: k1, k2 and all that lies above, nearest first; a node on a cycle comes last in its own.

    Doubling joins what lies above a pointer's end to what lies below it and keeps the first of each.
    Once no list grows, each has passed its whole cycle.
    """
    names = ids.select(*hashed("k", F.col("id")), *hashed("a", F.col("up")), F.array("up").alias("above"))
    s = cut(names.join(open_rows.select("k1", "k2"), ["k1", "k2"], "left_semi"))
    size = -1
    while (now := s.agg(F.sum(F.size("above"))).first()[0]) != size:
        size = now
        at = s.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("above").alias("more"))
        s = cut(s.join(at, ["a1", "a2"]).select("k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.array_distinct(F.concat("above", "more")).alias("above")))
    return s.select("k1", "k2", "above")


def hierarchy(pairs: DataFrame, with_paths: bool = False, with_cycles: bool = False) -> DataFrame:
    """Root, depth and path of every id that is an end of a parent-child link.

    Each round joins the pointers of the unresolved nodes to the pointers of all nodes, which
    doubles their reach, so a depth of d needs about log2(d) rounds. Depths on a chain have no
    gaps, hence a round that resolves nothing has only nodes on or below cycles left. State is
    kept as 128-bit hashes; ids come back at the end.

    `pairs` has parent and child as clean ids. Ids that are null are no nodes; the other end of
    such a link is. Repeated links count once; of several parents the smallest id counts. A root
    has depth 0 and itself as root. A node on a cycle (a link to itself is one) or below it has
    depth -1 and the smallest id on the cycle as root; its path is the node alone. No links give
    no rows.

    Returns node_id, root_id, depth and, on demand, path: the ids from the root to the node, and
    (with_cycles) above: for nodes on or below cycles all ids above, nearest first, else null.
    """
    ids, links = _links(pairs)
    links = links.withColumn("has_up", F.col("a1").isNotNull())
    state = links.select(
        "k1", "k2",
        F.coalesce("a1", "k1").alias("a1"), F.coalesce("a2", "k2").alias("a2"),
        F.col("has_up").cast("int").alias("depth"), (~F.col("has_up")).alias("done"),
    )
    seg, more = [], ["above"] if with_cycles else []
    if with_paths:
        state = state.join(ids.select(*hashed("k", F.col("id")), F.array("id").alias("path")), ["k1", "k2"])
        seg = ["path"]
    roots = state.where("done")
    resolved, unresolved = roots, state.where("not done")
    left = -1
    while True:
        at = resolved.unionByName(unresolved).select(
            F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("depth").alias("more"), F.col("done").alias("ends"), *[F.col("path").alias("before") for _ in seg]
        )
        step = cut(
            unresolved.join(at, ["a1", "a2"]).select(
                "k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"), *[F.concat("before", "path").alias("path") for _ in seg]
            )
        )
        resolved, unresolved = resolved.unionByName(step.where("done")), step.where("not done")
        now = unresolved.count()
        if not now or now == left:
            break
        left = now
    name = ids.select(F.col("id").alias("node_id"), *hashed("k", F.col("id")))
    tops = roots.select("k1", "k2").join(name, ["k1", "k2"]).select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("node_id").alias("root_id"))
    out = resolved.join(tops, ["a1", "a2"]).select("k1", "k2", "root_id", "depth", *seg, *[F.lit(None).cast("array<string>").alias(c) for c in more]).join(name, ["k1", "k2"])
    if now:
        round_ = _below_cycles(unresolved, ids)
        if with_cycles:
            round_ = round_.join(_above(unresolved, ids), ["k1", "k2"])
        lost = round_.join(name, ["k1", "k2"]).select("k1", "k2", F.col("smallest").alias("root_id"), F.lit(-1).alias("depth"), *[F.array("node_id").alias("path") for _ in seg], *more, "node_id")
        out = out.unionByName(lost)
    return out.select("node_id", "root_id", "depth", *seg, *more)


def descendants(paths: DataFrame) -> DataFrame:
    """Every pair of a node and one below it with the number of steps, from hierarchy(with_paths=True).

    With with_cycles=True also the pairs on and below cycles: a node on a cycle has the cycle's other
    nodes and all that hangs below any of them as descendants, by the fewest steps, but not itself.
    Without it nodes on or below cycles are in no pair as descendants.
    """
    up = paths.where("depth > 0").select("node_id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    out = up.where("at < depth").select("ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("depth") - F.col("at")).alias("steps"))
    if "above" in paths.columns:
        lost = paths.where("depth < 0").select("node_id", F.posexplode("above").alias("at", "ancestor_id")).where("ancestor_id <> node_id")
        out = out.unionByName(lost.select("ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("at") + 1).alias("steps")))
    return out


def descendant_counts(paths: DataFrame) -> DataFrame:
    """Number of nodes below each node; the pairs are counted map-side before they are shuffled."""
    below = descendants(paths).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n_descendants"))
    return paths.select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path")).join(below, "node_id", "left").fillna(0, ["n_descendants"])
