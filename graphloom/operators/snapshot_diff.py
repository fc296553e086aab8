"""What changed between full snapshots, by Merkle trees over hash ranges of the keys."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import cut

FACETS = ("structural_hash", "symbols_hash", "imports_hash", "calls_hash")
FAN_BITS = 4  # sixteen children to a node of the tree
ROWS_PER_LEAF = 64
MOST_BITS = 60


def _value(c: str) -> Column:
    """64 bits of a hash in any letter case; null is a value of its own."""
    return F.xxhash64(F.coalesce(F.lower(F.trim(F.col(c))), F.lit("\0null")))


def _digests(*cols: Column) -> list[Column]:
    """An order-free digest of a set of rows: 128 bits and their number."""
    return [F.bit_xor(F.xxhash64(*cols)).alias("d1"), F.bit_xor(F.xxhash64(F.lit(17), *cols)).alias("d2"), F.count("*").alias("n")]


def _as_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each row as the later (sign 1) and as the earlier (sign -1) side of its group's pairs of versions."""
    later = F.struct(F.col("v").alias("pair"), F.lit(1).alias("sign"))
    earlier = F.struct(F.col("nv").alias("pair"), F.lit(-1).alias("sign"))
    sides = F.filter(F.array(F.when(F.col("pv").isNotNull(), later), F.when(F.col("nv").isNotNull(), earlier)), lambda s: s.isNotNull())
    return rows.join(pairs, ["g", "v"]).withColumn("side", F.explode(sides)).select("*", "side.pair", "side.sign").drop("side", "v", "pv", "nv")


def leaf_bits(df: DataFrame, group: str, version: str) -> int:
    """Bits of the leaf's hash range: about ROWS_PER_LEAF rows a leaf in the largest snapshot."""
    most = df.groupBy(group, version).count().agg(F.max("count")).first()[0] or 1
    return min(MOST_BITS, max(1, ceil(log2(max(1, most / ROWS_PER_LEAF)))))


def _rows(df: DataFrame, key: Column, group: str, version: str, content: str, facets: tuple[str, ...], arrival: str, bits: int) -> DataFrame:
    """Delivered records: g, v, leaf, k, at and 64 bits of each hash."""
    if not 1 <= bits <= MOST_BITS:
        raise ValueError(f"bits must lie between 1 and {MOST_BITS}")
    return (
        df.select(F.col(group).alias("g"), F.col(version).alias("v"), key.alias("k"), F.col(arrival).alias("at"), _value(content).alias("c"), *[_value(x).alias(f"f{i}") for i, x in enumerate(facets)])
        .where("g is not null and v is not null and k is not null")
        .withColumn("leaf", F.shiftrightunsigned(F.xxhash64("k"), 64 - bits))
    )


def _last(rows: DataFrame, f: list[str]) -> DataFrame:
    """Of several rows for one group, version and key the one that arrived last."""
    last = rows.repartition("g", "leaf").groupBy("g", "leaf", "v", "k").agg(F.max(F.struct("at", "c", *f)).alias("r"))
    return last.select("g", "leaf", "v", "k", "r.c", *[f"r.{x}" for x in f])


def _leaves(last: DataFrame, f: list[str]) -> DataFrame:
    return last.groupBy("g", "leaf", "v").agg(*_digests(F.col("k"), F.col("c"), *map(F.col, f)))


def leaf_digests(
    df: DataFrame, key: Column, bits: int, group: str = "repo_id", version: str = "snapshot_no", content: str = "sha256", facets: tuple[str, ...] = FACETS, arrival: str = "loaded_at"
) -> DataFrame:
    """The leaves of each group's and version's tree: g, leaf, v, d1, d2, n.

    A delivered snapshot never changes, so its leaves can be stored once. With the stored leaves
    of the earlier versions a new one is compared without reading their rows, but for those in
    leaves that differ: snapshot_changes(..., leaves=...).
    """
    f = [f"f{i}" for i in range(len(facets))]
    return _leaves(_last(_rows(df, key, group, version, content, facets, arrival, bits), f), f)


def _differing(leaves: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """Leaves in which the two versions of a pair differ, found from the root down: g, pair, leaf."""
    sided = _as_pairs(leaves, pairs)
    differing, above = None, 0
    for level in [*range(0, bits, FAN_BITS), bits]:
        level_nodes = sided.withColumn("node", F.shiftright("leaf", bits - level))
        if differing is not None:
            parents = differing.select("g", "pair", F.col("node").alias("parent"))
            level_nodes = level_nodes.withColumn("parent", F.shiftright("node", level - above)).join(parents, ["g", "pair", "parent"], "left_semi")
        differing = (
            level_nodes.groupBy("g", "pair", "node")
            .agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum(F.col("n") * F.col("sign")).alias("n"))
            .where("d1 <> 0 or d2 <> 0 or n <> 0")
            .select("g", "pair", "node")
        )
        above = level
    return differing.withColumnRenamed("node", "leaf")


def snapshot_changes(
    df: DataFrame,
    key: Column,
    group: str = "repo_id",
    version: str = "snapshot_no",
    content: str = "sha256",
    facets: tuple[str, ...] = FACETS,
    arrival: str = "loaded_at",
    bits: int | None = None,
    leaves: DataFrame | None = None,
) -> DataFrame:
    """Records added, removed or changed between each version of a group and its previous one.

    Keys fall into hash ranges, the leaves of a tree per group and version. Digests of a later
    and an earlier version are compared from the root down; only children of nodes that differ
    are looked at, and only rows of leaves that differ are compared. Leaves of one group lie in
    many partitions, so a group that holds a third of all rows is spread. Any number of `bits`
    (the hash range of a leaf) gives the same result. `leaves` are stored leaf_digests() of all
    versions with the same bits; rows then are read for the leaves that differ only.

    Of several rows for one group, version and key the one that arrived last counts (a null
    arrival is the earliest; at a tie the greatest hashes). Rows without group, version or key
    are no records and are left out. A null hash differs from any other. A group's first
    version gives no rows, an empty table gives none.

    Returns group, version, key, change (added, removed, cosmetic, structural) and one boolean
    per facet that tells whether it changed (null for added and removed).
    """
    if leaves is not None and bits is None:
        raise ValueError("stored leaves need the bits they were made with")
    bits = bits or leaf_bits(df, group, version)
    f = [f"f{i}" for i in range(len(facets))]
    rows = _rows(df, key, group, version, content, facets, arrival, bits)
    stored = leaves is not None
    if not stored:
        rows = _last(rows, f)
        leaves = _leaves(rows, f)
    w = Window.partitionBy("g").orderBy("v")
    pairs = leaves.select("g", "v").distinct().select("g", "v", F.lag("v").over(w).alias("pv"), F.lead("v").over(w).alias("nv"))
    leaf = _differing(leaves, pairs, bits)
    if stored:
        leaf = cut(leaf)
        rows = _last(rows.join(leaf.select("g", "leaf").distinct(), ["g", "leaf"], "left_semi"), f)

    late = F.col("sign") == 1
    side = lambda c, cond: F.max(F.when(cond, F.col(c)))
    both = (
        _as_pairs(rows, pairs)
        .join(leaf, ["g", "pair", "leaf"], "left_semi")
        .groupBy("g", "pair", "leaf", "k")
        .agg(*[side(x, late).alias(f"{x}_now") for x in ["c", *f]], *[side(x, ~late).alias(f"{x}_was") for x in ["c", *f]])
        .where("not (c_now <=> c_was)")
    )
    moved = [F.col(f"{x}_now") != F.col(f"{x}_was") for x in f]
    any_moved = F.lit(False)
    for m in moved:
        any_moved = any_moved | m
    change = F.when(F.col("c_was").isNull(), "added").when(F.col("c_now").isNull(), "removed").when(any_moved, "structural").otherwise("cosmetic")
    return both.select(F.col("g").alias(group), F.col("pair").alias(version), F.col("k").alias("file_path"), change.alias("change"), *[m.alias(f"{x}_changed") for m, x in zip(moved, facets)])
