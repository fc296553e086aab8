"""The general operators for training data on small dirty tables and against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from graphloom.functions.keys import clean_id, clean_path, edge_type, hashed
from graphloom.operators.hierarchy import descendants, hierarchy
from graphloom.operators.orphans import orphan_cascade, orphan_report
from graphloom.operators.skewed_groups import _PARTIAL, _partial_states, balanced_group_stats, stitch
from graphloom.operators.snapshot_diff import leaf_digests, snapshot_changes
from graphloom.runtime import portable
from tests.helpers import T0, edge, node, tables

FP = "repo_id string, snapshot_no int, file_path string, sha256 string, structural_hash string, symbols_hash string, imports_hash string, calls_hash string, loaded_at timestamp_ntz, g string, v int, k string"


def fp(repo, no, path, sha, s="s", at=T0):
    return (repo, no, path, sha, s, "y", "i", "c", at, "clash", 1, "clash")


def changes(spark, data, bits=8):
    df = snapshot_changes(spark.createDataFrame(data, FP), clean_path(F.col("file_path")), bits=bits)
    return sorted((r["repo_id"], r["snapshot_no"], r["file_path"], r["change"]) for r in df.collect())


def test_snapshots(spark):
    later = T0 + timedelta(hours=1)
    data = [
        fp("a", 1, "./x\\y.py", "AA"), fp("a", 1, "gone.py", "bb"), fp("a", 1, "same.py", "cc"), fp("a", 1, "moved.py", "dd"),
        fp("a", 3, "x/y.py", "aa"), fp("a", 3, "same.py", "c2"), fp("a", 3, "moved.py", "d2", "S2"), fp("a", 3, "new.py", None), fp("a", 3, "new.py", None),
        fp("a", 4, "x/y.py", "zz", at=T0), fp("a", 4, "x/y.py", "aa", at=later), fp("a", 4, "same.py", "c2", at=None), fp("a", 4, "moved.py", "d2", "s2"), fp("a", 4, "new.py", "ee"),
        fp("b", 2, "only.py", "aa"), fp(None, 1, "x", "a"), fp("a", None, "x", "a"), fp("a", 4, None, "a"),
    ]
    want = [("a", 3, "gone.py", "removed"), ("a", 3, "moved.py", "structural"), ("a", 3, "new.py", "added"), ("a", 3, "same.py", "cosmetic"), ("a", 4, "new.py", "cosmetic")]
    assert changes(spark, data) == want
    assert changes(spark, data, bits=4) == want
    assert changes(spark, []) == []


def test_snapshots_against_brute_force(spark):
    rnd = random.Random(3)
    data, state = [], {}
    for no in range(1, 5):
        for p in range(60):
            x = rnd.random()
            if x < 0.1:
                state.pop(p, None)
            elif x < 0.4:
                state[p] = (rnd.choice("abc"), rnd.choice("st"))
        data += [fp("r", no, f"f{p}.py", s, t) for p, (s, t) in state.items()]
        if no > 1:
            want = {(p, "added") for p in state.keys() - before.keys()} | {(p, "removed") for p in before.keys() - state.keys()}
            want |= {(p, "structural" if state[p][1] != before[p][1] else "cosmetic") for p in state.keys() & before.keys() if state[p][0] != before[p][0]}
            expected[no] = want
        else:
            expected = {}
        before = dict(state)
    got = changes(spark, data)
    assert {(no, int(p[1:-3]), c) for _, no, p, c in got} == {(no, p, c) for no, s in expected.items() for p, c in s}


def test_orphans(spark):
    t1, t2 = T0 + timedelta(days=1), T0 + timedelta(days=2)
    n = [node("a"), node("b", until=t1), node("b", since=t2), node("late", since=t2), node("c"), node("child"), node("grand"), node(None), node("  ")]
    e = [
        edge("1", "a", " b ", at=T0), edge("2", "a", "b", at=t1), edge("3", "a", "late", at=t1), edge("4", "ghost", "child", "Contain", at=t1), edge("4", "ghost", "child", "Contain", at=t1, loaded=t2), edge("5", "child", "grand", "contains", at=t1),
        edge("6", "c", "grand", at=t1), edge("7", None, "", at=t1), edge("8", "x", "a", at=None), edge("9", "grand", "child", "CONTAINS", at=t1),
    ]
    args = tables(spark, n, e)
    args = (args[1], args[0], args[2])
    direct = {(r["edge_id"], r["side"], r["kind"]) for r in orphan_cascade(*args).where("relation = 'direct'").collect()}
    assert direct == {("2", "target", "deleted"), ("3", "target", "late"), ("4", "source", "missing"), ("8", "source", "missing"), ("8", "target", "late")}
    everything = orphan_cascade(*args)
    inherited = {(r["edge_id"], r["side"], r["hops"]) for r in everything.where("relation = 'inherited'").collect()}
    assert inherited == {("4", "target", 1), ("5", "source", 1), ("5", "target", 2), ("6", "target", 2), ("9", "source", 2), ("9", "target", 1)}
    report = {(r["reference"], r["month"]): r["direct"] for r in orphan_report(everything).collect()}
    assert report[("edges.source", "2024-01")] == 1
    empty = tables(spark)
    assert orphan_cascade(empty[1], empty[0], empty[2]).count() == 0
    assert orphan_cascade(args[0], empty[0], empty[2]).where("relation = 'direct'").count() == 16


def brute_hierarchy(pairs):
    up = {}
    for p, c in pairs:
        for x in (p, c):
            if x:
                up.setdefault(x, None)
        if c and p:
            up[c] = min(up[c], p) if up[c] else p
    out = {}
    for x in up:
        seen, at = [], x
        while at not in seen and up[at] is not None:
            seen.append(at)
            at = up[at]
        out[x] = (at, len(seen)) if up[at] is None else (min(seen[seen.index(at) :]), -1)
    return out


def test_hierarchy_against_brute_force(spark):
    rnd = random.Random(1)
    for case in range(3):
        n = 60
        pairs = [(f"n{rnd.randrange(n) if case else i - 1}", f"n{i}") for i in range(1, n) if rnd.random() < 0.95]
        pairs += [(None, "lonely"), ("top", None), ("self", "self"), ("self", "below"), *pairs[:3]]
        df = spark.createDataFrame(pairs, "parent string, child string")
        got = {r["node_id"]: (r["root_id"], r["depth"]) for r in hierarchy(df).collect()}
        assert got == brute_hierarchy(pairs)
        paths = hierarchy(df, with_paths=True)
        for r in paths.where("depth >= 0").collect():
            assert r["path"][0] == r["root_id"] and r["path"][-1] == r["node_id"] and len(r["path"]) == r["depth"] + 1
        assert descendants(paths).count() == sum(max(0, d) for _, d in got.values())
    assert hierarchy(spark.createDataFrame([], "parent string, child string")).count() == 0


def test_balanced_groups(spark):
    rnd = random.Random(2)
    data = []
    for i in range(3000):
        hot = rnd.random() < 0.4
        data.append((f"e{i}", " hub\\x" if hot else f"t{rnd.randrange(20)}", rnd.choice(["calls", "Call", "uses"]), rnd.choice([None, *(f"s{k}" for k in range(30))]), rnd.choice([None, 0.5, 2.0]), T0))
    data += [(i, t, k, s, 0.0, T0 - timedelta(days=1)) for i, t, k, s, c, _ in data[:500] if c is not None]
    df = spark.createDataFrame(data, "id string, target string, type string, source string, confidence double, loaded_at timestamp_ntz").withColumn("k1", F.lit(1)).withColumn("src", F.lit("clash"))
    clamp = F.when(F.col("confidence").isNotNull(), F.least("confidence", F.lit(1.0)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["target"], r["type"]): (r["n_edges"], r["n_sources"], r["mean_confidence"]) for r in balanced_group_stats(df, [clean_id(F.col("target")).alias("target"), edge_type(F.col("type")).alias("type")], F.col("source"), F.col("id"), clamp, F.col("loaded_at")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want: dict = {}
    for i, t, k, s, c, at in data[:3000]:
        key = (t.strip().replace("\\", "/"), {"calls": "calls", "Call": "calls", "uses": "depends_on"}[k])
        w = want.setdefault(key, [0, set(), []])
        w[0] += 1
        w[1] |= {s} - {None}
        w[2] += [min(c, 1.0)] if c is not None else []
    assert got == {k: (n, len(s), round(sum(c) / len(c), 6) if c else None) for k, (n, s, c) in want.items()}
    assert balanced_group_stats(df.limit(0), [F.col("target"), F.col("type")], F.col("source"), F.col("id"), F.col("confidence"), F.col("loaded_at")).count() == 0


def test_null_keys(spark):
    df = spark.createDataFrame([("1", None, None, None, None, None), ("1", None, None, None, None, datetime(2024, 1, 1))], "id string, target string, type string, source string, confidence double, loaded_at timestamp_ntz")
    r = balanced_group_stats(df, [F.col("target"), F.col("type")], F.col("source"), F.col("id"), F.col("confidence"), F.col("loaded_at")).collect()
    assert [(x["target"], x["type"], x["n_edges"], x["n_sources"], x["mean_confidence"]) for x in r] == [(None, None, 1, 0, None)]


def _deliveries(spark):
    r = random.Random(3)
    rows = [("g", v, f"p{i}", f"h{i}{'x' if v == 2 and i % 40 == 0 else ''}", "s", "s", "s", "s", T0) for v in (1, 2, 3) for i in range(300) if not (v == 3 and i == 7)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "repo_id string, snapshot_no int, file_path string, sha256 string, structural_hash string, symbols_hash string, imports_hash string, calls_hash string, loaded_at timestamp_ntz")


def test_changes_are_the_same_at_any_leaf_width(spark):
    df, key = _deliveries(spark), F.col("file_path")
    want = {(2, f"p{i}", "cosmetic") for i in range(0, 300, 40)} | {(3, f"p{i}", "cosmetic") for i in range(0, 300, 40)} | {(3, "p7", "removed")}
    for bits in (1, 6, 10, 32, 60):
        assert {(r["snapshot_no"], r["file_path"], r["change"]) for r in snapshot_changes(df, key, bits=bits).collect()} == want, bits
    leaves = leaf_digests(df.where("snapshot_no < 3"), key, 6).unionByName(leaf_digests(df.where("snapshot_no = 3"), key, 6))
    assert {(r["snapshot_no"], r["file_path"], r["change"]) for r in snapshot_changes(df, key, bits=6, leaves=leaves).collect()} == want


def test_a_key_has_one_state_per_partition(spark):
    df = spark.range(60_000).selectExpr("'hot' as target", "'t' as type", "cast(id % 1000 as string) as source", "cast(id as string) as id", "0.5D as confidence", "timestamp_ntz'2024-01-01' as at")
    flat = df.select(*hashed("k", F.col("target")), F.xxhash64("source").alias("s1"), F.xxhash64(F.lit(1), "source").alias("s2"), F.xxhash64("id").alias("e1"), F.col("confidence").alias("conf"), "target", "type")
    states = flat.repartitionByRange(3, "k1", "k2", "s1", "s2", "e1").sortWithinPartitions("k1", "k2", "s1", "s2", "e1").mapInArrow(portable(_partial_states), _PARTIAL)  # several Arrow batches to a partition
    assert states.groupBy("piece_part").count().where("count > 1").count() == 0
    assert [(r["n_edges"], r["n_sources"]) for r in stitch(states).collect()] == [(60_000, 1000)]


def test_keys_that_end_within_a_later_batch(spark):
    r = random.Random(5)
    data = [(str(i), f"t{min(r.randrange(9), r.randrange(9))}", "calls", f"s{r.randrange(5)}") for i in range(400)]
    df = spark.createDataFrame(data, "id string, target string, type string, source string").withColumns({"conf": F.lit(0.5), "at": F.lit(None).cast("timestamp_ntz")})
    want = {t: (sum(x[1] == t for x in data), len({x[3] for x in data if x[1] == t}), 0.5) for t in {x[1] for x in data}}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 7, 50):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            got = balanced_group_stats(df, [F.col("target"), F.col("type")], F.col("source"), F.col("id"), F.col("conf"), F.col("at")).collect()
            assert {x["target"]: (x["n_edges"], x["n_sources"], x["mean_confidence"]) for x in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
