"""A mixture of sources at target weights."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import cut

BLOCK_TOKENS = 128
SHARD_DOCS = 50_000


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 * seats so far + 1), none beyond its cap.

    Seats are first given up to just below each exact share (which the method never falls short
    of by more than one per party), the rest one by one. Ties go to the earlier party.
    """
    out = [0] * len(weights)
    free = [i for i, w in enumerate(weights) if w > 0]
    left = seats
    while free and left > 0:
        total = sum(weights[i] for i in free)
        full = [i for i in free if weights[i] / total * left >= caps[i] - out[i] + len(free)]
        if not full:
            break
        for i in full:  # its share is beyond its cap in any case
            left -= caps[i] - out[i]
            out[i] = caps[i]
            free.remove(i)
    if free and left > 0:
        total = sum(weights[i] for i in free)
        for i in free:
            out[i] = max(0, min(caps[i], int(weights[i] / total * left) - len(free)))
        left -= sum(out[i] for i in free)
        heap = [(-weights[i] / (2 * out[i] + 1), i) for i in free if out[i] < caps[i]]
        heapq.heapify(heap)
        while heap and left > 0:
            _, i = heapq.heappop(heap)
            out[i] += 1
            left -= 1
            if out[i] < caps[i]:
                heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def shard_quotas(shards: DataFrame, goals: DataFrame, block_tokens: int) -> DataFrame:
    """Each source's blocks given to its shards by Sainte-Lague, without a row on the driver.

    `shards` has source, shard and t (tokens), `goals` source, blocks and repeats. With n shards of
    mean share q the divisor that fills all seats differs from the plain one by at most n/2 seats
    in all, so a shard of share s gets s give or take 1 + s / 2q seats. Only the seats in that
    range have to be ranked by their quotients; the seats below it are certain.
    """
    s = shards.join(F.broadcast(goals), "source")  # a row per source
    w = Window.partitionBy("source")
    s = s.withColumn("share", F.col("t") / F.sum("t").over(w) * F.col("blocks")).withColumn("cap", F.floor(F.col("t") * F.col("repeats") / block_tokens))
    s = s.withColumn("reach", F.ceil(F.lit(2) + F.col("share") / (F.lit(2) * F.greatest(F.avg("share").over(w), F.lit(1e-9)))))
    s = s.withColumn("sure", F.least(F.col("cap"), F.greatest(F.lit(0), F.floor("share") - F.col("reach"))).cast("bigint"))
    s = s.withColumn("open", F.col("blocks") - F.sum("sure").over(w))
    last = F.least(F.col("cap"), F.floor("share") + F.col("reach") + 1).cast("bigint") - 1
    seats = s.where(last >= F.col("sure")).select("source", "shard", "t", "open", F.explode(F.sequence("sure", last)).alias("seat"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.col("t") / (2 * F.col("seat") + 1)), "shard"))
    won = seats.withColumn("rank", rank).where("rank <= open").groupBy("source", "shard").agg(F.count("*").alias("won"))
    q = (F.col("sure") + F.coalesce("won", F.lit(0))) * block_tokens
    return s.join(won, ["source", "shard"], "left").select("source", "shard", F.floor(q / F.col("t")).alias("rounds"), (q % F.col("t")).alias("rest"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, DataFrame]:
    """Choose how often each document occurs so that each source has its share of all tokens.

    `docs` has doc_id, source and n_tokens, `targets` source, target_weight and max_repeats. The
    total is given in blocks of equal tokens to sources by Sainte-Lague's highest quotients, each
    source's blocks likewise to its shards (documents by a seeded hash; about shard_docs each), so
    a source that holds most documents is worked on in many tasks. In a shard documents stand in
    seeded order; the blocks of a quota are whole rounds of the shard and the first blocks of one
    more round. A document belongs to the block it begins in, so a quota is missed by less than
    one document.

    Without total_tokens the total is the largest at which each source with documents can have
    its share within max_repeats; a larger one leaves the sources at their caps. Weights of
    sources without tokens are given to the others in proportion. Null weights and repeats count
    as 0 and 1. Documents without tokens, without source or of a source without target are not
    taken; the report has them. Of repeated rows of a doc_id one counts. What comes to the driver
    is a row per source: the targets and the sum of its tokens.

    Returns (doc_id, source, n_tokens, times) of the documents taken, and the report.
    """
    spark = docs.sparkSession
    goal = {
        r["source"]: (max(0.0, r["w"] or 0.0), max(0, 1 if r["m"] is None else r["m"]))
        for r in targets.where("source is not null").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("m")).collect()
    }
    once = cut(docs.groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.*"))
    per_source = once.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    wanted = once.where(F.col("source").isin([s for s, (w, m) in goal.items() if w > 0 and m > 0]) & (F.col("n_tokens") > 0))
    sums = {r["source"]: (r["t"], r["n"]) for r in wanted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    n_shards = max(1, -(-sum(n for _, n in sums.values()) // shard_docs))
    placed = wanted.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_shards)).cast("int"))
    names = sorted(sums)
    have = {s: t for s, (t, _) in sums.items()}
    weights = [goal[s][0] for s in names]
    caps = [have[s] * goal[s][1] // block_tokens for s in names]
    if total_tokens is None:
        blocks = int(min((have[s] * goal[s][1] / (goal[s][0] / sum(weights)) for s in names), default=0)) // block_tokens
    else:
        blocks = total_tokens // block_tokens
    given = [(s, b, goal[s][1]) for s, b in zip(names, sainte_lague(weights, blocks, caps))]
    goals = spark.createDataFrame(given, "source string, blocks bigint, repeats bigint")
    quotas = shard_quotas(placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")), goals, block_tokens)
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    block = F.floor(before / block_tokens) * block_tokens
    chosen = (
        placed.withColumn("block", block)
        .join(quotas, ["source", "shard"])
        .select("doc_id", "source", "n_tokens", (F.col("rounds") + (F.col("block") < F.col("rest")).cast("long")).cast("int").alias("times"))
        .where("times > 0")
    )
    chosen = cut(chosen)
    used = chosen.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens_used"), F.max("times").alias("most_repeats"))
    total = used.agg(F.sum("tokens_used")).first()[0] or 0
    aims = spark.createDataFrame([(s, w, m) for s, (w, m) in goal.items()], "source string, target_weight double, max_repeats int")
    both = per_source.join(aims, per_source["source"].eqNullSafe(aims["source"]), "full").select(F.coalesce(per_source["source"], aims["source"]).alias("source"), "target_weight", "max_repeats", "n_docs", "tokens")
    report = both.join(used, "source", "left").select(
        "source", "target_weight", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "tokens", "docs_used", "tokens_used", "most_repeats")],
        F.round(F.coalesce("tokens_used", F.lit(0)) / F.lit(max(1, total)), 6).alias("share"),
    )
    return chosen, report
