"""Per-key results in balanced work although a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import hashed
from graphloom.runtime import portable

_SORT = ["k1", "k2", "s1", "s2", "e1"]
_PARTIAL = "piece_part int, k1 bigint, k2 bigint, target string, type string, n bigint, n_conf bigint, sum_conf double, n_src bigint, first1 bigint, first2 bigint, last1 bigint, last2 bigint"


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of runs of equal keys in one sorted partition, a few vector operations per batch.

    The row before a batch and the state of the key that is still open are carried over, so a
    partition gives one state per key. A source that goes on in the next partition is for
    stitch() to settle.
    """
    part = TaskContext.get().partitionId()
    before = None
    pending: list | None = None  # one row of the output
    names = ["piece_part", "k1", "k2", "target", "type", "n", "n_conf", "sum_conf", "n_src", "first1", "first2", "last1", "last2"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 5]
    single = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _SORT]
        new = []
        for i, c in enumerate(cols):
            d = np.empty(n, bool)
            d[1:] = c[1:] != c[:-1]
            d[0] = before is None or c[0] != before[i]
            new.append(d)
        before = [c[-1] for c in cols]
        new_key = new[0] | new[1]
        new_src = new_key | new[2] | new[3]
        new_rec = new_src | new[4]
        new_src &= (cols[2] != 0) | (cols[3] != 0)  # a null source has zeros
        conf = b.column(b.schema.get_field_index("conf")).to_numpy(zero_copy_only=False).astype(float)
        has = new_rec & ~np.isnan(conf)
        start = new_key.copy()
        start[0] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], n) - 1
        add = lambda x, kind: np.add.reduceat(x.astype(kind), at)
        take = pa.array(at)
        label = [b.column(b.schema.get_field_index(c)).take(take) for c in ("target", "type")]
        out = [
            np.full(len(at), part, np.int32), cols[0][at], cols[1][at], *label, add(new_rec, np.int64), add(has, np.int64), add(np.where(has, conf, 0.0), float), add(new_src, np.int64),
            cols[2][at], cols[3][at], cols[2][end], cols[3][end],
        ]
        row = lambda i: [c[i].as_py() if isinstance(c, pa.Array) else c[i] for c in out]
        first = 0
        if pending is not None:
            if new_key[0]:
                yield single(pending)
            else:  # the open key goes on
                head = row(0)
                pending[5:9] = [x + y for x, y in zip(pending[5:9], head[5:9])]
                pending[11:] = head[11:]
                first = 1
                if len(at) > 1:  # and ends in this batch
                    yield single(pending)
        if first < len(at):
            if len(at) - 1 > first:
                yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c))[first:-1].cast(t) for c, t in zip(out, kinds)], names=names)
            pending = row(len(at) - 1)
    if pending is not None:
        yield single(pending)


def stitch(partial: DataFrame) -> DataFrame:
    """Join the partial states of a key in the order of its pieces.

    A key has at most one state per partition. A source that ends one partition and begins the
    next was counted twice and is taken off once.
    """
    w = Window.partitionBy("k1", "k2").orderBy("piece_part")
    goes_on = (F.lag("last1").over(w) == F.col("first1")) & (F.lag("last2").over(w) == F.col("first2"))
    goes_on = goes_on & ((F.col("first1") != 0) | (F.col("first2") != 0))
    return (
        partial.withColumn("twice", F.when(goes_on, 1).otherwise(0))
        .groupBy("k1", "k2")
        .agg(
            F.first("target").alias("target"), F.first("type").alias("type"), F.sum("n").alias("n_edges"), (F.sum("n_src") - F.sum("twice")).alias("n_sources"),
            F.sum("n_conf").alias("n_conf"), F.sum("sum_conf").alias("sum_conf"),
        )
    )


def balanced_group_stats(records: DataFrame, key: list[Column], source: Column, record_id: Column, measure: Column, arrival: Column) -> DataFrame:
    """Number of records, of distinct sources and the mean measure per key.

    Rows are range partitioned on (key, source, record) at quantiles that Spark samples. A heavy
    key therefore covers many partitions and each gets about as many rows; within a partition the
    rows are sorted and partial states of each key are taken in one pass; stitch() joins the
    states at partition boundaries. No task ever holds a key's rows together.

    `key` has the columns named target and type. Rows with the same record id are one record: the
    row that arrived last gives the measure (a null arrival is the earliest). A null source is one
    source that is not counted; null measures are left out of the mean, which is null without any.
    A null key is a key. An empty table gives no rows.
    """
    null = F.lit("\0null")
    flat = records.select(*key, source.alias("src"), record_id.alias("rid"), measure.cast("double").alias("conf"), arrival.alias("at"))
    k = [F.coalesce(F.col("target"), null), F.coalesce(F.col("type"), null)]
    src = [F.when(F.col("src").isNull(), F.lit(0)).otherwise(h).cast("bigint").alias(f"s{i}") for i, h in enumerate((F.xxhash64("src"), F.xxhash64(F.lit(1), "src")), 1)]
    keyed = flat.select(*hashed("k", *k), *src, F.xxhash64("rid").alias("e1"), "conf", "at", "target", "type")
    sorted_rows = keyed.repartitionByRange(*_SORT).sortWithinPartitions(*_SORT, F.col("at").desc_nulls_last(), F.col("conf").desc_nulls_last()).drop("at")
    done = stitch(sorted_rows.mapInArrow(portable(_partial_states), _PARTIAL))
    return done.select("target", "type", "n_edges", "n_sources", F.when(F.col("n_conf") > 0, F.round(F.col("sum_conf") / F.col("n_conf"), 6)).alias("mean_confidence"))
