"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(master).appName("graphloom").config("spark.driver.memory", memory)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions)}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one named in spark.checkpoint.dir. Only where that is unset (tests on one
    machine) a temporary folder of this machine is taken.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not sc.master.startswith("local") and not sc.getConf().get("spark.checkpoint.dir", None):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "graphloom-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession, df: DataFrame | None = None, per_core: int = 4, bytes_per_task: int = 32 << 20) -> int:
    """Tasks for a stage that works hard on few bytes (parsing, tokenizing).

    Such a stage must not inherit the few splits of a compressed file. So there are some tasks a
    core, and more where the input, as Spark estimates it, gives each more than bytes_per_task. For a join
    Spark multiplies its sides, so no more than all that the plan reads is taken.
    """
    size = 0
    if df is not None:
        plan = df._jdf.queryExecution().optimizedPlan()
        leaves = plan.collectLeaves()
        of = lambda x: int(str(x.stats().sizeInBytes()))
        size = min(of(plan), sum(of(leaves.apply(i)) for i in range(leaves.size())))
    if size > 1 << 50:  # Spark's guess where nothing is known
        size = 0
    return max(per_core * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_per_task))


def splits(df: DataFrame) -> int | None:
    """Tasks in which a table that is only read and filtered is scanned; None where it comes from a shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return None if "Exchange" in plan or "AdaptiveSparkPlan" in plan else df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """The rows in enough tasks for hard work on each.

    A scan that keeps all cores busy stays as it is: nothing is shuffled. One of fewer splits (a
    few compressed files) is dealt out row by row, so that no key, null or frequent, fills a task.
    """
    n = splits(df)
    if n is not None and n >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(task_count(df.sparkSession, df))


def portable(work, kind: str = "batches"):
    """A function for Python workers that need not find this package by themselves.

    Workers get their path from the environment in which the JVM was started. The function is
    pickled as it is, inside of one that first adds the place of the package here to the path;
    where the package is installed on the workers that place is only a last resort.
    """
    from pyspark import cloudpickle

    blob, root = cloudpickle.dumps(work), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

    def restored():
        import pickle
        import sys

        if root not in sys.path:
            sys.path.append(root)
        return pickle.loads(blob)

    if kind == "batches":

        def run(batches):
            yield from restored()(batches)
    elif kind == "frame":

        def run(pdf):
            return restored()(pdf)
    elif kind == "keyed":

        def run(key, pdf):
            return restored()(key, pdf)
    else:

        def run(a, b):
            return restored()(a, b)

    restored.__module__ = run.__module__ = "__main__"  # pickled by value
    if kind == "series":
        import pandas as pd

        run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return run
