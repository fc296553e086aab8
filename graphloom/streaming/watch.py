"""A graph that follows a stream of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.keys import clean_id, edge_type
from graphloom.sources.tables import apply_files

FILE_SCHEMA = "file_path string, repo_id string, batch_no int, modification_time timestamp_ntz, length bigint, content binary, loaded_at timestamp_ntz"


def follow_files(spark: SparkSession, source: str, graph: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Apply each micro-batch of delivered source files (Parquet) to the graph in a folder.

    A micro-batch is what arrived since the last one, so it debounces by itself. A file with null
    content counts as removed. References are resolved against the stored graph as well, so the
    edges are those of a full build; a batch that is delivered again after a failure changes
    nothing, since its number is stored with the graph. Without `every` what is there is taken and the query ends.
    """

    def step(batch: DataFrame, no: int) -> None:
        files = batch.select("file_path", "repo_id", "content", "loaded_at")
        if files.isEmpty():
            return
        last = files.groupBy("file_path").agg(F.max(F.struct("loaded_at", F.col("content").isNull().alias("gone"))).alias("f"))
        removed = last.where("f.gone").select("file_path")
        apply_files(spark, graph, files.join(removed, "file_path", "left_anti"), removed, no)

    stream = spark.readStream.schema(FILE_SCHEMA).parquet(source)
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def edge_counts(spark: SparkSession, source: str, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Stream of edges per type and window of their time: redelivered edges once, late ones within the watermark."""
    schema = "id string, type string, source string, target string, confidence double, indexed_at timestamp_ntz, loaded_at timestamp_ntz"
    e = spark.readStream.schema(schema).parquet(source).where(clean_id(F.col("target")).isNotNull()).withColumn("indexed_at", F.col("indexed_at").cast("timestamp"))
    once = e.withWatermark("indexed_at", late).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("indexed_at", window), edge_type(F.col("type")).alias("type")).agg(F.count("*").alias("n"))


def removed_since(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that a later listing lacks; file streams don't tell of deletions."""
    return old.select("file_path").distinct().join(new.select("file_path"), "file_path", "left_anti")
