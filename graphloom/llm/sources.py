"""Source files once each, spread over tasks that have parsing to do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.ingest.lexing import decode
from graphloom.runtime import portable, spread


def deliveries(files: DataFrame, *keep: str) -> DataFrame:
    """Delivered rows that name a file: file_path, arrival, content and more, in enough tasks for parsing.

    Contents are parsed where they lie; what came again is settled afterwards, on the small
    results, by last_of(). So no content is shuffled to find the last delivery of a path.
    """
    return spread(files.where("file_path is not null").select("file_path", F.col("loaded_at").alias("arrival"), "content", *keep))


def arrival_type(files: DataFrame) -> str:
    return dict(files.dtypes)["loaded_at"]


def last_of(results: DataFrame, *fields: str) -> DataFrame:
    """One result per file_path: that of the delivery that arrived last (no arrival is the earliest; at a tie the greatest fields)."""
    last = results.groupBy("file_path").agg(F.max(F.struct("arrival", *fields)).alias("r"))
    return last.select("file_path", *[f"r.{c}" for c in fields])


def text_of(content: bytes | None) -> str | None:
    """Text with line feeds as line ends; None if it is not UTF-8. No content is an empty text."""
    t = decode(content)
    return None if t is None else t.replace("\r\n", "\n").replace("\r", "\n")


def per_file(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str, *columns: str) -> DataFrame:
    """Rows made from the columns of each row, Arrow batches in and out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [r for args in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)) for r in rows(*args)]
            cols = list(zip(*made)) if made else [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

    return df.select(*columns).mapInArrow(portable(work), schema)
