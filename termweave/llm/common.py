"""Helpers the operators share: run folders, free column names, Arrow batches of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.session import materialise, scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space of the word rule `[^\x20\x09-\x0D]+`; `bytes.split()` cuts at exactly these.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later stages read to the shared folder and give it back.

    The shuffle files of the write go as soon as it ends; the table itself survives lost executors.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return materialise(df, name)
    finally:
        spark.conf.set(CLEANUP, before)


def discard(table: DataFrame) -> None:
    """Remove a table made by `written` that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not use."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo a divisor: the folds of the held-out rows; 0 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(divisor)), F.lit(0))


def texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The values of a string or binary column as bytes, empty for null, without copying the batch."""
    values = batch.column(column)
    values = values.cast(pa.large_binary()) if values.type != pa.large_binary() else values
    for value in values:
        yield value.as_py() or b""


def in_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold about `limit` bytes; a longer text is a run of its own."""
    for batch in batches:
        sizes = [v or 0 for v in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
