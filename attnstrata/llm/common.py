"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from attnstrata.session import ship_package

#: Texts are worked on in pieces of about so many bytes inside a task.
PIECE_BYTES = 4 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the quarter that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == F.lit(2)


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as strings with 32-bit offsets starting at its own first value."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.string()) if column.type != pa.string() else column


def pieces(batch: pa.RecordBatch, name: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings have about ``limit`` bytes; one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(string_column(batch, name)).fill_null(0))
    ends = np.cumsum(sizes.astype(np.int64))
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def give_back() -> None:
    """Return this process's unused memory: a worker waits for its next task with all it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(function):
    """A function on batches that gives memory back at their end."""

    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        give_back()

    return run


def freed(function):
    """A function on groups that gives memory back after a large one."""

    @functools.wraps(function)
    def run(rows: pa.Table) -> pa.Table:
        out = function(rows)
        if rows.nbytes > PIECE_BYTES:
            give_back()
        return out

    return run


def small_batches(spark: SparkSession) -> None:
    """Send texts to workers ``BATCH_ROWS`` at a time, unless the session has its own number: a batch is held twice by the JVM, outside its
    heap, and once by the worker.
    """
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name) == default:
        spark.conf.set(name, str(BATCH_ROWS))


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` after this package was sent to the workers; memory goes back at the end of each task."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(released(function), schema)


def with_fields(df: DataFrame, *fields: StructField) -> StructType:
    """The schema of a table, plus fields; those of the same name are replaced."""
    names = {f.name.lower() for f in fields}
    return StructType([f for f in df.schema.fields if f.name.lower() not in names] + list(fields))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def replaced(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """A batch with some columns set; others stay as they are."""
    names = [n for n in batch.schema.names if n not in columns]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*arrays, *columns.values()], names=[*names, *columns])


def checked_broadcast(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """A broadcast hint if the table has at most ``max_rows`` rows and its values at most ``max_bytes``; else none."""

    def size(field: StructField) -> Column:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (StringType, BinaryType)):
            size = F.octet_length(column)
        elif isinstance(kind, ArrayType):
            size = 8 * F.size(column)
        else:
            return F.lit(8)
        return F.coalesce(size, F.lit(0)) + 16

    bytes_ = F.sum(functools.reduce(lambda a, b: a + b, map(size, df.schema.fields)))
    rows, total = df.limit(max_rows + 1).agg(F.count("*"), bytes_).first()
    return F.broadcast(df) if rows <= max_rows and (total or 0) <= max_bytes else df


def smallest_hashes(rows: DataFrame, group: str, key: str, count: int) -> DataFrame:
    """The ``count`` rows of each group whose keys have the smallest hashes; few groups, null keys never.

    Groups are counted first. Only rows whose hash lies below a share that four times as many rows are expected to
    meet are ranked, so what is sorted does not grow with the table.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("group_rows"))
    share = F.xxhash64(key).cast("double") / F.lit(2.0**64) + 0.5
    near = rows.join(F.broadcast(sizes), group).where(share * F.col("group_rows") <= 4 * count)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key))
    return near.withColumn("hash_rank", rank).where(F.col("hash_rank") <= count).drop("hash_rank", "group_rows")
