"""The event dataset on disk: an index table, a text table and a one-row header.

Long text lives in its own table, so scanning the index never reads it. Both tables
are pinned by content digests in the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.functions.ids import dataset_digest

INDEX_COLUMNS = tuple(
    sorted(c for c, _ in fixed.EVENT_COLUMNS if c not in fixed.TEXT_COLUMNS)
)
TEXT_TABLE_COLUMNS = (
    "document",
    "event_id",
    "gold_answer",
    "model_generation_raw",
    "question",
)
_TYPES = dict(fixed.EVENT_COLUMNS) | {"model_generation_raw": "string"}


class DatasetIntegrityError(Exception):
    """A table's content does not match the digest in the header."""


class DatasetSchemaError(Exception):
    """The header lacks a required field."""


def _schema(columns) -> str:
    return ", ".join(f"{c} {_TYPES[c]}" for c in columns)


def event_index(events: DataFrame) -> DataFrame:
    """The events without their long text, columns in name order."""
    return events.select(*[c for c in sorted(events.columns) if c not in fixed.TEXT_COLUMNS])


def event_text(events: DataFrame) -> DataFrame:
    return events.select(
        "document",
        "event_id",
        "gold_answer",
        F.col("model_generation").alias("model_generation_raw"),
        "question",
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", *, sort_by: str | None = None) -> None:
    """Write a table; ``sort_by`` orders rows over all files (range partitioned)."""
    out = df.orderBy(sort_by) if sort_by else df
    out.write.format(fmt).save(path)


def write_event_index(
    events: DataFrame, path: str, fmt: str = "parquet", *, sort_by: str | None = None
) -> None:
    write_table(event_index(events), path, fmt, sort_by=sort_by)


def write_event_text(
    events: DataFrame, path: str, fmt: str = "parquet", *, sort_by: str | None = None
) -> None:
    write_table(event_text(events), path, fmt, sort_by=sort_by)


def read_event_index(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(_schema(INDEX_COLUMNS)).load(path)


def read_event_text(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(_schema(TEXT_TABLE_COLUMNS)).load(path)


def write_header(header: DataFrame, path: str) -> None:
    """The one-row header as JSON, keys in name order, nulls written out."""
    header.select(*sorted(header.columns)).coalesce(1).write.option(
        "ignoreNullFields", "false"
    ).json(path)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """The header with its fixed schema; a missing field is an error naming it."""
    schema = ", ".join(f"{c} {t}" for c, t in fixed.HEADER_COLUMNS)
    lines = spark.read.text(path)
    wanted = F.array(*[F.lit(c) for c, _ in fixed.HEADER_COLUMNS])
    present = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    lost = lines.select(F.explode(F.array_except(wanted, present)).alias("k")).distinct()
    missing = sorted(r["k"] for r in lost.collect())  # the schema's fields at most
    if lines.isEmpty():
        missing = sorted(c for c, _ in fixed.HEADER_COLUMNS)
    if missing:
        raise DatasetSchemaError(f"header lacks fields: {missing}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def join_event_text(index: DataFrame, text: DataFrame, order: Column | None = None) -> DataFrame:
    """Events rebuilt from both tables: text is optional and becomes empty strings.

    Of repeated text rows for one id the last one wins, by ``order`` where given and
    otherwise by the row text itself, which keeps the result repeatable.
    """
    columns = ["document", "question", "gold_answer", "model_generation_raw"]
    rank = F.struct(*columns) if order is None else order
    last = text.groupBy("event_id").agg(
        F.max_by(F.struct(*columns), rank).alias("_text")
    )
    joined = index.join(last, "event_id", "left")
    for c in columns:
        name = "model_generation" if c == "model_generation_raw" else c
        joined = joined.withColumn(name, F.coalesce(F.col(f"_text.{c}"), F.lit("")))
    return joined.drop("_text")


def write_dataset(events: DataFrame, header: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write text, index and header; returns the header with both digests filled in.

    Digests are taken from the written tables, so they describe what is on disk.
    """
    spark = events.sparkSession
    write_event_text(events, f"{path}/text", fmt)
    write_event_index(events, f"{path}/index", fmt)
    text_digest = dataset_digest(read_event_text(spark, f"{path}/text", fmt)).first()["digest"]
    index_digest = dataset_digest(read_event_index(spark, f"{path}/index", fmt)).first()["digest"]
    final = header.withColumns(
        {"events_sha256": F.lit(text_digest), "manifest_sha256": F.lit(index_digest)}
    )
    write_header(final, f"{path}/header")
    return final


def read_dataset(
    spark: SparkSession, path: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """(header, events) after checking both digests."""
    header = read_header(spark, f"{path}/header")
    expected = header.first()
    index = read_event_index(spark, f"{path}/index", fmt)
    text = read_event_text(spark, f"{path}/text", fmt)
    for name, table, field in (("text", text, "events_sha256"), ("index", index, "manifest_sha256")):
        found = dataset_digest(table).first()["digest"]
        if found != expected[field]:
            raise DatasetIntegrityError(
                f"{name} table in {path}: header says {expected[field]}, content gives {found}"
            )
    events = join_event_text(index, text).select(*[c for c, _ in fixed.EVENT_COLUMNS])
    return header, events
