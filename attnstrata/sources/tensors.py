"""Tensor tables: long Parquet tables with provenance in a small header table.

Features, head edges and feature summaries are stored as float and partitioned by the
first two characters of the event id, so one event's rows are found by directory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed

ATOMIC_SCHEMA = "event_id string, rel_pos int, layer int, head int, " + ", ".join(
    f"{f} float" for f in fixed.FEATURES
)
EDGE_SCHEMA = (
    "event_id string, lookback_j int, layer int, edge_type string, h_i int, h_j int, dist float"
)
SUMMARY_SCHEMA = (
    "event_id string, layer int, head int, feature string, "
    "mean float, p10 float, p50 float, p90 float, std float"
)
HEADER_SCHEMA = (
    "table_name string, schema_version string, manifest_sha256 string, code_commit_sha string, "
    "tensor_shape array<int>, tensor_dtype string, k_grass int, k_attn int, "
    "lookback_window_length int, forman_ricci_convention string, write_timestamp_utc string"
)


class StaleTensorError(Exception):
    """The table was made from another dataset."""


class TensorSchemaError(Exception):
    """Shape, type or header do not match."""


class ConfigDriftError(Exception):
    """The table was made with other study-wide parameters."""


def id_prefix(event_id: Column) -> Column:
    return F.substring(event_id, 1, 2)


def downcast(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles become floats at the storage boundary."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def _double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]


def require_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric input must be double before it is stored."""
    wrong = [c for c in columns if df.schema[c].dataType.simpleString() != "double"]
    if wrong:
        raise TypeError(f"expected double columns, got others for {wrong}")
    return df


def _write(df: DataFrame, path: str, schema: str, files_per_prefix: int = 8) -> None:
    """One directory per id prefix with a fixed number of files in each, whatever the
    number of tasks; an event's rows lie in one file. A column of the stored schema that is
    missing here would be read back as null, so it is an error.
    """
    missing = [f.split()[0] for f in schema.split(", ") if f.split()[0] not in df.columns]
    if missing:
        raise TensorSchemaError(f"columns missing: {missing}")
    prefixed = downcast(df, _double_columns(df)).withColumn(
        "id_prefix", id_prefix(F.col("event_id"))
    )
    file = F.pmod(F.xxhash64("event_id"), F.lit(files_per_prefix))
    prefixed.repartition("id_prefix", file).write.partitionBy("id_prefix").parquet(path)


def write_atomic(atomic: DataFrame, path: str) -> None:
    _write(require_double(atomic, fixed.FEATURES), path, ATOMIC_SCHEMA)


def write_head_edges(edges: DataFrame, path: str) -> None:
    """Only rows with h_i < h_j; the matrix is symmetric with a zero diagonal."""
    _write(require_double(edges, ["dist"]).filter(F.col("h_i") < F.col("h_j")), path, EDGE_SCHEMA)


def write_atomic_summary(summary: DataFrame, path: str) -> None:
    _write(require_double(summary, ["mean", "p10", "p50", "p90", "std"]), path, SUMMARY_SCHEMA)


def _read(spark: SparkSession, path: str, schema: str, event_ids: Sequence[str] | None) -> DataFrame:
    df = spark.read.schema(schema + ", id_prefix string").parquet(path)
    if event_ids is not None:
        df = df.filter(
            F.col("id_prefix").isin(*sorted({e[:2] for e in event_ids}))
            & F.col("event_id").isin(*event_ids)
        )
    return df.drop("id_prefix")


def read_atomic(spark: SparkSession, path: str, event_ids=None) -> DataFrame:
    return _read(spark, path, ATOMIC_SCHEMA, event_ids)


def read_head_edges(spark: SparkSession, path: str, event_ids=None) -> DataFrame:
    return _read(spark, path, EDGE_SCHEMA, event_ids)


def read_atomic_summary(spark: SparkSession, path: str, event_ids=None) -> DataFrame:
    return _read(spark, path, SUMMARY_SCHEMA, event_ids)


def provenance(
    spark: SparkSession,
    table_name: str,
    *,
    manifest_sha256: str,
    code_commit_sha: str,
    tensor_shape: Sequence[int],
    k_attn: int,
    k_grass: int = 8,
    lookback_window_length: int = fixed.DENSE_LOOKBACK,
    forman_ricci_convention: str = "nan_with_median_imputation_and_indicator",
    schema_version: str = "1",
) -> DataFrame:
    """The header row to store next to a tensor table."""
    row = (
        table_name,
        schema_version,
        manifest_sha256,
        code_commit_sha,
        list(tensor_shape),
        "float32",
        k_grass,
        k_attn,
        lookback_window_length,
        forman_ricci_convention,
        None,
    )
    return spark.createDataFrame([row], HEADER_SCHEMA).withColumn(
        "write_timestamp_utc",
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )


def with_provenance(df: DataFrame, header: DataFrame, table_name: str) -> DataFrame:
    """Tensor rows with the digest and parameters they were made under."""
    one = header.filter(F.col("table_name") == table_name)
    return df.withColumns(
        {
            c: one.select(c).scalar()
            for c in ("manifest_sha256", "k_attn", "k_grass", "lookback_window_length")
        }
    )


def rows_per_event(df: DataFrame) -> DataFrame:
    return df.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_rows"))


def check_provenance(
    df: DataFrame,
    header: DataFrame,
    *,
    table_name: str,
    expected_digest: str,
    rows_expected: int | None = None,
    **parameters,
) -> DataFrame:
    """Return the table if its header fits, otherwise raise.

    A different dataset digest, a study parameter that drifted, or an event with the
    wrong number of rows are errors, never a silent fallback.
    """
    found = header.filter(F.col("table_name") == table_name).limit(2).collect()
    if len(found) != 1:
        raise TensorSchemaError(f"{table_name}: expected one header row, found {len(found)}")
    row = found[0].asDict()
    if row["manifest_sha256"] != expected_digest:
        raise StaleTensorError(
            f"{table_name}: made from {row['manifest_sha256']}, expected {expected_digest}"
        )
    drift = {k: (row[k], v) for k, v in parameters.items() if row[k] != v}
    if drift:
        raise ConfigDriftError(f"{table_name}: parameters differ: {drift}")
    if rows_expected is not None:
        wrong = rows_per_event(df).filter(F.col("n_rows") != rows_expected).limit(5).collect()
        if wrong:
            raise TensorSchemaError(
                f"{table_name}: events without {rows_expected} rows: "
                f"{[(r['event_id'], r['n_rows']) for r in wrong]}"
            )
    return df
