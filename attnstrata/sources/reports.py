"""Report tables as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.operators.compare import known_bins_only, marginal_gain_summary
from attnstrata.operators.composite import auroc_report
from attnstrata.operators.matching import handcheck_sample

AUROC_SCHEMA = (
    "bin_id string, auroc double, auroc_ci_lower double, auroc_ci_upper double, "
    "n_events_train bigint, n_events_held_out bigint"
)


def write_report(df: DataFrame, path: str) -> None:
    """Any small result table, one file, keys in name order, nulls written out."""
    df.select(*sorted(df.columns)).coalesce(1).write.option("ignoreNullFields", "false").json(path)


def write_auroc_report(fits: DataFrame, path: str) -> None:
    write_report(auroc_report(fits), path)


def read_auroc_report(
    spark: SparkSession, path: str, bins: Sequence[str] = fixed.BIN_IDS
) -> DataFrame:
    """Known bins only."""
    return known_bins_only(spark.read.schema(AUROC_SCHEMA).json(path), bins)


def write_yield_report(yields: DataFrame, path: str) -> None:
    write_report(yields, path)


def handcheck_table(events: DataFrame, size: int = 50, **options) -> DataFrame:
    """A sample to be judged by hand, with an empty column for the judgment."""
    return handcheck_sample(events, size, **options).select(
        "event_id",
        "bin_id",
        "question",
        "gold_answer",
        "model_generation",
        F.col("is_fail").alias("is_fail_automated"),
        F.lit(None).cast("string").alias("human_judgment"),
    )


def write_handcheck_sample(events: DataFrame, path: str, size: int = 50, **options) -> None:
    write_report(handcheck_table(events, size, **options), path)


def write_beta_functions(fits: DataFrame, path: str) -> None:
    """One directory per (bin, edge type)."""
    fits.write.partitionBy("bin_id", "edge_type").json(path)


def sweep_report(gains: DataFrame, winner: DataFrame) -> DataFrame:
    """One row: the winner, the median gain per k and every gain per (k, bin)."""
    medians = gains.groupBy("k").agg(F.percentile("gain", 0.5).alias("m"))
    per_k = medians.agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("k").cast("string"), "m")))
        ).alias("x")
    )
    per_bin = (
        gains.groupBy("k")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin_id", "gain")))).alias("g")
        )
        .agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct(F.col("k").cast("string"), F.to_json("g"))))
            ).alias("x")
        )
    )
    return winner.select("winner_k_attn").withColumns(
        {
            "median_marginal_gain_per_k": per_k.scalar(),
            "per_bin_marginal_gain": per_bin.scalar(),
        }
    )


def marginal_gain_report(gains: DataFrame, key: str = "bin_id") -> DataFrame:
    """One row: the gain of every bin under ``per_bin``, and the summary over them."""
    values = F.struct(*[c for c in gains.columns if c != key])
    per_bin = gains.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, values.alias("v"))))).alias("m")
    )
    return marginal_gain_summary(gains).withColumn("per_bin", per_bin.scalar())


def write_marginal_gain_report(gains: DataFrame, path: str) -> None:
    write_report(marginal_gain_report(gains), path)


def long_lines_report(alarms: DataFrame) -> DataFrame:
    """One row a head: its name, ``L<layer>_H<head>`` of two digits each, and its first alarms."""
    name = F.format_string("L%02d_H%02d", F.col("layer").cast("int"), F.col("head").cast("int"))
    return alarms.groupBy(name.alias("line")).agg(
        F.array_sort(F.collect_list("first_alarm_idx")).alias("first_alarms")
    )


def write_long_lines_report(alarms: DataFrame, path: str) -> None:
    write_report(long_lines_report(alarms), path)


def write_reproducibility_report(check: DataFrame, path: str) -> None:
    write_report(check, path)


def read_sweep_winner(spark: SparkSession, path: str) -> DataFrame:
    """The winning k; a report without one is an error."""
    df = spark.read.schema("winner_k_attn int").json(path)
    return df.withColumn(
        "winner_k_attn",
        F.coalesce("winner_k_attn", F.raise_error(F.lit("the report names no winner")).cast("int")),
    )
