"""Evidence distance, bins and coarsenings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed

Edges = Sequence[tuple[str, float, float]]


def evidence_distance(evidence_end: Column, commit: Column) -> Column:
    """Tokens from the end of the evidence to the answer; null when not positive."""
    distance = commit - evidence_end
    return F.when(distance > 0, distance)


def assign_bin(distance: Column, edges: Edges = fixed.BINS) -> Column:
    """Name of the half-open range holding the distance, null outside all of them."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(edges):
        out = F.when((distance >= lo) & (distance < hi), F.lit(name)).otherwise(out)
    return out


def split_by_bin(
    df: DataFrame, distance: str, edges: Edges = fixed.BINS
) -> tuple[DataFrame, DataFrame]:
    """(rows with their ``bin_id``, quarantined rows outside every bin)."""
    binned = df.withColumn("bin_id", assign_bin(F.col(distance), edges))
    return (
        binned.filter(F.col("bin_id").isNotNull()),
        binned.filter(F.col("bin_id").isNull()),
    )


def bin_table(spark: SparkSession, edges: Edges = fixed.BINS) -> DataFrame:
    """The bin dimension: one row per bin."""
    return spark.createDataFrame(
        [(name, int(lo), int(hi)) for name, lo, hi in edges],
        "bin_id string, lo int, hi int",
    )


def is_known_bin(bin_id: Column, bins: Sequence[str] = fixed.BIN_IDS) -> Column:
    return F.coalesce(bin_id.isin(*bins), F.lit(False))


def require_bins(
    df: DataFrame, column: str = "bin_id", bins: Sequence[str] = fixed.BIN_IDS
) -> DataFrame:
    """Fail on a missing, pooled or unknown bin, so per-bin fits stay per bin."""
    checked = F.when(is_known_bin(F.col(column), bins), F.col(column)).otherwise(
        F.raise_error(
            F.concat(
                F.lit("a per-bin fit needs a single known bin, got "),
                F.coalesce(F.col(column).cast("string"), F.lit("NULL")),
            )
        )
    )
    return df.withColumn(column, checked)


def coarsen_density(density: Column) -> Column:
    out = F.lit(fixed.DENSITY_TOP)
    for name, below in reversed(fixed.DENSITY_CUTS):
        out = F.when(density < below, F.lit(name)).otherwise(out)
    return out


def coarsen_length(n_tokens: Column) -> Column:
    out = F.lit(fixed.LENGTH_TOP)
    for name, up_to in reversed(fixed.LENGTH_CUTS):
        out = F.when(n_tokens <= up_to, F.lit(name)).otherwise(out)
    return out


def stratum_id(template: Column, density_level: Column, length_level: Column) -> Column:
    return F.concat_ws("|", template, density_level, length_level)


def stratum_parts(stratum: Column) -> list[Column]:
    """The three parts again; a third part keeps any further bars it contains."""
    parts = F.split(stratum, r"\|", 3)
    return [
        F.get(parts, F.lit(0)).alias("question_template_id"),
        F.get(parts, F.lit(1)).alias("distractor_density_coarsening"),
        F.get(parts, F.lit(2)).alias("gold_answer_length_coarsening"),
    ]
