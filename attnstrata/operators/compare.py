"""Comparing result sets: gains, sweeps, verdicts, overlaps, reproducibility."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnstrata.functions import bins as binning
from attnstrata.functions import fixed_values as fixed
from attnstrata.functions import ids
from attnstrata.operators.composite import fit_composite
from attnstrata.operators.graph import nested_curvature
from attnstrata.operators.positions import key_join
from attnstrata.session import materialize


def marginal_gain(base: DataFrame, augmented: DataFrame, key: str = "bin_id") -> DataFrame:
    """Per bin in both reports: gain in AUROC, its worst-case interval and a flag."""
    b = base.select(
        key,
        F.col("auroc").alias("spectral_auroc"),
        F.col("auroc_ci_lower").alias("_lo"),
        F.col("auroc_ci_upper").alias("_hi"),
    )
    a = augmented.select(
        key,
        F.col("auroc").alias("augmented_auroc"),
        F.col("auroc_ci_lower").alias("_alo"),
        F.col("auroc_ci_upper").alias("_ahi"),
    )
    delta = F.col("augmented_auroc") - F.col("spectral_auroc")
    return b.join(a, key).select(
        key,
        delta.alias("delta_auroc"),
        (F.col("_alo") - F.col("_hi")).alias("ci_lower_approx"),
        (F.col("_ahi") - F.col("_lo")).alias("ci_upper_approx"),
        (delta >= fixed.MARGINAL_GAIN).alias("is_significant_at_02"),
        "spectral_auroc",
        "augmented_auroc",
    )


def marginal_gain_summary(gains: DataFrame) -> DataFrame:
    """One row: flagged bins, the upper median of the gains, and the verdict."""
    deltas = F.array_sort(F.collect_list("delta_auroc"))
    return gains.agg(
        F.count_if("is_significant_at_02").alias("n_bins_marginal_gain_at_02"),
        F.coalesce(
            F.get(deltas, F.floor(F.size(deltas) / 2).cast("int")), F.lit(float("nan"))
        ).alias("median_delta_auroc"),
        F.lit(fixed.MARGINAL_GAIN).alias("decision_rule_threshold"),
        (F.count_if("is_significant_at_02") >= fixed.MIN_BINS).alias("ricci_load_bearing"),
    )


def sweep_gains(
    bins: DataFrame, base: DataFrame, augmented: DataFrame, key: str = "bin_id"
) -> DataFrame:
    """(k, bin, gain) for every k that has a result and every bin; a bin without both
    results has a null gain. Reports carry a ``k`` column.
    """
    ks = base.select("k").unionByName(augmented.select("k")).distinct()
    all_ks = ks.agg(F.array_sort(F.collect_set("k")).alias("ks")).scalar()
    grid = bins.select(key).withColumn("k", F.explode(all_ks))
    return (
        grid.join(base.select("k", key, F.col("auroc").alias("_base")), ["k", key], "left")
        .join(augmented.select("k", key, F.col("auroc").alias("_aug")), ["k", key], "left")
        .select("k", key, (F.col("_aug") - F.col("_base")).alias("gain"))
    )


def sweep_medians(gains: DataFrame) -> DataFrame:
    """True median of the known gains per k; null where none is known."""
    return gains.groupBy("k").agg(F.percentile("gain", 0.5).alias("median_gain"))


def pick_winner(
    gains: DataFrame, candidates: Sequence[int] = fixed.SWEEP_K
) -> DataFrame:
    """The k with the highest median gain, the first listed among equals; the middle
    candidate where no gain is known at all.
    """
    place = F.array_position(F.array(*[F.lit(k) for k in candidates]), F.col("k"))
    best = sweep_medians(gains).agg(
        F.max_by(
            "k",
            F.struct(F.coalesce("median_gain", F.lit(float("-inf"))), -place),
        ).alias("k"),
        F.max("median_gain").alias("median_gain"),
    )
    return best.select(
        F.when(F.col("median_gain").isNull(), candidates[len(candidates) // 2])
        .otherwise(F.col("k"))
        .cast("int")
        .alias("winner_k_attn"),
        "median_gain",
    )


def k_sweep(
    events: DataFrame,
    base_features: DataFrame,
    attention: DataFrame,
    *,
    graph_keys: Sequence[str] = (),
    features: Sequence[str] = tuple(f for f in fixed.FEATURES if f != fixed.RICCI_FEATURE),
    bins: Sequence[str] = fixed.BIN_IDS,
    replicates: int = 200,
    candidates: Sequence[int] = fixed.SWEEP_K,
    min_rows: int = fixed.MIN_ROWS_PER_FIT,
) -> tuple[DataFrame, DataFrame]:
    """(gains, winner) of adding the curvature of the top-k attention graphs at each k.

    ``events`` has (event_id, bin_id, is_fail), ``base_features`` the named columns per event, ``attention`` (event_id, graph keys, src, dst,
    w). The graphs of all k come from one ranking, an event's curvature is the mean over its graphs, and the fits of all k and bins run
    together: k is part of the group. Events without attention take no part.
    """
    curved = nested_curvature(attention, ["event_id", *graph_keys], candidates)
    curvature = curved.groupBy("event_id", "k").agg(F.avg("forman_ricci").alias(fixed.RICCI_FEATURE))
    joined = materialize(events.join(base_features, "event_id").join(curvature, "event_id"), "sweep")

    def report(names):
        return fit_composite(
            joined, features=names, bins=None, per=["k"], replicates=replicates, min_rows=min_rows
        ).select("k", "bin_id", "auroc")

    names = events.sparkSession.createDataFrame([(b,) for b in bins], "bin_id string")
    gains = sweep_gains(names, report(list(features)), report([*features, fixed.RICCI_FEATURE]))
    return gains, pick_winner(gains, candidates)


def interval_overlap(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("bin_id",)
) -> DataFrame:
    """Whether any interval of ``a`` meets any of ``b`` per key, ends inclusive.

    Both sides hold disjoint intervals (lo, hi) of a key. Sorting the ends of both
    sides together and keeping the highest end seen on the other side answers the
    question without pairing intervals.
    """
    names = list(keys)
    tagged = a.select(*names, "lo", "hi", F.lit(0).alias("_side")).unionByName(
        b.select(*names, "lo", "hi", F.lit(1).alias("_side"))
    )
    before = Window.partitionBy(*names).orderBy("lo", "hi", "_side").rowsBetween(
        Window.unboundedPreceding, -1
    )
    other = F.when(
        F.col("_side") == 0, F.max(F.when(F.col("_side") == 1, F.col("hi"))).over(before)
    ).otherwise(F.max(F.when(F.col("_side") == 0, F.col("hi"))).over(before))
    meets = F.coalesce(other >= F.col("lo"), F.lit(False))
    return tagged.withColumn("_meets", meets).groupBy(*names).agg(
        F.count_if(F.col("_side") == 0).alias("n_a"),
        F.count_if(F.col("_side") == 1).alias("n_b"),
        F.max("_meets").alias("overlap"),
    )


def head_graph_comparison(
    fits: DataFrame, bins: Sequence[str] = fixed.BIN_IDS
) -> DataFrame:
    """Per bin: both head graphs' intervals and whether any two overlap."""
    spark = fits.sparkSession
    iv = F.col("discriminative_depth_intervals")
    per_type = fits.groupBy("bin_id").agg(
        *[
            F.first(F.when(F.col("edge_type") == t, iv), ignorenulls=True).alias(f"{t}_intervals")
            for t in fixed.EDGE_TYPES
        ]
    )
    rows = fits.select("bin_id", "edge_type", F.explode(iv).alias("i")).select(
        "bin_id", "edge_type", "i.lo", "i.hi"
    )
    sides = [rows.filter(F.col("edge_type") == t).drop("edge_type") for t in fixed.EDGE_TYPES]
    names = spark.createDataFrame([(b,) for b in bins], "bin_id string")
    return (
        names.join(per_type, "bin_id", "left")
        .join(interval_overlap(*sides).select("bin_id", "overlap"), "bin_id", "left")
        .withColumn("overlap", F.coalesce("overlap", F.lit(False)))
    )


def per_bin_verdict(report: DataFrame) -> DataFrame:
    """One row: how many bins clear the AUROC targets, and whether enough do."""
    passes = (F.col("auroc") > fixed.AUROC_TARGET) & (
        F.col("auroc_ci_lower") > fixed.AUROC_CI_TARGET
    )
    return report.agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.count_if(passes).alias("n_passing"),
        (F.count_if(passes) >= fixed.MIN_BINS).alias("passes"),
    )


def pooled_verdict(control: DataFrame) -> DataFrame:
    """The control passes when it collapses: low AUROC or an interval reaching down."""
    passes = (F.col("auroc") < fixed.POOLED_AUROC_LIMIT) | (
        F.col("auroc_ci_lower") < fixed.POOLED_CI_LIMIT
    )
    return control.select("auroc", "auroc_ci_lower", "auroc_ci_upper", passes.alias("passes"))


def depth_verdict(fits: DataFrame, bins: Sequence[str] = fixed.BIN_IDS) -> DataFrame:
    """Bins with at least one discriminative depth interval in either head graph."""
    known = fits.filter(F.col("bin_id").isin(*bins))
    has = known.groupBy("bin_id").agg(
        F.sum(F.size("discriminative_depth_intervals")).alias("n_intervals")
    )
    some = F.count_if(F.col("n_intervals") > 0)
    return has.agg(some.alias("n_passing"), (some >= fixed.MIN_BINS).alias("passes"))


def distinct_ids(pool: DataFrame, key: str = "event_id") -> DataFrame:
    return pool.select(key).distinct()


def agreement(
    original: DataFrame, regenerated: DataFrame, *, key: str = "event_id", label: str | None = None
) -> DataFrame:
    """Share of the original ids (and labels, if named) found again; passes at 99 %."""
    columns = [key] if label is None else [key, label]
    first = original.select(*columns).distinct().withColumn("_o", F.lit(1))
    second = regenerated.select(*columns).distinct().withColumn("_r", F.lit(1))
    both = key_join(first, second, columns, "left").agg(
        F.count("_o").alias("n_original_events"), F.count("_r").alias("n_overlap")
    )
    pct = F.when(
        F.col("n_original_events") > 0,
        F.lit(100.0) * F.col("n_overlap") / F.col("n_original_events"),
    ).otherwise(0.0)
    return both.withColumn("agreement_pct", pct).withColumn(
        "passes", F.col("agreement_pct") >= fixed.AGREEMENT_TARGET
    )


def reproducibility_check(
    original: DataFrame,
    regenerated: DataFrame,
    *,
    key: str = "event_id",
    label: str | None = "is_fail",
) -> DataFrame:
    """Id agreement, the number of regenerated ids, and label agreement."""
    found = distinct_ids(regenerated, key).agg(F.count(F.lit(1)).alias("n")).scalar()
    out = agreement(original, regenerated, key=key).withColumn("n_regenerated_event_ids", found)
    if label is None:
        return out
    pct = agreement(original, regenerated, key=key, label=label).select("agreement_pct").scalar()
    return out.withColumn("label_agreement_pct", pct)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns a table lacks, by name."""
    return sorted(set(required) - set(df.columns))


def known_bins_only(report: DataFrame, bins: Sequence[str] = fixed.BIN_IDS) -> DataFrame:
    return report.filter(binning.is_known_bin(F.col("bin_id"), bins))


def id_failures(df: DataFrame, template_sha: Column | str) -> DataFrame:
    """Events whose id does not follow from their text."""
    return df.filter(~F.coalesce(ids.id_matches(template_sha), F.lit(False)))


def found_again(regenerated: DataFrame, original: DataFrame, key: str = "event_id") -> DataFrame:
    """Regenerated rows whose id the original set has."""
    return regenerated.join(original.select(key), key, "left_semi")


def shared_ids(a: DataFrame, b: DataFrame, key: str = "event_id") -> DataFrame:
    """Ids that both sets have, once each."""
    return a.select(key).intersect(b.select(key))


def missing_ids(original: DataFrame, regenerated: DataFrame, key: str = "event_id") -> DataFrame:
    """Ids of the original set that were not found again, once each."""
    return original.select(key).subtract(regenerated.select(key))


def pooled(parts: dict[str, DataFrame], name: str = "part") -> DataFrame:
    """All rows of several tables of the same columns, with the name of the table that each is from; nothing is merged."""
    tables = [df.withColumn(name, F.lit(part)) for part, df in parts.items()]
    return functools.reduce(DataFrame.unionByName, tables)


def largest(df: DataFrame, keys: Sequence[str], value: str, name: str, alias: str = "winner") -> DataFrame:
    """Per key the ``name`` with the largest value, the smallest name among equals."""
    return df.groupBy(*keys).agg(F.max_by(name, F.struct(value, -F.col(name))).alias(alias))
