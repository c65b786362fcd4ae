"""Lookback windows and sequential detectors over long series.

A series of any length is processed in blocks of consecutive positions. Inside a
block the work is a window or an array fold; across blocks only one summary row per
block is combined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.operators.positions import key_join, require_keys, with_position

BLOCK = 65_536


def dense_lookback(
    df: DataFrame, commit: Column, *, length: int = fixed.DENSE_LOOKBACK
) -> DataFrame:
    """Every position of the window ending at the commit token, one row each.

    The window needs ``length - 1`` tokens in front of the commit; rows with a null
    ``position`` mark events where it does not fit.
    """
    fits = commit >= length - 1
    window = F.when(fits, F.sequence(commit - (length - 1), commit))
    return (
        df.withColumn("position", F.explode_outer(window))
        .withColumn("rel_pos", F.col("position") - commit)
    )


def sparse_lookback(
    df: DataFrame, commit: Column, *, offsets: Sequence[int] = fixed.SPARSE_LOOKBACK
) -> DataFrame:
    """The log-spaced positions before the commit token; null where out of range."""
    fits = commit >= max(offsets)
    steps = F.when(fits, F.array(*[F.lit(j) for j in offsets]))
    return df.withColumn("lookback_j", F.explode_outer(steps)).withColumn(
        "position", commit - F.col("lookback_j")
    )


def in_lookback(rel_pos: Column, length: int = fixed.DENSE_LOOKBACK) -> Column:
    """Row filter for tables that already carry a relative position."""
    return rel_pos.between(-(length - 1), 0)


def align_to_commit(
    series: DataFrame,
    commits: DataFrame,
    keys: Sequence[str],
    *,
    offsets: Sequence[int] = fixed.SPARSE_LOOKBACK,
) -> DataFrame:
    """Series values at the log-spaced positions before each key's commit.

    ``series`` has (keys, position, x); ``commits`` has (keys, commit). The small side
    is expanded to its ten positions, so the series is only probed.
    """
    wanted = sparse_lookback(commits, F.col("commit"), offsets=offsets).filter(
        F.col("position").isNotNull()
    )
    return series.join(wanted, [*keys, "position"])


def broadcast_positions(
    vectors: DataFrame, *, length: int = fixed.DENSE_LOOKBACK
) -> DataFrame:
    """Repeat each per-head row over all lookback positions, row by row."""
    return vectors.withColumn(
        "rel_pos", F.explode(F.sequence(F.lit(-(length - 1)), F.lit(0)))
    )


def long_line_series(
    atomic: DataFrame, feature: str, keys: Sequence[str] = ("event_id", "layer", "head")
) -> DataFrame:
    """One array per key: the feature over token positions, in order."""
    return atomic.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rel_pos", feature))), lambda p: p[feature]
        ).alias("curve")
    )


def _placed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, segment, block: int
) -> DataFrame:
    placed = with_position(require_keys(df, keys), keys, order, segment=segment, name="idx")
    return placed.withColumn("_block", F.expr(f"idx div {block}")).withColumn(
        "_x", F.col(x).cast("double")
    )


def cusum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    x: str,
    *,
    threshold: float = 5.0,
    drift: float = 0.0,
    segment: Column | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Two-sided CUSUM per series.

    With C the running sum of (x - drift), the accumulator floored at zero is C minus
    the lowest C so far (or 0), and the negative side is the mirror image. Running sum
    and running extremes split over blocks: a block needs the total of the blocks
    before it and their lowest and highest C.
    """
    placed = _placed(df, keys, order, x, segment, block)
    inside = Window.partitionBy(*keys, "_block").orderBy("idx").rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = placed.withColumn("_c", F.sum(F.col("_x") - drift).over(inside))
    blocks = local.groupBy(*keys, "_block").agg(
        F.max_by("_c", "idx").alias("_sum"),
        F.min("_c").alias("_low"),
        F.max("_c").alias("_high"),
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    carried = blocks.select(
        *keys,
        "_block",
        "_base",
        F.least(F.lit(0.0), F.min(F.col("_base") + F.col("_low")).over(before)).alias("_low0"),
        F.greatest(F.lit(0.0), F.max(F.col("_base") + F.col("_high")).over(before)).alias("_high0"),
    )
    total = F.col("_base") + F.col("_c")
    low = F.least(F.col("_low0"), F.col("_base") + F.min("_c").over(inside))
    high = F.greatest(F.col("_high0"), F.col("_base") + F.max("_c").over(inside))
    out = key_join(local, carried, [*keys, "_block"])
    return (
        out.withColumn("positive_cusum", total - low)
        .withColumn("negative_cusum", high - total)
        .withColumn(
            "alarm",
            (F.col("positive_cusum") > threshold) | (F.col("negative_cusum") > threshold),
        )
        .drop("_block", "_x", "_c", "_base", "_low0", "_high0")
    )


def _smooth_udf(smoothing: float):
    @F.pandas_udf("array<double>")
    def smooth(start: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series(
            [
                pd.Series(np.concatenate(([s], v)))
                .ewm(alpha=smoothing, adjust=False)
                .mean()
                .to_numpy()[1:]
                for s, v in zip(start, values)
            ]
        )

    return smooth


def _chain_udf(keep: float, drift: float):
    @F.pandas_udf("array<double>")
    def chain(lengths: pd.Series, ends: pd.Series) -> pd.Series:
        def starts(n, end):
            out, current = [], drift
            for decay, value in zip(np.power(keep, n), end):
                out.append(current)
                current = decay * current + value
            return out

        return pd.Series([starts(n, e) for n, e in zip(lengths, ends)])

    return chain


def ewma(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    x: str,
    *,
    smoothing: float = 0.3,
    threshold: float = 3.0,
    drift: float = 0.0,
    segment: Column | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Exponentially weighted average per series, started at the drift.

    Each block becomes one array of at most ``block`` values. The average is linear in
    its start value, so one (length, end from a zero start) pair per block gives every
    block's start; the arrays are then smoothed in Arrow batches.
    """
    if not 0.0 < smoothing <= 1.0:
        raise ValueError(f"smoothing must be in (0, 1], got {smoothing}")
    keep = 1.0 - smoothing
    point = F.struct("idx", "_x")
    blocks = (
        _placed(df, keys, order, x, segment, block)
        .groupBy(*keys, "_block")
        .agg(F.array_sort(F.collect_list(point)).alias("_points"))
        .withColumn("_values", F.transform("_points", lambda p: p["_x"]))
    )
    ends = blocks.select(
        *keys,
        F.struct(
            "_block",
            F.size("_values").alias("n"),
            F.aggregate(
                "_values", F.lit(0.0), lambda e, v: smoothing * v + keep * e
            ).alias("end"),
        ).alias("_end"),
    )
    starts = (
        ends.groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_end")).alias("_ends"))
        .withColumn(
            "_starts",
            _chain_udf(keep, drift)(
                F.transform("_ends", lambda e: e["n"]), F.transform("_ends", lambda e: e["end"])
            ),
        )
        .withColumn("_blocks", F.transform("_ends", lambda e: e["_block"]))
        .select(*keys, F.explode(F.arrays_zip("_blocks", "_starts")).alias("_link"))
        .select(*keys, F.col("_link._blocks").alias("_block"), F.col("_link._starts").alias("_start"))
    )
    linked = key_join(blocks, starts, [*keys, "_block"])
    smoothed = linked.withColumn("_ewma", _smooth_udf(smoothing)("_start", "_values"))
    rows = smoothed.select(
        *keys, F.explode(F.arrays_zip("_points", "_ewma")).alias("r")
    ).select(
        *keys,
        F.col("r._points.idx").alias("idx"),
        F.col("r._points._x").alias(x),
        F.col("r._ewma").alias("ewma"),
    )
    return rows.withColumn("alarm", F.abs(F.col("ewma") - drift) > threshold)


def first_alarm(detected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First alarmed position per series, -1 if there is none."""
    return detected.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("alarm"), F.col("idx"))), F.lit(-1))
        .cast("bigint")
        .alias("first_alarm_idx")
    )
