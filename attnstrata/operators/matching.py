"""Coarsened exact matching: balanced fail/control samples per bin.

All bins are matched in one job. Cells are counted with a partial + final hash
aggregate; sampling orders rows by a content hash, never by chance, so results do
not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.functions import ids
from attnstrata.operators.positions import (
    hash_segment,
    key_join,
    place,
    require_keys,
    segment_counts,
    segment_starts,
    with_position,
)
from attnstrata.session import materialize


def cell_counts(
    events: DataFrame,
    keys: Sequence[str] = ("bin_id",),
    stratum: str = "cem_stratum_id",
    label: str = "is_fail",
) -> DataFrame:
    """Pool sizes and available pairs per (bin, stratum)."""
    return (
        events.groupBy(*keys, stratum)
        .agg(
            F.count_if(F.col(label)).alias("n_fail_pool"),
            F.count_if(~F.col(label)).alias("n_ctrl_pool"),
        )
        .withColumn("n_matched_pairs", F.least("n_fail_pool", "n_ctrl_pool"))
    )


def achievable_pairs(
    cells: DataFrame, target: Column | int, keys: Sequence[str] = ("bin_id",)
) -> DataFrame:
    """Pairs each bin can deliver, against the number asked for."""
    target = F.lit(target) if isinstance(target, int) else target
    return (
        cells.groupBy(*keys)
        .agg(F.sum("n_matched_pairs").alias("achieved"))
        .withColumn("requested", target.cast("bigint"))
        .withColumn(
            "status",
            F.when(F.col("achieved") >= F.col("requested"), "matched").otherwise("short"),
        )
    )


def match_yield(cells: DataFrame, keys: Sequence[str] = ("bin_id",)) -> DataFrame:
    """Yield report per bin: pairs over the smaller pool, in percent."""
    smaller = F.least("total_fail_pool", "total_ctrl_pool")
    return (
        cells.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_strata"),
            F.count_if(F.col("n_matched_pairs") > 0).alias("n_strata_with_matches"),
            F.sum("n_fail_pool").alias("total_fail_pool"),
            F.sum("n_ctrl_pool").alias("total_ctrl_pool"),
            F.sum("n_matched_pairs").alias("total_matched_pairs"),
        )
        .withColumn(
            "yield_pct",
            F.when(
                smaller > 0, F.lit(100.0) * F.col("total_matched_pairs") / smaller
            ).otherwise(F.lit(0.0)),
        )
        .withColumn("is_compromised", F.col("yield_pct") < fixed.YIELD_OK)
    )


def rank_cells(
    cells: DataFrame, keys: Sequence[str] = ("bin_id",), stratum: str = "cem_stratum_id"
) -> DataFrame:
    """Cells that can contribute, largest first; runs on the counted cells only."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n_matched_pairs"), F.asc(stratum))
    return cells.filter(F.col("n_matched_pairs") > 0).withColumn(
        "cell_rank", F.row_number().over(order)
    )


def allocate(
    cells: DataFrame,
    target: Column | int,
    keys: Sequence[str] = ("bin_id",),
    stratum: str = "cem_stratum_id",
) -> DataFrame:
    """Pairs to take per cell: the proportional floor, then one more for the largest
    cells until the target is met. Bins that cannot reach the target get none.
    """
    target = (F.lit(target) if isinstance(target, int) else target).cast("bigint")
    whole_bin = Window.partitionBy(*keys)
    shared = (
        rank_cells(cells, keys, stratum)
        .withColumn("_total", F.sum("n_matched_pairs").over(whole_bin))
        .withColumn("_target", target)
        .filter(F.col("_total") >= F.col("_target"))
        .withColumn(
            "_floor",
            F.expr("_target * n_matched_pairs div _total"),
        )
    )
    deficit = F.col("_target") - F.sum("_floor").over(whole_bin)
    return shared.withColumn(
        "n_take",
        F.col("_floor") + F.when(F.col("cell_rank") <= deficit, 1).otherwise(0),
    ).drop("_total", "_target", "_floor")


def _in_sampling_order(
    events: DataFrame, seed: Column | str, id_col: str, digits: int
) -> DataFrame:
    ordered = events.withColumn("_order", ids.order_key(seed, F.col(id_col)))
    return ordered.withColumn("_segment", hash_segment("_order", digits))


def _take(
    ordered: DataFrame,
    counts: DataFrame,
    allocation: DataFrame,
    cell: Sequence[str],
    label: str,
    id_col: str,
) -> DataFrame:
    wanted = allocation.filter(F.col("n_take") > 0).select(*cell, "n_take")
    group = [*cell, label]
    starts = key_join(segment_starts(counts, group), wanted, cell).filter(
        F.col("_start") < F.col("n_take")
    )
    # bytes sort as their hex digits do and are half as long to shuffle
    packed = ordered.withColumn("_order", F.unhex("_order"))
    return (
        place(packed, starts, group, ["_order", id_col], "_position")
        .filter(F.col("_position") < F.col("n_take"))
        .drop("_order", "_position", "n_take")
    )


def sample_in_cells(
    events: DataFrame,
    allocation: DataFrame,
    *,
    seed: Column | str,
    keys: Sequence[str] = ("bin_id",),
    stratum: str = "cem_stratum_id",
    label: str = "is_fail",
    id_col: str = "event_id",
    segment_digits: int = 2,
) -> DataFrame:
    """``n_take`` fails and ``n_take`` controls per cell, without replacement.

    Only hash ranges that can hold a taken row survive the join with the small table
    of range starts, so the sort sees little more than the sample. A cell has 16 to the
    ``segment_digits`` ranges: take 3 or 4 digits for cells of many billion rows.
    """
    cell = [*keys, stratum]
    ordered = _in_sampling_order(events, seed, id_col, segment_digits)
    counts = segment_counts(ordered, [*cell, label])
    return _take(ordered, counts, allocation, cell, label, id_col)


def bin_seed(keys: Sequence[str] = ("bin_id",)) -> Column:
    """Sampling seed of a bin, derived from its name."""
    return ids.derive_seed("match", F.concat_ws("|", *[F.col(k) for k in keys]))


def cem_match(
    events: DataFrame,
    target: Column | int,
    *,
    keys: Sequence[str] = ("bin_id",),
    stratum: str = "cem_stratum_id",
    label: str = "is_fail",
    id_col: str = "event_id",
    seed: Column | str | None = None,
    segment_digits: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """(balanced rows, strata): ``target`` fails and controls for each bin able to
    supply them. ``strata`` lists every cell with its pools, pairs, allocation and
    the bin's status.
    """
    cell = [*keys, stratum]
    ordered = _in_sampling_order(
        require_keys(events, [*cell, label]),
        bin_seed(keys) if seed is None else seed,
        id_col,
        segment_digits,
    )
    counts = segment_counts(ordered, [*cell, label])
    cells = _cells_from_counts(counts, cell, label)
    taken = allocate(cells, target, keys, stratum)
    status = achievable_pairs(cells, target, keys)
    strata = key_join(
        key_join(cells, taken.select(*cell, "n_take"), cell, "left"), status, keys
    ).withColumn("n_take", F.coalesce("n_take", F.lit(0)))
    return _take(ordered, counts, taken, cell, label, id_col), strata


def _cells_from_counts(counts: DataFrame, cell: Sequence[str], label: str) -> DataFrame:
    """Pool sizes per cell from the counts per sampling range: one pass over the events
    serves both.
    """
    rows = F.col("_rows")
    return (
        counts.groupBy(*cell)
        .agg(
            F.sum(F.when(F.col(label), rows).otherwise(0)).alias("n_fail_pool"),
            F.sum(F.when(F.col(label), 0).otherwise(rows)).alias("n_ctrl_pool"),
        )
        .withColumn("n_matched_pairs", F.least("n_fail_pool", "n_ctrl_pool"))
    )


def tier_pools(
    pool: DataFrame,
    target: int,
    *,
    keys: Sequence[str] = ("bin_id",),
    id_col: str = "event_id",
    factors: Sequence[float] = fixed.TIER_FACTORS,
) -> DataFrame:
    """The rows the largest tier may use, each with its place in its bin's order."""
    largest = int(target * 2 * max(factors))
    ordered = require_keys(pool, keys).withColumn("_order", ids.order_key("pool", F.col(id_col)))
    return with_position(
        ordered,
        list(keys),
        ["_order", id_col],
        segment=hash_segment("_order", 3),
        limit=largest,
        name="pool_position",
    ).drop("_order")


def tier_report(
    pooled: DataFrame,
    target: int,
    *,
    keys: Sequence[str] = ("bin_id",),
    stratum: str = "cem_stratum_id",
    label: str = "is_fail",
    factors: Sequence[float] = fixed.TIER_FACTORS,
) -> DataFrame:
    """Which tier each bin needs and how good it is.

    Both tiers are counted in one pass over the pooled rows. The first tier is
    accepted when it reaches the target with a sufficient yield, otherwise the
    second is used; a bin short of its target, or under the review limit, is marked
    ``needs_review``.
    """
    first, second = (int(target * 2 * f) for f in factors)
    fail, small = F.col(label), F.col("pool_position") < first
    cells = pooled.groupBy(*keys, stratum).agg(
        F.count_if(fail & small).alias("f1"),
        F.count_if(~fail & small).alias("c1"),
        F.count_if(fail).alias("f2"),
        F.count_if(~fail).alias("c2"),
    )
    sums = cells.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("f1", "c1", "f2", "c2")],
        F.sum(F.least("f1", "c1")).alias("p1"),
        F.sum(F.least("f2", "c2")).alias("p2"),
    )

    def pct(i: int) -> Column:
        smaller = F.least(f"f{i}", f"c{i}")
        return F.when(smaller > 0, F.lit(100.0) * F.col(f"p{i}") / smaller).otherwise(0.0)

    use_first = (F.col("p1") >= target) & (pct(1) >= fixed.YIELD_OK)
    achieved = F.when(use_first, F.col("p1")).otherwise(F.col("p2"))
    out = sums.select(
        *keys,
        F.when(use_first, factors[0]).otherwise(factors[1]).alias("oversample_factor"),
        F.when(use_first, first).otherwise(second).cast("bigint").alias("pool_size"),
        F.when(use_first, pct(1)).otherwise(pct(2)).alias("yield_pct"),
        achieved.alias("achieved"),
        F.lit(target).cast("bigint").alias("requested"),
    )
    short = (F.col("achieved") < F.col("requested")) | (
        F.col("yield_pct") < fixed.YIELD_REVIEW
    )
    return out.withColumn(
        "status",
        F.when(short, "needs_review")
        .when(F.col("yield_pct") < fixed.YIELD_COMPROMISED, "compromised")
        .otherwise("matched"),
    )


def cem_match_tiered(
    pool: DataFrame,
    target: int,
    *,
    keys: Sequence[str] = ("bin_id",),
    stratum: str = "cem_stratum_id",
    label: str = "is_fail",
    id_col: str = "event_id",
    factors: Sequence[float] = fixed.TIER_FACTORS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(balanced rows, strata, per-bin report), growing the pool where needed.

    The pooled rows, a fixed multiple of the target per bin however large the source,
    are written once to the shared scratch folder.
    """
    pooled = materialize(
        tier_pools(pool, target, keys=keys, id_col=id_col, factors=factors), "pool"
    )
    report = tier_report(
        pooled, target, keys=keys, stratum=stratum, label=label, factors=factors
    )
    chosen = report.filter(F.col("status") != "needs_review").select(*keys, "pool_size")
    usable = (
        key_join(pooled, chosen, keys)
        .filter(F.col("pool_position") < F.col("pool_size"))
        .drop("pool_position", "pool_size")
    )
    matched, strata = cem_match(
        usable, target, keys=keys, stratum=stratum, label=label, id_col=id_col
    )
    return matched, strata, report


def handcheck_sample(
    events: DataFrame, size: int = 50, *, seed: str = "handcheck", id_col: str = "event_id"
) -> DataFrame:
    """A fixed pseudo-random sample for reading by hand; everything if there is less."""
    return (
        events.withColumn("_order", ids.order_key(seed, F.col(id_col)))
        .orderBy("_order", id_col)
        .limit(size)
        .drop("_order")
    )
