"""Summaries, imputation, splits, AUROC and its bootstrap interval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from attnstrata.functions import ids
from attnstrata.functions.digests import pair_numbers
from attnstrata.operators.positions import (
    hash_segment,
    key_join,
    place,
    require_keys,
    segment_counts,
    segment_starts,
    with_position,
)
from attnstrata.session import materialize, ship_package


def without_nan(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def _cut_by_value(
    counted: DataFrame, keys: Sequence[str], value: str, segments: int | None
) -> DataFrame:
    """Give every distinct value of a group a range, ``_segment``, in order.

    Ranges are those of a range partitioning of (keys, value), so they hold about as many
    values each, whatever the distribution. They are written once: partition bounds come from
    a sample, and all later steps must see the same ones. ``segments`` defaults to the number
    of shuffle partitions.
    """
    ranges = segments or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartitionByRange(ranges, *keys, value)
    return materialize(dealt.withColumn("_segment", F.spark_partition_id()), "ranges")


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Sequence[float],
    *,
    segments: int | None = None,
) -> DataFrame:
    """Exact interpolated percentiles, columns ``q0``, ``q1``, ... per group.

    The built-in exact percentile keeps all distinct values of a group in one task.
    Here values are counted first, ranks are found per value range, and only the two
    neighbours of each wanted rank are kept. Null and NaN values are left out; keys must
    not be null.
    """
    counted = (
        df.select(*keys, without_nan(value).alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cut = _cut_by_value(counted, keys, "_v", segments)
    inside = Window.partitionBy(*keys, "_segment").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, -1
    )
    across = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        cut.groupBy(*keys, "_segment")
        .agg(F.sum("_n").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(across), F.lit(0)))
        .withColumn("_all", F.sum("_rows").over(Window.partitionBy(*keys)))
        .drop("_rows")
    )
    first = F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranked = key_join(cut, starts, [*keys, "_segment"]).withColumn("_first", first)

    def at(rank: Column) -> Column:
        here = (F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_n"))
        return F.max(F.when(here, F.col("_v")))

    out = ranked.groupBy(*keys).agg(
        F.max("_all").alias("_all"),
        *[
            at(F.floor((F.col("_all") - 1) * F.lit(q))).alias(f"_lo{i}")
            for i, q in enumerate(quantiles)
        ],
        *[
            at(F.ceil((F.col("_all") - 1) * F.lit(q))).alias(f"_hi{i}")
            for i, q in enumerate(quantiles)
        ],
    )
    def between(i: int, q: float) -> Column:
        rank = (F.col("_all") - 1) * F.lit(q)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return (lo + (hi - lo) * (rank - F.floor(rank))).alias(f"q{i}")

    return out.select(*keys, *[between(i, q) for i, q in enumerate(quantiles)])


def summarize(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, large_groups: bool = False
) -> DataFrame:
    """Long table (keys, feature, mean, p10, p50, p90, std): interpolated percentiles
    and population deviation. NaN in a group makes all of its five values NaN.

    Groups are the positions of one lookback window by default; set ``large_groups``
    when a group may be too big for one task.
    """
    by = [*keys, "feature"]
    wanted = (0.1, 0.5, 0.9)
    if large_groups:
        named = [
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
            for c in columns
        ]
        long = df.select(*keys, F.explode(F.array(*named)).alias("f")).select(
            *keys, "f.feature", "f.x"
        )
        moments = long.groupBy(*by).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
        joined = key_join(moments, group_percentiles(long, by, "x", wanted), by, "left")
    else:
        qs = F.array(*[F.lit(q) for q in wanted])

        def stats(c: str) -> Column:
            x = F.col(c).cast("double")
            return F.struct(
                F.lit(c).alias("feature"),
                F.avg(x).alias("mean"),
                F.percentile(x, qs).alias("q"),
                F.stddev_pop(x).alias("std"),
            )

        wide = df.groupBy(*keys).agg(F.array(*[stats(c) for c in columns]).alias("_s"))
        joined = wide.select(*keys, F.explode("_s").alias("s")).select(
            *keys,
            "s.feature",
            "s.mean",
            "s.std",
            *[F.get("s.q", F.lit(i)).alias(f"q{i}") for i in range(3)],
        )

    def quantile(i: int) -> Column:
        return F.when(F.isnan("mean"), F.lit(float("nan"))).otherwise(F.col(f"q{i}"))

    return joined.select(
        *by,
        "mean",
        quantile(0).alias("p10"),
        quantile(1).alias("p50"),
        quantile(2).alias("p90"),
        "std",
    )


def event_features(
    summary: DataFrame, keys: Sequence[str] = ("event_id",), features: Sequence[str] = ()
) -> DataFrame:
    """One row per event: the mean over layers and heads of each feature's stored mean;
    a NaN poisons its event's column.
    """
    return summary.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("feature") == f, F.col("mean"))).alias(f) for f in features]
    )


def impute_median(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    *,
    add_indicator: bool = False,
) -> DataFrame:
    """Replace NaN and null by the group's median of the other values, or by 0.

    Medians come from an aggregate joined back; no group is gathered in one task.
    """
    df = require_keys(df, keys)
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x"))
                    for c in columns
                ]
            )
        ).alias("f"),
    ).select(*keys, "f.c", "f.x")
    medians = (
        group_percentiles(long, [*keys, "c"], "x", [0.5])
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("c") == c, F.col("q0"))).alias(f"_med_{c}") for c in columns])
    )
    out = key_join(df, medians, keys, "left")
    if add_indicator:
        out = out.withColumns({f"{c}_imputed": without_nan(c).isNull() for c in columns})
    return out.withColumns(
        {c: F.coalesce(without_nan(c), F.col(f"_med_{c}"), F.lit(0.0)) for c in columns}
    ).drop(*[f"_med_{c}" for c in columns])


def stratified_split(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    *,
    id_col: str,
    fraction: float = 0.2,
    seed: Column | str = "split",
    segment_digits: int = 2,
) -> DataFrame:
    """Mark ``ceil(fraction * n)`` rows of each group as ``held_out``, shared out over its labels.

    Each label gets the whole part of its proportional share; what is left goes to the largest
    remainders, ties to the smaller label.
    """
    group = [*keys, label]
    ordered = require_keys(df, group).withColumn("_order", ids.order_key(seed, F.col(id_col)))
    ordered = ordered.withColumn("_segment", hash_segment("_order", segment_digits))
    counts = segment_counts(ordered, group)
    sizes = counts.groupBy(*group).agg(F.sum("_rows").alias("_n"))
    whole = Window.partitionBy(*keys)
    n, wanted = F.sum("_n").over(whole), F.ceil(F.lit(fraction) * F.sum("_n").over(whole))
    sizes = sizes.withColumns({"_all": n, "_wanted": wanted}).withColumns(
        {"_base": F.expr("_wanted * _n div _all"), "_left": F.expr("_wanted * _n % _all")}
    )
    rank = F.row_number().over(whole.orderBy(F.desc("_left"), label))
    spare = F.col("_wanted") - F.sum("_base").over(whole)
    sizes = sizes.withColumn("_n_out", F.col("_base") + (rank <= spare).cast("int")).select(*group, "_n_out")
    starts = key_join(segment_starts(counts, group), sizes, group)
    return (
        place(ordered, starts, group, ["_order", id_col], "_position")
        .withColumn("held_out", F.col("_position") < F.col("_n_out"))
        .drop("_order", "_position", "_n_out")
    )


def rows_per_group_at_least(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Keep the groups with enough rows for a stable fit."""
    enough = df.groupBy(*keys).count().filter(F.col("count") >= n).drop("count")
    return key_join(df, enough, keys, "left_semi")


def auroc(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    score: str,
    *,
    weight: str | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Area under the ROC curve per group, ties counted half.

    Rows are first added up per distinct score. The pair count is then summed inside
    score ranges and the ranges are linked by their totals, so a group is never
    sorted in one task. Groups with a single class get a null.
    """
    df = require_keys(df, [k for k in keys if k != "replicate"])
    n = F.lit(1) if weight is None else F.col(weight)
    positive = F.col(label).cast("int") == 1
    counted = df.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.sum(F.when(positive, n).otherwise(0)).alias("_pos"),
        F.sum(F.when(positive, 0).otherwise(n)).alias("_neg"),
    )
    cut = _cut_by_value(counted, keys, "_score", segments)
    below = Window.partitionBy(*keys, "_segment").orderBy("_score").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranges = (
        cut.withColumn("_under", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
        .groupBy(*keys, "_segment")
        .agg(
            F.sum(F.col("_pos") * (F.col("_under") + F.col("_neg") / 2)).alias("_u"),
            F.sum("_pos").alias("_p"),
            F.sum("_neg").alias("_q"),
        )
    )
    return _linked_ranges(ranges, keys)


def _linked_ranges(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_pos, n_neg, auroc) from (keys, _segment, _u, _p, _q): pairs won inside score ranges, and their classes."""
    below_segment = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranges = ranges.withColumn("_under", F.coalesce(F.sum("_q").over(below_segment), F.lit(0)))
    total = ranges.groupBy(*keys).agg(
        F.sum(F.col("_u") + F.col("_p") * F.col("_under")).alias("_u"),
        F.sum("_p").alias("n_pos"),
        F.sum("_q").alias("n_neg"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return total.select(
        *keys, "n_pos", "n_neg", F.when(pairs > 0, F.col("_u") / pairs).alias("auroc")
    )


def _indexed(df: DataFrame, keys: Sequence[str], id_col: str, order_seed: str) -> DataFrame:
    """Rows with their index ``_i`` in the group's seeded order."""
    ordered = require_keys(df, keys).withColumn("_order", ids.order_key(order_seed, F.col(id_col)))
    return with_position(ordered, keys, ["_order", id_col], segment=hash_segment("_order"), name="_i").drop("_order")


def _sized(indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _i, _n): the indices of a group and their number."""
    sizes = indexed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return key_join(indexed.select(*keys, "_i"), sizes, keys)


def bootstrap_weights(
    df: DataFrame,
    keys: Sequence[str],
    *,
    id_col: str,
    replicates: int,
    seed: str = "bootstrap",
    order_seed: str = "bootstrap-order",
) -> tuple[DataFrame, DataFrame]:
    """(rows with their index ``_i``, draws): n-of-n draws with replacement.

    ``draws`` holds (keys, replicate, _i, weight) for the rows a replicate drew. Row i
    makes draw number i of every replicate, so draws are produced where the rows are
    and are counted before they are shuffled.
    """
    indexed = _indexed(df, keys, id_col, order_seed)
    drawing = _sized(indexed, keys).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    name = F.concat_ws(
        "|", *[F.col(k).cast("string") for k in keys], "replicate", F.col("_i").cast("string")
    )
    drawn = drawing.withColumn("_i", ids.derive_long(seed, name) % F.col("_n")).drop("_n")
    draws = drawn.groupBy(*keys, "replicate", "_i").agg(F.count(F.lit(1)).alias("weight"))
    return indexed, draws


def percentile_pick(df: DataFrame, keys: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Lower and upper 95 % bounds as order statistics of the replicate values.

    One small array per group: its length is the number of replicates.
    """
    sorted_values = F.array_sort(F.collect_list(value))
    m = F.size("_v")
    lo = F.floor(m * F.lit(0.025)).cast("int")
    hi = F.floor(m * F.lit(0.975)).cast("int") - 1
    hi = F.when(hi < 0, m - 1).otherwise(hi)
    nan = F.lit(float("nan"))
    return (
        df.groupBy(*keys)
        .agg(sorted_values.alias("_v"))
        .select(
            *keys,
            m.cast("bigint").alias("n_replicates"),
            F.coalesce(F.get("_v", lo), nan).alias(f"{prefix}_ci_lower"),
            F.coalesce(F.get("_v", hi), nan).alias(f"{prefix}_ci_upper"),
        )
    )


#: Replicates whose counts one task adds up beside each other.
REPLICATE_BLOCK = 250
#: Rows of a group whose draws meet in one place; at most 2**16.
INDEX_BLOCK = 2_048
#: Draws that one task makes, and those it holds at a time.
TASK_DRAWS, HELD_DRAWS = 4_000_000, 1_000_000
#: Rows of a score range.
RANGE_ROWS = 8_192


def _packed_draws(keys: Sequence[str], replicates: int, seed: str):
    """(keys, _at, _offsets, _replicates): draws by the block of indices they hit, packed as bytes.

    Draw number i of a replicate is ``ids.derive_long`` of (keys, replicate, i) modulo the group's rows.
    """
    names = list(keys)

    def packed(rows: pa.Table) -> pa.Table:
        n, text = rows["_n"][0].as_py(), rows["_text"][0].as_py()
        # draws are the first 15 hex digits of the hash
        drawn = pair_numbers(f"{seed}:{text}".encode(), np.arange(replicates), rows["_i"].to_numpy()) >> np.uint64(4)
        hit = (drawn % np.uint64(n)).astype(np.int64).ravel()
        at = hit // INDEX_BLOCK
        order = np.argsort(at.astype(np.uint16) if n <= INDEX_BLOCK << 16 else at, kind="stable")
        blocks, starts = np.unique(at[order], return_index=True)
        ends = [*starts[1:], len(order)]
        offsets = (hit % INDEX_BLOCK)[order].astype(np.uint16)
        drawer = (order % replicates).astype(np.int32)
        return pa.table({
            **{k: pa.array([rows[k][0].as_py()] * len(blocks), rows.schema.field(k).type) for k in names},
            "_at": pa.array(blocks, pa.int64()),
            "_offsets": pa.array([offsets[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            "_replicates": pa.array([drawer[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD_DRAWS // replicates)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            _, group = np.unique(rows["_text"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for g in range(group.max() + 1 if len(group) else 0):
                own = rows.take(np.flatnonzero(group == g))
                for a in range(0, len(own), step):
                    yield from packed(own.slice(a, step)).to_batches()

    return run


def _counted_draws(keys: Sequence[str], label: str, score: str, replicates: int):
    """(keys, _segment, score, _positive, _counts): how often each replicate drew the rows of a block of indices, added up per
    score and class, so many rows of one score are as few as one.
    """

    def run(rows: pa.Table, drawn: pa.Table) -> pa.Table:
        positive = pc.fill_null(pc.cast(rows[label], pa.int32()), 0).to_numpy() == 1
        scores = rows[score].combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
        segments = rows["_segment"].to_numpy()
        _, code = np.unique(scores, return_inverse=True)
        _, first, cell = np.unique((segments.astype(np.int64) * len(rows) + code) * 2 + positive, return_index=True, return_inverse=True)
        cell_of = np.zeros(INDEX_BLOCK, np.int64)
        cell_of[rows["_i"].to_numpy() % INDEX_BLOCK] = cell
        offsets = np.frombuffer(b"".join(drawn["_offsets"].to_pylist()), np.uint16)
        replicate = np.frombuffer(b"".join(drawn["_replicates"].to_pylist()), np.int32)
        counts = np.bincount(cell_of[offsets] * replicates + replicate, minlength=len(first) * replicates).astype(np.int32)
        return pa.table({
            **{k: rows[k].take(first) for k in keys}, "_segment": rows["_segment"].take(first), score: pa.array(scores[first], pa.float64()),
            "_positive": pa.array(positive[first]), "_counts": pa.array([c.tobytes() for c in counts.reshape(len(first), replicates)], pa.binary()),
        })

    return run


def _won_in_range(keys: Sequence[str], score: str, replicates: int):
    """Pairs won inside a score range, and its classes, for all replicates.

    A row carries the counts of all replicates for one score and class. Rows of one score are ties; a null
    score counts as the lowest, NaN as the highest.
    """

    def run(rows: pa.Table) -> pa.Table:
        distinct, code = np.unique(rows[score].to_numpy(), return_inverse=True)
        fails = rows["_positive"].to_numpy(zero_copy_only=False).astype(bool)
        counts = rows["_counts"].to_pylist()
        found = []
        for base in range(0, replicates, REPLICATE_BLOCK):
            width = min(REPLICATE_BLOCK, replicates - base)
            positive, negative = np.zeros((2, len(distinct), width), np.int64)
            for c, fail, packed in zip(code, fails, counts):
                side = positive if fail else negative
                side[c] += np.frombuffer(packed, np.int32, width, 4 * base)
            under = np.cumsum(negative, axis=0) - negative
            won = (positive * (under + negative / 2)).sum(axis=0)
            p, q = positive.sum(axis=0), negative.sum(axis=0)
            used = np.flatnonzero(p + q)
            found.append((base + used, won[used], p[used], q[used]))
        replicate, won, p, q = (np.concatenate(x) for x in zip(*found))
        columns = {k: pa.array([rows[k][0].as_py()] * len(replicate), rows.schema.field(k).type) for k in (*keys, "_segment")}
        return pa.table({
            **columns, "replicate": pa.array(replicate, pa.int32()), "_u": pa.array(won, pa.float64()),
            "_p": pa.array(p, pa.int64()), "_q": pa.array(q, pa.int64()),
        })

    return run


def bootstrap_auroc_ci(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    score: str,
    *,
    id_col: str,
    replicates: int = 1000,
    seed: str = "bootstrap",
    segments: int | None = None,
) -> DataFrame:
    """Percentile bootstrap interval of the AUROC; one-class replicates are dropped.

    Rows are sorted by score once, in ranges, not once a replicate. Draws are made in tasks of so many draws, whatever the
    bytes of their rows, and leave them packed, by blocks of the indices they hit. There they are counted per score, class and
    replicate, and a task sums all replicates over its score range.
    """
    ship_package(df.sparkSession)
    names = list(keys)
    indexed = _indexed(df.select(*keys, id_col, label, score), keys, id_col, "bootstrap-order")
    stored = materialize(indexed.select(*keys, "_i", label, F.col(score).cast("double").alias(score)), "indexed")
    n_rows = stored.count()
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _cut_by_value(stored, keys, score, segments or max(shuffled, -(-n_rows // RANGE_ROWS)))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows * replicates // TASK_DRAWS))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(""))
    drawing = _sized(stored, keys).withColumn("_text", text).repartition(tasks, *keys, "_i")
    of_keys = [stored.schema[k] for k in keys]
    packed = StructType([
        *of_keys, StructField("_at", LongType()), StructField("_offsets", BinaryType()), StructField("_replicates", BinaryType()),
    ])
    drawn = drawing.mapInArrow(_packed_draws(names, replicates, seed), packed)
    counted = StructType([
        *of_keys, StructField("_segment", IntegerType()), StructField(score, DoubleType()), StructField("_positive", BooleanType()),
        StructField("_counts", BinaryType()),
    ])
    hit = ranged.withColumn("_at", F.expr(f"_i div {INDEX_BLOCK}")).groupBy(*keys, "_at")
    counts = hit.cogroup(drawn.groupBy(*keys, "_at")).applyInArrow(_counted_draws(names, label, score, replicates), counted)
    schema = StructType([
        *of_keys, StructField("_segment", IntegerType()), StructField("replicate", IntegerType()),
        StructField("_u", DoubleType()), StructField("_p", LongType()), StructField("_q", LongType()),
    ])
    ranges = counts.groupBy(*keys, "_segment").applyInArrow(_won_in_range(names, score, replicates), schema)
    scores = _linked_ranges(ranges, [*keys, "replicate"])
    return percentile_pick(scores, keys, "auroc", "auroc")


def pointwise_band(
    samples: DataFrame, keys: Sequence[str], value: str, prefix: str = ""
) -> DataFrame:
    """Interpolated 2.5 and 97.5 percentiles of the replicate values per key."""
    return (
        samples.groupBy(*keys)
        .agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
        .select(
            *keys,
            F.get("_q", F.lit(0)).alias(f"{prefix}ci_lower"),
            F.get("_q", F.lit(1)).alias(f"{prefix}ci_upper"),
        )
    )


def islands(
    df: DataFrame, keys: Sequence[str], position: str, flag: Column
) -> DataFrame:
    """Maximal runs of consecutive positions where the flag holds, ends inclusive.

    Per key this orders one row per position (32 layers in the study).
    """
    order = Window.partitionBy(*keys).orderBy(position)
    return (
        df.filter(flag)
        .withColumn("_run", F.col(position) - F.row_number().over(order))
        .groupBy(*keys, "_run")
        .agg(F.min(position).alias("lo"), F.max(position).alias("hi"))
        .drop("_run")
    )
