"""Positions and running values inside groups of any size.

A plain window puts one group into one task. The helpers here take a *segment*:
a column that never decreases along the order, such as a prefix of an ordering
hash or the day of a timestamp. Work then happens per (group, segment), and only
one summary row per segment is combined per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnstrata.session import broadcast_if_small, materialize


def require_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail on a null group key, which an equi-join would silently lose."""
    def checked(k: str) -> Column:
        return F.when(
            F.col(k).isNull(), F.raise_error(F.lit(f"group key {k} is null"))
        ).otherwise(F.col(k))

    return df.withColumns({k: checked(k) for k in keys})


def key_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join of two tables derived from each other, on columns of the same names."""
    return left.join(right, list(keys), how)


def hash_segment(order: str, digits: int = 2) -> Column:
    """Segment for rows ordered by a hex hash: its first digits (never null, so that
    no null check evaluates the hash a second time).
    """
    return F.coalesce(F.substring(F.col(order), 1, digits), F.lit(""))


def segment_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per (group, ``_segment``): the small table all positions are built from.

    Counted in one pass and stored, so the rows are scanned twice in all: once here
    and once when they are placed.
    """
    counts = df.groupBy(*keys, "_segment").agg(F.count(F.lit(1)).alias("_rows"))
    return materialize(counts, "segments")


def segment_starts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First position of every segment; one window row per segment."""
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop(
        "_rows"
    )


def place(
    df: DataFrame,
    starts: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str = "position",
) -> DataFrame:
    """Positions of the rows whose segment is in ``starts``. Further columns of
    ``starts`` stay on the rows.

    While ``starts`` is small by count it is broadcast: rows of other segments are then
    dropped where they are read, and only the rest is shuffled, once.
    """
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order)
    return (
        key_join(df, broadcast_if_small(starts), [*keys, "_segment"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_segment", "_start")
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    segment: Column | None = None,
    limit: int | None = None,
    name: str = "position",
) -> DataFrame:
    """Zero-based position of each row within its group (keys must not be null).

    With ``segment``, positions are counted per (group, segment) and shifted by the
    rows of all earlier segments, so a group holding a third of the table is spread
    over as many tasks as it has segments. With ``limit``, only rows at positions
    below it are returned; whole segments beyond it are dropped before the sort.
    """
    if segment is None:
        by = Window.partitionBy(*keys).orderBy(*order)
        out = df.withColumn(name, F.row_number().over(by) - 1)
    else:
        cut = df.withColumn("_segment", segment)
        starts = segment_starts(segment_counts(cut, keys), keys)
        if limit is not None:
            starts = starts.filter(F.col("_start") < limit)
        out = place(cut, starts, keys, order, name)
    return out if limit is None else out.filter(F.col(name) < limit)
