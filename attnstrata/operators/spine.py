"""Per-layer aggregates of the head graphs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attnstrata.functions import fixed_values as fixed
from attnstrata.operators.positions import key_join
from attnstrata.operators.statistics import event_features, without_nan


def modularity(dist: str = "dist") -> Column:
    """Population deviation over mean of the edge distances; 0 where the mean is 0."""
    mean = F.avg(dist)
    return F.when(F.coalesce(mean, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
        F.stddev_pop(dist) / mean
    )


def edge_aggregates(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mean_grassmannian and modularity over the rows with h_i < h_j."""
    return edges.groupBy(*keys).agg(
        F.avg("dist").alias("mean_grassmannian"), modularity().alias("modularity")
    )


def nan_mean(x: str) -> Column:
    return F.coalesce(F.avg(without_nan(x)), F.lit(float("nan")))


def head_degrees(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted degree of each head, weights being 1 / (1 + distance)."""
    ends = F.explode(F.array("h_i", "h_j"))
    return (
        edges.select(*keys, ends.alias("head"), (1 / (1 + F.col("dist"))).alias("_w"))
        .groupBy(*keys, "head")
        .agg(F.sum("_w").alias("degree"))
    )


def spectral_gap(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Second-smallest eigenvalue of the unnormalised Laplacian of each head graph."""
    schema = T.StructType(
        [*[edges.schema[k] for k in keys], T.StructField("spectral_gap", T.DoubleType())]
    )
    names = list(keys)

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = []
            for graph in batch["_edges"]:
                i = np.array([e["h_i"] for e in graph])
                j = np.array([e["h_j"] for e in graph])
                heads, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                w = np.zeros((len(heads), len(heads)))
                a, b = at[: len(i)], at[len(i):]
                w[a, b] = w[b, a] = 1.0 / (1.0 + np.array([e["dist"] for e in graph]))
                values.append(float(np.linalg.eigvalsh(np.diag(w.sum(axis=1)) - w)[1]))
            out = batch[names].copy()
            out["spectral_gap"] = values
            yield out

    graphs = edges.groupBy(*keys).agg(
        F.collect_list(F.struct("h_i", "h_j", F.col("dist").cast("double").alias("dist"))).alias(
            "_edges"
        )
    )
    return graphs.mapInPandas(gaps, schema)


def mean_curvature(atomic: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean curvature over heads, NaN left out; NaN where no head has a value."""
    return atomic.groupBy(*keys).agg(nan_mean(fixed.RICCI_FEATURE).alias("mean_forman_ricci"))


def spine_curve(
    edges: DataFrame,
    atomic: DataFrame,
    *,
    keys: Sequence[str] = ("event_id", "edge_type"),
    layer: str = "layer",
) -> DataFrame:
    """The four aggregates per (event, edge type, layer).

    ``atomic`` has one row per (event, layer, head); it is joined on the keys it has.
    """
    by = [*keys, layer]
    shared = [k for k in by if k in atomic.columns]
    joined = key_join(edge_aggregates(edges, by), spectral_gap(edges, by), by)
    joined = key_join(joined, mean_curvature(atomic, shared), shared, "left")
    return joined.select(
        *by, "mean_grassmannian", "spectral_gap", "mean_forman_ricci", "modularity"
    )


def layer_curve(
    edges: DataFrame,
    *,
    n_heads: int,
    keys: Sequence[str] = ("event_id", "edge_type"),
    layer: str = "layer",
) -> DataFrame:
    """Mean of the full head-by-head matrix, zero diagonal included, per layer."""
    mean = F.sum("dist") * 2.0 / (n_heads * n_heads)
    return edges.groupBy(*keys, layer).agg(mean.alias("mean_distance"))


def curves(
    points: DataFrame, keys: Sequence[str], position: str, value: str, name: str = "curve"
) -> DataFrame:
    """Ordered array of one value per position (a curve is bounded by the layers)."""
    ordered = F.array_sort(F.collect_list(F.struct(position, value)))
    return points.groupBy(*keys).agg(F.transform(ordered, lambda p: p[value]).alias(name))


def spine_curves_by_bin(
    events: DataFrame, edges: DataFrame, *, n_heads: int, edge_type: str | None = None
) -> DataFrame:
    """One curve per (event, edge type) with the event's bin and label.

    Only the commit token (``lookback_j`` 0) is used; events without edges are left
    out, see ``missing_events``.
    """
    at_commit = edges.filter(F.col("lookback_j") == 0) if "lookback_j" in edges.columns else edges
    if edge_type is not None:
        at_commit = at_commit.filter(F.col("edge_type") == edge_type)
    curve = curves(
        layer_curve(at_commit, n_heads=n_heads), ["event_id", "edge_type"], "layer", "mean_distance"
    )
    return events.select("event_id", "bin_id", "is_fail").join(curve, "event_id")


def missing_events(events: DataFrame, table: DataFrame, key: str = "event_id") -> DataFrame:
    """Events that have no row in a tensor table."""
    return events.join(table.select(key), key, "left_anti")


def event_feature_matrix(events: DataFrame, summary: DataFrame) -> DataFrame:
    """Seven features per event with its bin and label; an event without a summary
    is an error.
    """
    features = event_features(summary, ("event_id",), fixed.FEATURES)
    joined = events.select("event_id", "bin_id", "is_fail").join(
        features.withColumn("_found", F.lit(True)), "event_id", "left"
    )
    checked = F.when(F.col("_found"), F.col("event_id")).otherwise(
        F.raise_error(F.concat(F.lit("no tensor summary for event "), F.col("event_id").cast("string")))
    )
    return joined.withColumn("event_id", checked.cast(events.schema["event_id"].dataType)).drop("_found")
