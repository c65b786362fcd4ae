"""Attention graphs and Forman curvature, in joins and aggregates only.

Attention sinks give some nodes almost every edge, so nothing here pairs up the
edges around a node: sums over incident edges come from per-node totals, and
triangles are found along edges directed from low to high degree, which keeps the
fan-out of a hub small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnstrata.operators.positions import key_join
from attnstrata.session import materialize


def topk_edges(attn: DataFrame, keys: Sequence[str], k: Column | int) -> DataFrame:
    """The ``k`` heaviest outgoing edges of each node, self-loops excluded; ties go
    to the smaller destination. ``attn`` has the keys and (src, dst, w).
    """
    heaviest = Window.partitionBy(*keys, "src").orderBy(F.desc("w"), F.asc("dst"))
    return (
        attn.filter(F.col("src") != F.col("dst"))
        .withColumn("_rank", F.row_number().over(heaviest))
        .filter(F.col("_rank") <= k)
        .drop("_rank")
    )


def symmetric_weights(edges: DataFrame, attn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average each edge's weight with that of its reverse, absent reverses being 0."""
    reverse = attn.select(
        *keys, F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("_back")
    )
    return (
        key_join(edges, reverse, [*keys, "src", "dst"], "left")
        .withColumn("w", (F.col("w") + F.coalesce("_back", F.lit(0.0))) * 0.5)
        .drop("_back")
    )


def collapse_edges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Undirected edges (lo, hi, w): positive weights only, heavier direction kept."""
    return (
        edges.filter(F.col("w") > 0)
        .groupBy(*keys, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        .agg(F.max("w").alias("w"))
    )


def attention_nodes(attn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every token that occurs in the attention table, connected or not."""
    ends = F.explode(F.array("src", "dst"))
    return attn.select(*keys, ends.alias("node")).distinct()


def attention_graph(
    attn: DataFrame, keys: Sequence[str], k: Column | int
) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the undirected top-k graph of each key."""
    kept = topk_edges(attn, keys, k)
    edges = collapse_edges(symmetric_weights(kept, attn, keys), keys)
    return edges, attention_nodes(attn, keys)


def _directions(edges: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Each undirected edge seen from both of its ends."""
    ends = F.explode(F.array("lo", "hi"))
    return edges.select(*keys, ends.alias("node"), *values)


def degrees(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        _directions(edges, keys)
        .groupBy(*keys, "node")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def graph_summary(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per graph: nodes, edges and isolated nodes; graphs without edges included."""
    joined = key_join(nodes, degrees(edges, keys), [*keys, "node"], "left")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("degree").isNull()).alias("n_isolated"),
        (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("bigint").alias("n_edges"),
    )


def triangles(edges: DataFrame, keys: Sequence[str], value: str = "w") -> DataFrame:
    """Each triangle once, as nodes (a, b, c) with its edge values ab, ac and bc."""
    degree = degrees(edges, keys)
    for end in ("lo", "hi"):
        edges = key_join(
            edges,
            degree.withColumnsRenamed({"node": end, "degree": f"_d_{end}"}),
            [*keys, end],
        )
    first = F.struct("_d_lo", "lo") < F.struct("_d_hi", "hi")
    directed = edges.select(
        *keys,
        F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("a"),
        F.when(first, F.col("hi")).otherwise(F.col("lo")).alias("b"),
        F.when(first, F.col("_d_hi")).otherwise(F.col("_d_lo")).alias("d_b"),
        F.col(value).alias("ab"),
    )
    other = directed.select(
        *keys, "a", F.col("b").alias("c"), F.col("d_b").alias("d_c"), F.col("ab").alias("ac")
    )
    wedge = key_join(directed, other, [*keys, "a"]).filter(
        F.struct("d_b", "b") < F.struct("d_c", "c")
    )
    closing = directed.select(
        *keys, F.col("a").alias("b"), F.col("b").alias("c"), F.col("ab").alias("bc")
    )
    return key_join(wedge, closing, [*keys, "b", "c"]).select(
        *keys, "a", "b", "c", "ab", "ac", "bc"
    )


def forman_edges(
    edges: DataFrame, keys: Sequence[str], method: str = "augmented"
) -> DataFrame:
    """Forman curvature of every edge (lo, hi, w), node weights being 1.

    ``1d`` looks at edges only: 2 - w_e * sum of 1/sqrt(w_e w_e') over the other
    incident edges. ``augmented`` counts each triangle as a face of weight 1 and
    leaves the edges of common triangles out of the sum.

    The sum is a node total minus what must not count. Weak edges make terms of 1e15 and more,
    so totals are decimals: what is taken out cancels exactly. Weights down to 1e-45 fit.
    """
    if method not in ("1d", "augmented"):
        raise ValueError(f"unknown curvature method: {method!r}")
    rooted = edges.withColumn("_r", 1 / F.sqrt("w")).withColumn(
        "_x", F.col("_r").cast("decimal(36,12)")
    )
    at_node = (
        _directions(rooted, keys, "_x")
        .groupBy(*keys, "node")
        .agg(F.sum("_x").alias("_s"))
    )
    for end in ("lo", "hi"):
        rooted = key_join(
            rooted, at_node.withColumnsRenamed({"node": end, "_s": f"_s_{end}"}), [*keys, end]
        )
    around = F.col("_s_lo") - F.col("_x") + (F.col("_s_hi") - F.col("_x"))
    if method == "1d":
        curved = rooted.withColumn("curvature", 2 - F.col("w") * F.col("_r") * around.cast("double"))
        return curved.select(*keys, "lo", "hi", "w", "curvature")

    found = triangles(rooted, keys, "_x")

    def side(u, v, first, second):
        return F.struct(
            F.least(u, v).alias("lo"),
            F.greatest(u, v).alias("hi"),
            (F.col(first) + F.col(second)).alias("in_face"),
        )

    sides = F.explode(
        F.array(
            side("a", "b", "ac", "bc"),
            side("a", "c", "ab", "bc"),
            side("b", "c", "ab", "ac"),
        )
    )
    faces = (
        found.select(*keys, sides.alias("s"))
        .groupBy(*keys, F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
        .agg(F.count(F.lit(1)).alias("_t"), F.sum("s.in_face").alias("_inside"))
    )
    joined = key_join(rooted, faces, [*keys, "lo", "hi"], "left")
    t = F.coalesce("_t", F.lit(0))
    outside = (around - F.coalesce("_inside", F.lit(0).cast("decimal(38,12)"))).cast("double")
    curvature = F.col("w") * (
        t * F.col("w") + 2 / F.col("w") - F.abs(F.col("_r") * outside)
    )
    return joined.select(*keys, "lo", "hi", "w", curvature.alias("curvature"))


def forman_curvature(
    edges: DataFrame, nodes: DataFrame, keys: Sequence[str], method: str = "augmented"
) -> DataFrame:
    """Mean edge curvature per graph; NaN for a graph with an isolated node or none
    of whose nodes has an edge.
    """
    mean = forman_edges(edges, keys, method).groupBy(*keys).agg(
        F.avg("curvature").alias("_mean")
    )
    summary = key_join(graph_summary(edges, nodes, keys), mean, keys, "left")
    defined = (F.col("n_isolated") == 0) & (F.col("n_edges") > 0)
    return summary.withColumn(
        "forman_ricci", F.when(defined, F.col("_mean")).otherwise(F.lit(float("nan")))
    ).drop("_mean")


def attention_graph_curvature(
    attn: DataFrame, keys: Sequence[str], k: Column | int, method: str = "augmented"
) -> DataFrame:
    """From attention weights to one curvature value per key.

    The sparse graphs are written to the shared scratch folder first: curvature reads
    their edges several times, and attention is far larger than what is kept of it.
    """
    edges, nodes = attention_graph(attn, keys, k)
    return forman_curvature(
        materialize(edges, "edges"), materialize(nodes, "nodes"), keys, method
    )


def nested_graphs(attn: DataFrame, keys: Sequence[str], ks: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the top-k graphs of every k in ``ks``, with a column ``k``.

    Edges are ranked and joined with their reverses once, for the largest k: the graph of a smaller k is made of the first ranks.
    """
    heaviest = Window.partitionBy(*keys, "src").orderBy(F.desc("w"), F.asc("dst"))
    ranked = (
        attn.filter(F.col("src") != F.col("dst"))
        .withColumn("_rank", F.row_number().over(heaviest))
        .filter(F.col("_rank") <= max(ks))
    )
    all_ks = F.array(*[F.lit(int(k)) for k in sorted(set(ks))])
    both = symmetric_weights(ranked, attn, keys).withColumn("k", F.explode(F.filter(all_ks, lambda k: k >= F.col("_rank"))))
    nodes = attention_nodes(attn, keys).withColumn("k", F.explode(all_ks))
    return collapse_edges(both, [*keys, "k"]), nodes


def nested_curvature(attn: DataFrame, keys: Sequence[str], ks: Sequence[int], method: str = "augmented") -> DataFrame:
    """One curvature value per key and k, all k in one job."""
    edges, nodes = nested_graphs(attn, keys, ks)
    return forman_curvature(materialize(edges, "edges"), materialize(nodes, "nodes"), [*keys, "k"], method)
