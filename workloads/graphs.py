"""Attention graphs and curvature."""

from __future__ import annotations

from pyspark.sql import functions as F

from attnstrata.operators import graph
from attnstrata.session import materialize
from workloads import views as v
from workloads.registry import query, r6, sql_r6

K = 4
KEYS = ["gid"]

SQL_FORMAN_1D = """,
incident AS (
  SELECT e.gid, e.lo, e.hi, sum(1 / sqrt(e.w * a.w)) AS s
  FROM edges e JOIN adj a ON a.gid = e.gid AND
    ((a.u = e.lo AND a.v <> e.hi) OR (a.u = e.hi AND a.v <> e.lo)) GROUP BY ALL),
curved AS (
  SELECT e.gid, e.lo, e.hi, 2 - e.w * coalesce(i.s, 0) AS curvature
  FROM edges e LEFT JOIN incident i USING (gid, lo, hi))"""

SQL_FORMAN_AUG = """,
common AS (
  SELECT e.gid, e.lo, e.hi, a.v AS node FROM edges e
  JOIN adj a ON a.gid = e.gid AND a.u = e.lo JOIN adj b ON b.gid = e.gid AND b.u = e.hi AND b.v = a.v),
t AS (SELECT gid, lo, hi, count(*) AS t FROM common GROUP BY ALL),
incident AS (
  SELECT e.gid, e.lo, e.hi, sum(1 / sqrt(e.w * a.w)) AS s
  FROM edges e JOIN adj a ON a.gid = e.gid AND
    ((a.u = e.lo AND a.v <> e.hi) OR (a.u = e.hi AND a.v <> e.lo))
  WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.gid = e.gid AND c.lo = e.lo AND c.hi = e.hi AND c.node = a.v)
  GROUP BY ALL),
curved AS (
  SELECT e.gid, e.lo, e.hi,
         e.w * (coalesce(t.t, 0) * e.w + 2 / e.w - coalesce(i.s, 0)) AS curvature
  FROM edges e LEFT JOIN t USING (gid, lo, hi) LEFT JOIN incident i USING (gid, lo, hi))"""

SQL_SUMMARY = """,
deg AS (SELECT gid, u AS node, count(*) AS degree FROM adj GROUP BY ALL),
summary AS (
  SELECT n.gid, count(*) AS n_nodes, count_if(degree IS NULL) AS n_isolated,
         CAST(coalesce(sum(degree), 0) / 2 AS BIGINT) AS n_edges
  FROM nodes n LEFT JOIN deg d ON d.gid = n.gid AND d.node = n.node GROUP BY n.gid)"""


def _attention(spark, sf):
    """The derived attention table, stored as captured attention would be."""
    return materialize(v.attention(spark, sf), "attention")


def _graph(spark, sf):
    """The top-k graphs, written once: curvature reads its edges many times."""
    edges, nodes = graph.attention_graph(_attention(spark, sf), KEYS, K)
    return materialize(edges, "edges"), nodes


@query(
    "w05_topk_edges",
    f"WITH {v.SQL_GRAPH} SELECT gid, src, dst, {sql_r6('w')} AS w FROM topk",
)
def w05(spark, sf):
    return graph.topk_edges(v.attention(spark, sf), KEYS, K).withColumn("w", r6("w"))


@query(
    "j08_symmetric_pairs",
    f"WITH {v.SQL_GRAPH} SELECT gid, src, dst, {sql_r6('w')} AS w FROM sym",
)
def j08(spark, sf):
    a = _attention(spark, sf)
    return graph.symmetric_weights(graph.topk_edges(a, KEYS, K), a, KEYS).select(
        "gid", "src", "dst", r6("w").alias("w")
    )


@query(
    "a10_collapse_edges",
    f"WITH {v.SQL_GRAPH} SELECT gid, lo, hi, {sql_r6('w')} AS w FROM edges",
)
def a10(spark, sf):
    return _graph(spark, sf)[0].withColumn("w", r6("w"))


@query(
    "j10_common_neighbours",
    f"""WITH {v.SQL_GRAPH}, common AS (SELECT e.gid, e.lo, e.hi, a.v FROM edges e
      JOIN adj a ON a.gid = e.gid AND a.u = e.lo JOIN adj b ON b.gid = e.gid AND b.u = e.hi AND b.v = a.v)
    SELECT gid, lo AS a, hi AS b, v AS c FROM common WHERE lo < hi AND hi < v""",
)
def j10(spark, sf):
    edges, _ = _graph(spark, sf)
    nodes = F.array_sort(F.array("a", "b", "c"))
    return graph.triangles(edges, KEYS).select(
        "gid",
        F.get(nodes, F.lit(0)).alias("a"),
        F.get(nodes, F.lit(1)).alias("b"),
        F.get(nodes, F.lit(2)).alias("c"),
    )


@query(
    "a11_degree_isolated",
    f"""WITH {v.SQL_GRAPH} {SQL_SUMMARY} SELECT gid, n_nodes, CAST(n_isolated AS BIGINT) AS n_isolated, n_edges
    FROM summary""",
)
def a11(spark, sf):
    edges, nodes = _graph(spark, sf)
    return graph.graph_summary(edges, nodes, KEYS)


@query(
    "a12_forman_1d",
    f"WITH {v.SQL_GRAPH} {SQL_FORMAN_1D} SELECT gid, lo, hi, {sql_r6('curvature')} AS curvature FROM curved",
)
def a12_1d(spark, sf):
    edges, _ = _graph(spark, sf)
    return graph.forman_edges(edges, KEYS, "1d").select("gid", "lo", "hi", r6("curvature").alias("curvature"))


@query(
    "a12_forman_augmented",
    f"WITH {v.SQL_GRAPH} {SQL_FORMAN_AUG} SELECT gid, lo, hi, {sql_r6('curvature')} AS curvature FROM curved",
)
def a12_aug(spark, sf):
    edges, _ = _graph(spark, sf)
    return graph.forman_edges(edges, KEYS).select("gid", "lo", "hi", r6("curvature").alias("curvature"))


@query(
    "c18_attention_graph_curvature",
    f"""WITH {v.SQL_GRAPH} {SQL_FORMAN_AUG} {SQL_SUMMARY}, m AS (
      SELECT gid, avg(curvature) AS c FROM curved GROUP BY gid)
    SELECT s.gid, n_nodes, CAST(n_isolated AS BIGINT) AS n_isolated, n_edges,
    CASE WHEN n_isolated = 0 AND n_edges > 0 THEN {sql_r6('c')} ELSE 'NaN'::DOUBLE END AS forman_ricci
    FROM summary s LEFT JOIN m USING (gid)""",
)
def c18(spark, sf):
    out = graph.attention_graph_curvature(_attention(spark, sf), KEYS, K)
    return out.withColumn("forman_ricci", r6("forman_ricci"))
