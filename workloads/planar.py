"""M01-M08 on 2 x 2 head operators, where SQL has closed forms for the spectrum.

The whole embedding table is used: two neighbouring entries of each half of a vector are the query and key of a layer, 16 in all,
and the label modulo three is the head, so every layer has three heads.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.operators import functional, matrices, spine
from workloads import models
from workloads.registry import query, r6, sql_r6, table

HEAD = ["event_id", "layer", "head"]

SQL_PLANAR = """
planar AS (
  SELECT vec_id // 250 AS event_id, CAST(layer AS INTEGER) AS layer, CAST(label % 3 AS INTEGER) AS head,
         [embedding[2 * layer + 1]::DOUBLE, embedding[2 * layer + 2]::DOUBLE] AS q,
         [embedding[2 * layer + 33]::DOUBLE, embedding[2 * layer + 34]::DOUBLE] AS k
  FROM embeddings, range(16) r(layer)),
m2 AS (
  SELECT event_id, layer, head, 'qkt' AS kind, sum(q[1] * k[1]) AS a, sum(q[1] * k[2]) AS b,
         sum(q[2] * k[1]) AS c, sum(q[2] * k[2]) AS d FROM planar GROUP BY ALL
  UNION ALL
  SELECT event_id, layer, head, 'avwo', sum(q[1] * q[1]), sum(q[1] * q[2]), sum(q[2] * q[1]), sum(q[2] * q[2])
  FROM planar GROUP BY ALL),
s2 AS (
  SELECT *, a * a + b * b + c * c + d * d AS f, a * d - b * c AS det,
         a * a + b * b AS p, a * c + b * d AS r, c * c + d * d AS t FROM m2),
e2 AS (SELECT *, (f + sqrt((p - t) * (p - t) + 4 * r * r)) / 2 AS l1 FROM s2),
v2 AS (
  SELECT *, CASE WHEN p >= t THEN l1 - t ELSE r END AS x, CASE WHEN p >= t THEN r ELSE l1 - p END AS y,
         l1 / f AS p1, det * det / l1 / f AS p2 FROM e2),
spectral AS (
  SELECT event_id, layer, head, kind, f / l1 AS stable_rank, sqrt(2) * abs(y) / sqrt(x * x + y * y) AS grassmannian,
         -(p1 * ln(p1)) - CASE WHEN p2 > 1e-300 THEN p2 * ln(p2) ELSE 0 END AS spectral_entropy,
         x / sqrt(x * x + y * y) AS ux, y / sqrt(x * x + y * y) AS uy FROM v2),
pairs AS (
  SELECT a.event_id, a.layer, a.kind || '_grassmannian' AS edge_type, a.head AS h_i, b.head AS h_j,
         sqrt(2) * abs(a.ux * b.uy - a.uy * b.ux) AS dist
  FROM spectral a JOIN spectral b ON a.event_id = b.event_id AND a.layer = b.layer AND a.kind = b.kind AND a.head < b.head),
spine AS (
  SELECT event_id, edge_type, layer, avg(dist) AS mean_grassmannian,
         CASE WHEN avg(dist) = 0 THEN 0 ELSE stddev_pop(dist) / avg(dist) END AS modularity,
         sum(1 / (1 + dist)) - sqrt(greatest(0, 1.5 * sum(1 / (1 + dist) * (1 / (1 + dist)))
           - 0.5 * sum(1 / (1 + dist)) * sum(1 / (1 + dist)))) AS spectral_gap
  FROM pairs GROUP BY event_id, edge_type, layer)"""


def planar(spark, sf):
    pair = lambda at: F.array(
        *[F.get("embedding", F.col("layer") * 2 + at + i).cast("double") for i in range(2)]
    )
    e = table(spark, sf, "embeddings")
    return e.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(
        F.expr("vec_id div 250").alias("event_id"),
        "layer",
        (F.col("label") % 3).cast("int").alias("head"),
        pair(0).alias("q"),
        pair(32).alias("k"),
    )


def operators(spark, sf):
    p = planar(spark, sf)
    return (
        matrices.gram(p, HEAD, "q", "k")
        .withColumn("kind", F.lit("qkt"))
        .unionByName(matrices.gram(p, HEAD, "q").withColumn("kind", F.lit("avwo")))
    )


def edges(spark, sf):
    out = matrices.grassmann_pairs(operators(spark, sf), ["event_id", "layer", "kind"], k=1)
    return out.withColumn("edge_type", F.concat("kind", F.lit("_grassmannian"))).drop("kind")


def _spectral(spark, sf, column):
    out = matrices.spectral_features(operators(spark, sf), [*HEAD, "kind"], 1)
    return out.select(*HEAD, "kind", r6(column).alias(column))


def _sql(column):
    return f"WITH {SQL_PLANAR} SELECT event_id, layer, head, kind, {sql_r6(column)} AS {column} FROM spectral"


@query("m01_stable_rank_planar", _sql("stable_rank"))
def m01(spark, sf):
    return _spectral(spark, sf, "stable_rank")


@query("m02_spectral_entropy_planar", _sql("spectral_entropy"))
def m02(spark, sf):
    return _spectral(spark, sf, "spectral_entropy")


@query(
    "m03_topk_projector_planar",
    f"""WITH {SQL_PLANAR} SELECT event_id, layer, head, kind, {sql_r6('ux * ux')} AS p00,
    {sql_r6('ux * uy')} AS p01, {sql_r6('uy * uy')} AS p11 FROM spectral""",
)
def m03(spark, sf):
    b = matrices.decompose(operators(spark, sf), [*HEAD, "kind"], 1)
    u = [F.get(F.get("basis", F.lit(i)), F.lit(0)) for i in range(2)]
    return b.select(
        *HEAD, "kind", r6(u[0] * u[0]).alias("p00"), r6(u[0] * u[1]).alias("p01"), r6(u[1] * u[1]).alias("p11")
    )


@query("m04_grassmann_to_axes_planar", _sql("grassmannian"))
def m04(spark, sf):
    return _spectral(spark, sf, "grassmannian")


@query(
    "m05_grassmann_pairs_planar",
    f"WITH {SQL_PLANAR} SELECT event_id, layer, edge_type, h_i, h_j, {sql_r6('dist')} AS dist FROM pairs",
)
def m05(spark, sf):
    return edges(spark, sf).withColumn("dist", r6("dist"))


FEATURE_SQL = ", ".join(
    f"{sql_r6(f'''max(CASE WHEN kind = '{kind}' THEN {name} END)''')} AS {name}_{kind}"
    for kind in ("qkt", "avwo")
    for name in ("stable_rank", "grassmannian", "spectral_entropy")
)


@query(
    "m06_atomic_features_planar",
    f"""WITH {SQL_PLANAR} SELECT event_id, layer, head, {FEATURE_SQL},
    'NaN'::DOUBLE AS {fixed.RICCI_FEATURE} FROM spectral GROUP BY event_id, layer, head""",
)
def m06(spark, sf):
    out = matrices.atomic_features(operators(spark, sf), HEAD, k=1)
    return out.select(*HEAD, *[r6(f).alias(f) for f in fixed.FEATURES])


@query(
    "m07_spectral_gap_planar",
    f"WITH {SQL_PLANAR} SELECT event_id, edge_type, layer, {sql_r6('spectral_gap')} AS spectral_gap FROM spine",
)
def m07(spark, sf):
    out = spine.spectral_gap(edges(spark, sf), ["event_id", "edge_type", "layer"])
    return out.withColumn("spectral_gap", r6("spectral_gap"))


SPINE = ("mean_grassmannian", "spectral_gap", "modularity")


@query(
    "m08_spine_curve_planar",
    f"""WITH {SQL_PLANAR} SELECT event_id, edge_type, layer, {', '.join(sql_r6(c) + ' AS ' + c for c in SPINE)},
    'NaN'::DOUBLE AS mean_forman_ricci FROM spine""",
)
def m08(spark, sf):
    atomic = matrices.atomic_features(operators(spark, sf), HEAD, k=1)
    out = spine.spine_curve(edges(spark, sf), atomic)
    return out.select(
        "event_id", "edge_type", "layer", *[r6(c).alias(c) for c in SPINE], "mean_forman_ricci"
    )


SQL_CURVES = """
curves AS (
  SELECT 'B' || (label // 4 + 1) AS bin_id, vec_id, CAST(i - 1 AS INTEGER) AS i, embedding[i]::DOUBLE AS x
  FROM embeddings, range(1, 65) r(i)),
centred AS (SELECT *, x - avg(x) OVER (PARTITION BY bin_id, i) AS z FROM curves)"""


@query(
    "c08_fpca_concentration",
    f"""WITH {SQL_CURVES}, cov AS (
      SELECT a.bin_id, a.i, b.i AS j, sum(a.z * b.z) AS c FROM centred a JOIN centred b
      ON a.bin_id = b.bin_id AND a.vec_id = b.vec_id GROUP BY ALL)
    SELECT bin_id, (SELECT count(DISTINCT vec_id) FROM curves k WHERE k.bin_id = cov.bin_id) AS n_curves,
    {sql_r6('sum(c * c) / (sum(CASE WHEN i = j THEN c END) * sum(CASE WHEN i = j THEN c END))')} AS concentration
    FROM cov GROUP BY bin_id""",
)
def c08_concentration(spark, sf):
    """Sum of squared variance shares over all components, which SQL has as a norm."""
    fit = functional.fit_fpca(models.vector_events(spark, sf), ["bin_id"], threshold=2.0, max_fpcs=64)
    squares = F.aggregate("shares", F.lit(0.0), lambda a, s: a + s * s)
    return fit.select("bin_id", "n_curves", r6(squares).alias("concentration"))


@query(
    "c08_fpca_full_scores",
    f"""WITH {SQL_CURVES} SELECT bin_id, vec_id::VARCHAR AS event_id, {sql_r6('sum(z * z)')} AS score_energy
    FROM centred GROUP BY bin_id, vec_id""",
)
def c08_full_scores(spark, sf):
    """With every component kept, a curve's scores carry all of its centred energy."""
    e = models.vector_events(spark, sf).select("bin_id", "event_id", "curve")
    fit = functional.fit_fpca(e, ["bin_id"], threshold=2.0, max_fpcs=64)
    energy = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x)
    return functional.fpca_scores(e, fit, ["bin_id"]).select(
        "bin_id", "event_id", r6(energy).alias("score_energy")
    )
