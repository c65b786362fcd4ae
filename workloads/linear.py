"""Matrices and per-layer aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.operators import matrices, spine, statistics
from workloads import views as v
from workloads.registry import query, r6, sql_r6, table

HEAD = ["event_id", "layer", "head"]


def qkt(spark, sf):
    return matrices.gram(v.captured(spark, sf), HEAD, "q", "k")


def qq(spark, sf):
    return matrices.gram(v.captured(spark, sf), HEAD, "q")


def both_kinds(spark, sf):
    """Both operators of every head; the second one is the Gram of its own vectors."""
    return qkt(spark, sf).withColumn("kind", F.lit("qkt")).unionByName(
        qq(spark, sf).withColumn("kind", F.lit("avwo"))
    )


def head_edges(spark, sf):
    """Subspace distances between the heads of a layer, for both operators."""
    pairs = matrices.grassmann_pairs(both_kinds(spark, sf), ["event_id", "layer", "kind"], k=v.K_GRASS)
    return pairs.withColumn("edge_type", F.concat("kind", F.lit("_grassmannian"))).drop("kind")


# Native distances between heads, so that SQL can rebuild them: differences of the
# Gram diagonals instead of subspaces.
SQL_EDGES = v.SQL_CAPTURED + """,
diag AS (SELECT event_id, layer, head, sum(qq) AS t FROM entries WHERE i = j GROUP BY ALL),
edges AS (
  SELECT a.event_id, a.layer, a.head AS h_i, b.head AS h_j, abs(a.t - b.t) AS dist
  FROM diag a JOIN diag b ON a.event_id = b.event_id AND a.layer = b.layer AND a.head < b.head)"""


def trace_edges(spark, sf):
    """Head pairs with the gap between their vectors' total energy as distance."""
    energy = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    t = v.captured(spark, sf).groupBy(*HEAD).agg(F.sum(energy).alias("t"))
    pairs = matrices.head_pairs(t, ["event_id", "layer"])
    side = lambda h, n: t.select("event_id", "layer", F.col("head").alias(h), F.col("t").alias(n))
    return (
        pairs.join(side("h_i", "a"), ["event_id", "layer", "h_i"])
        .join(side("h_j", "b"), ["event_id", "layer", "h_j"])
        .select("event_id", "layer", "h_i", "h_j", F.abs(F.col("a") - F.col("b")).alias("dist"))
    )


#: All entries of both captured vectors.
ENTRIES = [f"{vector}{i}" for vector in "qk" for i in range(v.D_HEAD)]


def entries(spark, sf):
    return v.captured(spark, sf).select(*HEAD, *[F.get(n[0], F.lit(int(n[1]))).alias(n) for n in ENTRIES])


@query(
    "a05_atomic_summary",
    f"""WITH f AS (SELECT event_id, layer, head, unnest({ENTRIES}) AS feature, unnest(list_concat(q, k)) AS x
      FROM ({'WITH ' + v.SQL_CAPTURED + ' SELECT * FROM captured'}))
    SELECT event_id, layer, head, feature, {sql_r6('avg(x)')} AS mean, {sql_r6('quantile_cont(x, 0.1)')} AS p10,
    {sql_r6('quantile_cont(x, 0.5)')} AS p50, {sql_r6('quantile_cont(x, 0.9)')} AS p90,
    {sql_r6('stddev_pop(x)')} AS std FROM f GROUP BY ALL""",
)
def a05(spark, sf):
    out = statistics.summarize(entries(spark, sf), HEAD, ENTRIES)
    return out.select(*HEAD, "feature", *[r6(x).alias(x) for x in ("mean", "p10", "p50", "p90", "std")])


@query(
    "a05_summary_large_groups",
    f"""SELECT event_type, 'value' AS feature, {sql_r6('avg(value)')} AS mean,
    {sql_r6('quantile_cont(value, 0.1)')} AS p10, {sql_r6('quantile_cont(value, 0.5)')} AS p50,
    {sql_r6('quantile_cont(value, 0.9)')} AS p90, {sql_r6('stddev_pop(value)')} AS std
    FROM events GROUP BY event_type""",
)
def a05_large(spark, sf):
    out = statistics.summarize(table(spark, sf, "events"), ["event_type"], ["value"], large_groups=True)
    return out.select("event_type", "feature", *[r6(x).alias(x) for x in ("mean", "p10", "p50", "p90", "std")])


@query(
    "a04_event_features",
    f"""WITH {v.SQL_CAPTURED}, m AS (SELECT event_id, layer, head, {', '.join(f'avg({n[0]}[{int(n[1]) + 1}]) AS {n}' for n in ENTRIES)}
      FROM captured GROUP BY ALL)
    SELECT event_id, {', '.join(f'{sql_r6(f"avg({n})")} AS {n}' for n in ENTRIES if n != 'k0')},
    CASE WHEN event_id = 0 THEN 'NaN'::DOUBLE ELSE {sql_r6('avg(k0)')} END AS k0 FROM m GROUP BY event_id""",
)
def a04(spark, sf):
    """One feature has a NaN in the first event: it poisons that feature of that event only."""
    k0 = F.when((F.col("event_id") == 0) & (F.col("head") == 0), F.lit(float("nan"))).otherwise(F.col("k0"))
    summary = statistics.summarize(entries(spark, sf).withColumn("k0", k0), HEAD, ENTRIES)
    out = statistics.event_features(summary, ["event_id"], ENTRIES)
    return out.select("event_id", *[r6(n).alias(n) for n in ENTRIES])


@query(
    "a06_layer_curve",
    f"""WITH {SQL_EDGES} SELECT event_id, layer, {sql_r6('sum(dist) * 2 / 100')} AS mean_distance
    FROM edges GROUP BY ALL""",
)
def a06(spark, sf):
    out = spine.layer_curve(trace_edges(spark, sf), n_heads=v.N_HEADS, keys=["event_id"])
    return out.select("event_id", "layer", r6("mean_distance").alias("mean_distance"))


@query(
    "a07_mean_edge",
    f"WITH {SQL_EDGES} SELECT event_id, layer, {sql_r6('avg(dist)')} AS mean_grassmannian FROM edges GROUP BY ALL",
)
def a07(spark, sf):
    out = spine.edge_aggregates(trace_edges(spark, sf), ["event_id", "layer"])
    return out.select("event_id", "layer", r6("mean_grassmannian").alias("mean_grassmannian"))


@query(
    "a08_modularity",
    f"""WITH {SQL_EDGES} SELECT event_id, layer, {sql_r6('CASE WHEN avg(dist) = 0 THEN 0 ELSE stddev_pop(dist) / avg(dist) END')}
    AS modularity FROM edges GROUP BY ALL""",
)
def a08(spark, sf):
    out = spine.edge_aggregates(trace_edges(spark, sf), ["event_id", "layer"])
    return out.select("event_id", "layer", r6("modularity").alias("modularity"))


@query(
    "a09_nan_mean",
    f"""WITH {v.SQL_CAPTURED}, h AS (SELECT event_id, layer, head, avg(list_sum(list_concat(q, k))) AS x FROM captured GROUP BY ALL)
    SELECT event_id, layer, CASE WHEN layer = 3 THEN 'NaN'::DOUBLE ELSE
      {sql_r6('avg(CASE WHEN head % 3 <> 0 THEN x END)')} END AS mean_forman_ricci FROM h GROUP BY event_id, layer""",
)
def a09(spark, sf):
    total = F.aggregate(F.concat("q", "k"), F.lit(0.0), lambda a, x: a + x)
    h = v.captured(spark, sf).groupBy(*HEAD).agg(F.avg(total).alias("x"))
    hole = (F.col("head") % 3 == 0) | (F.col("layer") == 3)
    atomic = h.withColumn(fixed.RICCI_FEATURE, F.when(hole, F.lit(float("nan"))).otherwise(F.col("x")))
    out = spine.mean_curvature(atomic, ["event_id", "layer"])
    return out.select("event_id", "layer", r6("mean_forman_ricci").alias("mean_forman_ricci"))


def _rows(m):
    return m.select(*[c for c in m.columns if c != "row"], F.posexplode("row").alias("col_idx", "x"))


@query(
    "a13_frobenius_sq",
    f"WITH {v.SQL_CAPTURED} SELECT event_id, layer, head, {sql_r6('sum(qk * qk)')} AS frobenius_sq FROM entries GROUP BY ALL",
)
def a13(spark, sf):
    out = matrices.frobenius_sq(qkt(spark, sf), HEAD)
    return out.select(*HEAD, r6("frobenius_sq").alias("frobenius_sq"))


@query(
    "a14_gram_qkt",
    f"""WITH {v.SQL_CAPTURED} SELECT event_id, layer, head, i AS row_idx, j AS col_idx, {sql_r6('qk')} AS x FROM entries""",
)
def a14(spark, sf):
    return _rows(qkt(spark, sf)).withColumn("x", r6("x"))


@query(
    "a14_gram_embeddings",
    f"""SELECT label, CAST(i - 1 AS INTEGER) AS row_idx, CAST(j - 1 AS INTEGER) AS col_idx,
    {sql_r6('sum(embedding[i]::DOUBLE * embedding[j]::DOUBLE)')} AS x
    FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL""",
)
def a14_full(spark, sf):
    return _rows(matrices.gram(table(spark, sf, "embeddings"), ["label"], "embedding")).withColumn("x", r6("x"))


SQL_SLOTS = """
weights AS (
  SELECT l_returnflag AS gid, l_suppkey AS src, l_linenumber AS dst, sum(CAST(l_quantity AS BIGINT)) AS q
  FROM lineitem GROUP BY ALL),
shares AS (
  SELECT gid, src, dst, CAST(q AS DOUBLE) / CAST(sum(q) OVER (PARTITION BY gid, src) AS DOUBLE) AS w FROM weights),
slots AS (
  SELECT label AS token, CAST(i - 1 AS INTEGER) AS i, avg(embedding[i]::DOUBLE) AS v
  FROM embeddings, range(1, 65) r(i) GROUP BY ALL)"""


def slot_attention(spark, sf):
    """Suppliers attending to order-line slots by quantity share, per return flag."""
    li = table(spark, sf, "lineitem")
    q = li.groupBy(
        F.col("l_returnflag").alias("gid"), F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("dst")
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    total = q.groupBy("gid", "src").agg(F.sum("q").alias("total"))
    attn = q.join(total, ["gid", "src"]).select("gid", "src", "dst", (F.col("q") / F.col("total")).alias("w"))
    e = table(spark, sf, "embeddings")
    means = e.groupBy("label").agg(
        F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("v")
    )
    gids = li.select(F.col("l_returnflag").alias("gid")).distinct()
    flags = gids.agg(F.collect_set("gid").alias("g")).scalar()
    values = means.select(F.explode(flags).alias("gid"), F.col("label").alias("token"), "v")
    return attn, values


@query(
    "j11_weighted_context",
    f"""WITH {SQL_SLOTS} SELECT s.gid, s.src, t.i AS dim, {sql_r6('sum(s.w * t.v)')} AS context
    FROM shares s JOIN slots t ON t.token = s.dst GROUP BY ALL""",
)
def j11(spark, sf):
    attn, values = slot_attention(spark, sf)
    out = matrices.weighted_context(attn, values, ["gid"])
    return out.select("gid", "src", F.posexplode("context").alias("dim", "context")).withColumn(
        "context", r6("context")
    )


@query(
    "a14_gram_context",
    f"""WITH {SQL_SLOTS}, c AS (SELECT s.gid, s.src, t.i, sum(s.w * t.v) AS x
      FROM shares s JOIN slots t ON t.token = s.dst GROUP BY ALL)
    SELECT a.gid, a.i AS row_idx, b.i AS col_idx, {sql_r6('sum(a.x * b.x)')} AS x
    FROM c a JOIN c b ON a.gid = b.gid AND a.src = b.src GROUP BY ALL""",
)
def a14_context(spark, sf):
    """The output-side operator: the Gram of the context vectors of each key."""
    attn, values = slot_attention(spark, sf)
    context = matrices.weighted_context(attn, values, ["gid"])
    return _rows(matrices.gram(context, ["gid"], "context")).withColumn("x", r6("x"))


@query(
    "j09_head_pairs",
    f"""WITH {v.SQL_CAPTURED}, h AS (SELECT DISTINCT event_id, layer, head FROM captured)
    SELECT a.event_id, a.layer, a.head AS h_i, b.head AS h_j FROM h a JOIN h b
    ON a.event_id = b.event_id AND a.layer = b.layer AND a.head < b.head""",
)
def j09(spark, sf):
    return matrices.head_pairs(v.captured(spark, sf), ["event_id", "layer"])


@query("m01_stable_rank")
def m01(spark, sf):
    out = matrices.spectral_features(qkt(spark, sf), HEAD, v.K_GRASS)
    return out.select(*HEAD, r6("stable_rank").alias("stable_rank"))


@query("m02_spectral_entropy")
def m02(spark, sf):
    out = matrices.spectral_features(qkt(spark, sf), HEAD, v.K_GRASS)
    return out.select(*HEAD, r6("spectral_entropy").alias("spectral_entropy"))


@query("m03_topk_projector")
def m03(spark, sf):
    """Projector entries from the leading basis: free of the basis' signs."""
    b = matrices.decompose(qkt(spark, sf), HEAD, v.K_GRASS)
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t
    )
    rows = b.select(*HEAD, "basis", F.posexplode("basis").alias("row_idx", "u"))
    full = rows.select(
        *HEAD, "row_idx", F.posexplode(F.transform("basis", lambda w: dot(F.col("u"), w))).alias("col_idx", "p")
    )
    return full.withColumn("p", r6("p"))


@query("m04_grassmann_to_axes")
def m04(spark, sf):
    out = matrices.decompose(qkt(spark, sf), HEAD, v.K_GRASS)
    return out.select(*HEAD, r6("axes_distance").alias("grassmannian"))


@query("m05_grassmann_pairs")
def m05(spark, sf):
    return head_edges(spark, sf).withColumn("dist", r6("dist"))


@query("m06_atomic_features")
def m06(spark, sf):
    out = matrices.atomic_features(both_kinds(spark, sf), HEAD, k=v.K_GRASS)
    return out.select(*HEAD, *[r6(f).alias(f) for f in fixed.FEATURES])


@query("m07_spectral_gap")
def m07(spark, sf):
    out = spine.spectral_gap(head_edges(spark, sf), ["event_id", "edge_type", "layer"])
    return out.withColumn("spectral_gap", r6("spectral_gap"))


@query(
    "m07_head_degrees",
    f"""WITH {SQL_EDGES}, e AS (SELECT event_id, layer, unnest([h_i, h_j]) AS head, 1 / (1 + dist) AS w FROM edges)
    SELECT event_id, layer, head, {sql_r6('sum(w)')} AS degree FROM e GROUP BY ALL""",
)
def m07_degrees(spark, sf):
    out = spine.head_degrees(trace_edges(spark, sf), ["event_id", "layer"])
    return out.withColumn("degree", r6("degree"))


@query("m08_spine_curve")
def m08(spark, sf):
    atomic = matrices.atomic_features(both_kinds(spark, sf), HEAD, k=v.K_GRASS)
    out = spine.spine_curve(head_edges(spark, sf), atomic)
    names = ("mean_grassmannian", "spectral_gap", "mean_forman_ricci", "modularity")
    return out.select("event_id", "edge_type", "layer", *[r6(n).alias(n) for n in names])


@query(
    "m09_edges_to_dense",
    f"""WITH {SQL_EDGES} SELECT event_id, layer, h_i AS i, h_j AS j, {sql_r6('dist')} AS v FROM edges
    UNION ALL SELECT event_id, layer, h_j, h_i, {sql_r6('dist')} FROM edges
    UNION ALL SELECT DISTINCT event_id, layer, head, head, 0.0::DOUBLE FROM diag""",
)
def m09(spark, sf):
    return matrices.edges_to_dense(trace_edges(spark, sf), ["event_id", "layer"]).withColumn("v", r6("v"))
