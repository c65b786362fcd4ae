"""Scores, intervals, fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.operators import compare, composite, functional, graph, pooled_control, series, spine, statistics
from attnstrata.session import scratch_path
from attnstrata.sources import tensors
from workloads import linear
from workloads.matching import sql_split
from workloads import views as v
from workloads.registry import query, r6, sql_r6, table

REPLICATES = 1000
#: Replicates of the functional fit, each with components and a regression of its own.
BANDS = 200


def scored_documents(spark, sf):
    """Labelled documents with two scores: their length and their source number."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("lang").alias("bin_id"),
        F.col("doc_id").cast("string").alias("event_id"),
        (F.col("quality") == 0).alias("is_fail"),
        F.col("n_chars").cast("double").alias("length"),
        F.substring("source", 4, 3).cast("double").alias("source_no"),
    )


SQL_SCORED = """
scored AS (
  SELECT lang AS bin_id, CAST(doc_id AS VARCHAR) AS event_id, quality = 0 AS is_fail,
         CAST(n_chars AS DOUBLE) AS length, CAST(substr(source, 4) AS DOUBLE) AS source_no
  FROM documents JOIN labels USING (doc_id))"""


def sql_auroc(name: str, source: str, score: str, keys: str = "bin_id", weight: str = "1") -> str:
    """CTE with (keys, n_pos, n_neg, auroc): average ranks, weights counted as copies."""
    return f"""
{name}_s AS (SELECT {keys}, {score} AS s, sum(CASE WHEN is_fail THEN {weight} ELSE 0 END) AS p,
    sum(CASE WHEN is_fail THEN 0 ELSE {weight} END) AS q FROM {source} GROUP BY ALL),
{name}_r AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY {keys} ORDER BY s
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_s),
{name} AS (SELECT {keys}, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg,
    CASE WHEN sum(p) > 0 AND sum(q) > 0
      THEN CAST(sum(p * (below + q / 2)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE)) END AS auroc
  FROM {name}_r GROUP BY {keys})"""


def sql_interval(name: str, source: str, score: str, replicates: int = REPLICATES) -> str:
    """CTE with the bootstrap bounds of the AUROC, drawn by the same hashes."""
    return f"""
{name}_i AS (SELECT *, row_number() OVER (PARTITION BY bin_id
    ORDER BY sha256('bootstrap-order:' || event_id), event_id) - 1 AS i,
    count(*) OVER (PARTITION BY bin_id) AS n FROM {source}),
{name}_d AS (SELECT bin_id, replicate,
    {v.sql_seed('bootstrap', "bin_id || '|' || replicate || '|' || i", 15)} % n AS i
  FROM {name}_i, range({replicates}) t(replicate)),
{name}_w AS (SELECT bin_id, replicate, i, count(*) AS w FROM {name}_d GROUP BY ALL),
{name}_x AS (SELECT x.bin_id, w.replicate, w.w, x.is_fail, x.{score}
  FROM {name}_w w JOIN {name}_i x ON x.bin_id = w.bin_id AND x.i = w.i),
{sql_auroc(name + '_a', name + '_x', score, 'bin_id, replicate', 'w')},
{name}_o AS (SELECT bin_id, auroc, row_number() OVER (PARTITION BY bin_id ORDER BY auroc) - 1 AS pos,
    count(*) OVER (PARTITION BY bin_id) AS m FROM {name}_a WHERE auroc IS NOT NULL),
{name} AS (SELECT bin_id, max(m) AS n_replicates,
    max(CASE WHEN pos = floor(m * 0.025) THEN auroc END) AS auroc_ci_lower,
    max(CASE WHEN pos = floor(m * 0.975) - 1 THEN auroc END) AS auroc_ci_upper FROM {name}_o GROUP BY bin_id)"""


@query(
    "a21_auroc",
    f"""WITH {SQL_SCORED}, {sql_auroc('a', 'scored', 'source_no')}
    SELECT bin_id, n_pos, n_neg, {sql_r6('auroc')} AS auroc FROM a""",
)
def a21(spark, sf):
    out = statistics.auroc(scored_documents(spark, sf), ["bin_id"], "is_fail", "source_no")
    return out.withColumn("auroc", r6("auroc"))


@query(
    "a21_auroc_lines",
    f"""WITH scored AS (SELECT l_linestatus AS bin_id, l_returnflag = 'R' AS is_fail, l_extendedprice AS price
      FROM lineitem), {sql_auroc('a', 'scored', 'price')}
    SELECT bin_id, n_pos, n_neg, {sql_r6('auroc')} AS auroc FROM a""",
)
def a21_lines(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("bin_id"),
        (F.col("l_returnflag") == "R").alias("is_fail"),
        F.col("l_extendedprice").alias("price"),
    )
    return statistics.auroc(li, ["bin_id"], "is_fail", "price").withColumn("auroc", r6("auroc"))


@query(
    "a22_bootstrap_auroc_ci",
    f"""WITH {SQL_SCORED}, {sql_interval('ci', 'scored', 'length')}
    SELECT bin_id, n_replicates, {sql_r6('auroc_ci_lower')} AS auroc_ci_lower,
    {sql_r6('auroc_ci_upper')} AS auroc_ci_upper FROM ci""",
)
def a22(spark, sf):
    out = statistics.bootstrap_auroc_ci(
        scored_documents(spark, sf), ["bin_id"], "is_fail", "length",
        id_col="event_id", replicates=REPLICATES,
    )
    return out.withColumns({c: r6(c) for c in ("auroc_ci_lower", "auroc_ci_upper")})


@query(
    "a23_pointwise_band",
    f"""SELECT event_type, CAST(hour(ts) AS INTEGER) AS layer, {sql_r6('quantile_cont(value, 0.025)')} AS ci_lower,
    {sql_r6('quantile_cont(value, 0.975)')} AS ci_upper FROM events GROUP BY ALL""",
)
def a23(spark, sf):
    samples = table(spark, sf, "events").select("event_type", F.hour("ts").alias("layer"), "value")
    out = statistics.pointwise_band(samples, ["event_type", "layer"], "value")
    return out.withColumns({c: r6(c) for c in ("ci_lower", "ci_upper")})


@query(
    "w07_cumulative_variance",
    """WITH q AS (SELECT l_returnflag, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL),
    s AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY q DESC, l_suppkey) AS component,
      CAST(q AS DOUBLE) / CAST(sum(q) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS share FROM q),
    c AS (SELECT *, sum(share) OVER (PARTITION BY l_returnflag ORDER BY component) AS cum FROM s)
    SELECT l_returnflag, CAST(least(count_if(cum < 0.25) + 1, 32, count(*)) AS BIGINT) AS n_fpcs
    FROM c GROUP BY l_returnflag""",
)
def w07(spark, sf):
    from pyspark.sql import Window

    q = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("q")
    )
    total = q.groupBy("l_returnflag").agg(F.sum("q").alias("total"))
    order = Window.partitionBy("l_returnflag").orderBy(F.desc("q"), "l_suppkey")
    shares = q.join(total, "l_returnflag").select(
        "l_returnflag", F.row_number().over(order).alias("component"), (F.col("q") / F.col("total")).alias("share")
    )
    return functional.cumulative_variance(shares, ["l_returnflag"], threshold=0.25)


def _every_seventh(start: int):
    entries = [F.get("embedding", F.lit(i)).cast("double") for i in range(start, 64, 7)]
    return sum(entries[1:], entries[0]) / len(entries)


def vector_events(spark, sf):
    """Embeddings as events: four neighbouring labels share a bin, the odd ones fail. A curve is the whole vector, and each
    feature the mean of every seventh entry.
    """
    e = table(spark, sf, "embeddings")
    return e.select(
        F.concat(F.lit("B"), (F.expr("label div 4") + 1).cast("string")).alias("bin_id"),
        F.col("vec_id").cast("string").alias("event_id"),
        (F.col("label") % 2 == 1).alias("is_fail"),
        F.transform("embedding", lambda x: x.cast("double")).alias("curve"),
        *[_every_seventh(i).alias(f) for i, f in enumerate(fixed.FEATURES)],
    )


def _rounded(fits):
    return fits.select(
        *[c for c in ("bin_id", "control") if c in fits.columns],
        r6("intercept").alias("intercept"),
        *[r6(F.get("coefficients", F.lit(i))).alias(f"coef_{i}") for i in range(7)],
        *[r6(c).alias(c) for c in ("auroc", "auroc_ci_lower", "auroc_ci_upper")],
        "n_events_train",
        "n_events_held_out",
    )


@query("c06_fit_composite")
def c06(spark, sf):
    return _rounded(composite.fit_composite(vector_events(spark, sf), replicates=REPLICATES))


@query("c07_fit_pooled_control")
def c07(spark, sf):
    return _rounded(pooled_control.fit_pooled_control(vector_events(spark, sf), replicates=REPLICATES))


def sql_single_fit(source: str, seed: str, key: str, least: int) -> str:
    """Held-out AUROC of a fit on one feature: its order is that of the feature, by the sign of the
    covariance with the label in the training rows.
    """
    return f"""WITH {SQL_SCORED}, rows_ AS (SELECT {key}, event_id, is_fail, length FROM {source}
      QUALIFY count(*) OVER (PARTITION BY {key}) >= {least}),
    {sql_split('parts', 'rows_', seed, key)},
    signs AS (SELECT {key}, covar_pop(length, CAST(is_fail AS INTEGER)) < 0 AS falls, count(*) AS n_events_train
      FROM parts WHERE NOT held_out GROUP BY {key}),
    held AS (SELECT p.{key}, is_fail, CASE WHEN falls THEN -length ELSE length END AS s
      FROM parts p JOIN signs USING ({key}) WHERE held_out),
    {sql_auroc('h', 'held', 's', key)}
    SELECT {key}, {sql_r6('auroc')} AS auroc, n_events_train, n_pos + n_neg AS n_events_held_out, 'fitted' AS status
    FROM h JOIN signs USING ({key})"""


SINGLE = ("auroc", "n_events_train", "n_events_held_out", "status")


@query("c06_c13_single_feature", sql_single_fit("scored", "composite", "bin_id", fixed.MIN_ROWS_PER_FIT))
def c06_single(spark, sf):
    fits = composite.fit_composite(
        scored_documents(spark, sf), features=["length"], bins=None, replicates=REPLICATES
    )
    return fits.select("bin_id", *SINGLE).withColumn("auroc", r6("auroc"))


@query(
    "c07_single_feature",
    sql_single_fit("(SELECT *, 'pooled_negative_control' AS control FROM scored)", "pooled", "control", 1),
)
def c07_single(spark, sf):
    fits = pooled_control.fit_pooled_control(scored_documents(spark, sf), features=["length"], replicates=REPLICATES)
    return fits.select("control", *SINGLE).withColumn("auroc", r6("auroc"))


@query("c13_fit_per_bin")
def c13(spark, sf):
    """Bins under the minimum number of rows get no fit."""
    fits = composite.fit_composite(vector_events(spark, sf), replicates=200, min_rows=fixed.MIN_ROWS_PER_FIT)
    return composite.auroc_report(_rounded(fits))


@query("c08_fit_fpca")
def c08(spark, sf):
    fit = functional.fit_fpca(vector_events(spark, sf), ["bin_id"])
    return fit.select(
        "bin_id", "n_curves", "n_fpcs", F.posexplode("shares").alias("component", "share")
    ).withColumn("share", r6("share"))


@query("c08_fpca_scores")
def c08_scores(spark, sf):
    e = vector_events(spark, sf).select("bin_id", "event_id", "curve")
    scores = functional.fpca_scores(e, functional.fit_fpca(e, ["bin_id"]), ["bin_id"])
    energy = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x)
    return scores.select("bin_id", "event_id", r6(energy).alias("score_energy"))


@query("c09_fit_functional_logistic")
def c09(spark, sf):
    e = vector_events(spark, sf).withColumn("edge_type", F.lit(fixed.EDGE_TYPES[0]))
    _, beta = functional.fit_functional_logistic(e, replicates=BANDS)
    return beta.select(
        "bin_id", "edge_type", "layer", *[r6(c).alias(c) for c in ("beta", "beta_ci_lower", "beta_ci_upper")]
    )


@query("c10_long_lines")
def c10(spark, sf):
    """Every vector is one series of 64 positions of its label's head."""
    atomic = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("event_id"),
        F.lit(0).alias("layer"),
        F.col("label").alias("head"),
        F.posexplode("embedding").alias("rel_pos", "grassmannian_qkt"),
    )
    return functional.long_lines(atomic, threshold=1.0)


def _mean_summary(spark, sf):
    """A feature summary of the captured vectors: seven query entries per head."""
    c = v.captured(spark, sf).select(
        *linear.HEAD, *[x.alias(f) for x, f in zip(v.seven(), fixed.FEATURES, strict=True)]
    )
    return statistics.summarize(c, linear.HEAD, fixed.FEATURES)


def captured_events(spark, sf):
    return v.captured(spark, sf).select("event_id").distinct().select(
        "event_id",
        F.concat(F.lit("B"), (F.col("event_id") % 6 + 1).cast("string")).alias("bin_id"),
        (F.col("event_id") % 2 == 0).alias("is_fail"),
    )


SQL_FEATURES = ", ".join(
    f"{sql_r6(f'avg(f{i})')} AS {f}" for i, f in enumerate(fixed.FEATURES)
)
SQL_HEAD_MEANS = ", ".join(f"avg({x}) AS f{i}" for i, x in enumerate(v.SQL_SEVEN))


@query(
    "c11_event_feature_matrix",
    f"""WITH {v.SQL_CAPTURED}, h AS (SELECT event_id, layer, head, {SQL_HEAD_MEANS} FROM captured GROUP BY ALL)
    SELECT event_id, 'B' || (event_id % 6 + 1) AS bin_id, event_id % 2 = 0 AS is_fail, {SQL_FEATURES}
    FROM h GROUP BY event_id""",
)
def c11(spark, sf):
    out = spine.event_feature_matrix(captured_events(spark, sf), _mean_summary(spark, sf))
    return out.withColumns({f: r6(f) for f in fixed.FEATURES})


@query(
    "j02_events_with_summary",
    f"""WITH {v.SQL_CAPTURED}, h AS (SELECT event_id, layer, head, {SQL_HEAD_MEANS} FROM captured GROUP BY ALL)
    SELECT event_id, 'B' || (event_id % 6 + 1) AS bin_id, event_id % 2 = 0 AS is_fail, {SQL_FEATURES}
    FROM h WHERE event_id % 3 <> 0 GROUP BY event_id""",
)
def j02(spark, sf):
    """The summary table as it is stored, joined with a part of the events: each event has one row with all its features."""
    path = scratch_path(spark, "summary")
    tensors.write_atomic_summary(_mean_summary(spark, sf).withColumn("event_id", F.col("event_id").cast("string")), path)
    events = captured_events(spark, sf).where("event_id % 3 <> 0").withColumn("event_id", F.col("event_id").cast("string"))
    out = spine.event_feature_matrix(events, tensors.read_atomic_summary(spark, path))
    return out.withColumn("event_id", F.col("event_id").cast("long")).withColumns({f: r6(F.col(f).cast("double")) for f in fixed.FEATURES})


@query(
    "j03_events_with_edges",
    f"""WITH {linear.SQL_EDGES}, ev AS (SELECT DISTINCT unnest([vec_id // 250, vec_id // 250 + 1]) AS event_id FROM embeddings)
    SELECT event_id, count(h_i) AS n_edges, count(h_i) = 0 AS skipped
    FROM ev LEFT JOIN edges USING (event_id) GROUP BY event_id""",
)
def j03(spark, sf):
    """Events without stored edges are skipped by the join and listed apart."""
    edges = linear.trace_edges(spark, sf)
    here = F.expr("vec_id div 250")
    events = table(spark, sf, "embeddings").select(
        F.explode(F.array(here, here + 1)).alias("event_id")
    ).distinct()
    found = events.join(edges, "event_id").groupBy("event_id").agg(F.count(F.lit(1)).alias("n_edges"))
    skipped = spine.missing_events(events, edges).select("event_id", F.lit(0).cast("bigint").alias("n_edges"))
    return found.withColumn("skipped", F.lit(False)).unionByName(skipped.withColumn("skipped", F.lit(True)))


@query(
    "c12_spine_curves_by_bin",
    f"""WITH {linear.SQL_EDGES} SELECT event_id, 'B' || (event_id % 6 + 1) AS bin_id, event_id % 2 = 0 AS is_fail,
    'qkt_grassmannian' AS edge_type, layer, {sql_r6('sum(dist) * 2 / 100')} AS mean_distance
    FROM edges GROUP BY event_id, layer""",
)
def c12(spark, sf):
    edges = linear.trace_edges(spark, sf).withColumn("edge_type", F.lit("qkt_grassmannian"))
    both = edges.withColumn("lookback_j", F.explode(F.array(F.lit(0), F.lit(1))))
    curves = spine.spine_curves_by_bin(
        captured_events(spark, sf), both, n_heads=v.N_HEADS, edge_type="qkt_grassmannian"
    )
    return curves.select(
        "event_id", "bin_id", "is_fail", "edge_type", F.posexplode("curve").alias("layer", "mean_distance")
    ).withColumn("mean_distance", r6("mean_distance"))


SWEEP_BINS = ("B1", "B2", "B3")


def vector_attention(spark, sf):
    """Each vector as attention among eight tokens: entry 8 i + j is the weight from token i to j, shifted to be positive."""
    at = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("event_id"), F.posexplode("embedding").alias("at", "x")
    )
    return at.select(
        "event_id", F.expr("at div 8").cast("int").alias("src"), (F.col("at") % 8).alias("dst"), F.exp(F.col("x").cast("double")).alias("w")
    )


KS = (2, 3, 5)

SQL_NESTED = """
attn AS (
  SELECT vec_id::VARCHAR AS event_id, CAST((i - 1) // 8 AS INTEGER) AS src, CAST((i - 1) % 8 AS INTEGER) AS dst, exp(embedding[i]::DOUBLE) AS w
  FROM embeddings, range(1, 65) r(i)),
topk AS (
  SELECT attn.*, k FROM attn, (SELECT unnest([2, 3, 5]) AS k) WHERE src <> dst
  QUALIFY row_number() OVER (PARTITION BY event_id, k, src ORDER BY w DESC, dst) <= k),
sym AS (
  SELECT t.event_id, t.k, t.src, t.dst, (t.w + coalesce(b.w, 0)) * 0.5 AS w
  FROM topk t LEFT JOIN attn b ON b.event_id = t.event_id AND b.src = t.dst AND b.dst = t.src),
edges AS (SELECT event_id, k, least(src, dst) AS lo, greatest(src, dst) AS hi, max(w) AS w FROM sym GROUP BY ALL),
adj AS (SELECT event_id, k, lo AS u, hi AS v, w FROM edges UNION ALL SELECT event_id, k, hi, lo, w FROM edges),
common AS (
  SELECT e.event_id, e.k, e.lo, e.hi, a.v AS node FROM edges e
  JOIN adj a ON a.event_id = e.event_id AND a.k = e.k AND a.u = e.lo
  JOIN adj b ON b.event_id = e.event_id AND b.k = e.k AND b.u = e.hi AND b.v = a.v),
t AS (SELECT event_id, k, lo, hi, count(*) AS t FROM common GROUP BY ALL),
incident AS (
  SELECT e.event_id, e.k, e.lo, e.hi, sum(1 / sqrt(e.w * a.w)) AS s
  FROM edges e JOIN adj a ON a.event_id = e.event_id AND a.k = e.k AND ((a.u = e.lo AND a.v <> e.hi) OR (a.u = e.hi AND a.v <> e.lo))
  ANTI JOIN common c ON c.event_id = e.event_id AND c.k = e.k AND c.lo = e.lo AND c.hi = e.hi AND c.node = a.v
  GROUP BY ALL)"""


@query(
    "c14_curvature_from_attention",
    f"""WITH {SQL_NESTED} SELECT e.event_id, CAST(e.k AS INTEGER) AS k, {sql_r6('avg(e.w * (coalesce(t.t, 0) * e.w + 2 / e.w - coalesce(i.s, 0)))')} AS forman_ricci
    FROM edges e LEFT JOIN t USING (event_id, k, lo, hi) LEFT JOIN incident i USING (event_id, k, lo, hi) GROUP BY e.event_id, e.k""",
)
def c14_curvature(spark, sf):
    """The curvature that the sweep adds, for all k from one ranking of the edges; no node of eight is alone."""
    out = graph.nested_curvature(vector_attention(spark, sf), ["event_id"], KS)
    return out.select("event_id", "k", r6("forman_ricci").alias("forman_ricci"))


@query("c14_k_sweep")
def c14(spark, sf):
    """From attention to the gain of each k, with the operator's own number of replicates."""
    e = vector_events(spark, sf)
    spectral = [f for f in fixed.FEATURES if f != fixed.RICCI_FEATURE]
    gains, _ = compare.k_sweep(
        e.select("event_id", "bin_id", "is_fail"), e.select("event_id", *spectral), vector_attention(spark, sf),
        bins=SWEEP_BINS, candidates=KS,
    )
    return gains.withColumn("gain", r6("gain"))
