"""Results against results."""

from __future__ import annotations

from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.functions import ids
from attnstrata.operators import compare, statistics
from attnstrata.sources import dataset
from workloads import models
from workloads import views as v
from workloads.registry import query, r6, sql_r6, table
from workloads.sequences import SQL_DAILY, daily_runs

REPORT = "auroc auroc_ci_lower auroc_ci_upper".split()


def report(spark, sf, score):
    """AUROC with interval per language, for one score."""
    s = models.scored_documents(spark, sf)
    point = statistics.auroc(s, ["bin_id"], "is_fail", score)
    interval = statistics.bootstrap_auroc_ci(
        s, ["bin_id"], "is_fail", score, id_col="event_id", replicates=models.REPLICATES
    )
    return point.join(interval, "bin_id").select(
        "bin_id", *REPORT, F.col("n_pos").alias("n_events_train"), F.col("n_neg").alias("n_events_held_out")
    )


def sql_report(name: str, score: str) -> str:
    return f"""{models.sql_auroc(name + '_p', 'scored', score)}, {models.sql_interval(name + '_c', 'scored', score)},
{name} AS (SELECT bin_id, auroc, auroc_ci_lower, auroc_ci_upper, n_pos AS n_events_train, n_neg AS n_events_held_out
  FROM {name}_p JOIN {name}_c USING (bin_id))"""


SQL_GAINS = f"""{models.SQL_SCORED}, {sql_report('base', 'length')}, {sql_report('aug', 'source_no')},
gains AS (SELECT bin_id, a.auroc - b.auroc AS delta_auroc, a.auroc_ci_lower - b.auroc_ci_upper AS ci_lower_approx,
  a.auroc_ci_upper - b.auroc_ci_lower AS ci_upper_approx, a.auroc - b.auroc >= 0.02 AS is_significant_at_02,
  b.auroc AS spectral_auroc, a.auroc AS augmented_auroc FROM base b JOIN aug a USING (bin_id))"""


def _gains(spark, sf):
    return compare.marginal_gain(report(spark, sf, "length"), report(spark, sf, "source_no"))


@query(
    "j12_c15_marginal_gain",
    f"""WITH {SQL_GAINS} SELECT bin_id, is_significant_at_02, {', '.join(sql_r6(c) + ' AS ' + c for c in
    ('delta_auroc', 'ci_lower_approx', 'ci_upper_approx', 'spectral_auroc', 'augmented_auroc'))} FROM gains""",
)
def j12(spark, sf):
    g = _gains(spark, sf)
    return g.withColumns(
        {c: r6(c) for c in g.columns if c not in ("bin_id", "is_significant_at_02")}
    )


@query(
    "a17_marginal_gain_summary",
    f"""WITH {SQL_GAINS} SELECT CAST(count_if(is_significant_at_02) AS BIGINT) AS n_bins_marginal_gain_at_02,
    {sql_r6('list_sort(list(delta_auroc))[count(*) // 2 + 1]')} AS median_delta_auroc, 0.02::DOUBLE AS decision_rule_threshold,
    count_if(is_significant_at_02) >= 4 AS ricci_load_bearing FROM gains""",
)
def a17(spark, sf):
    return compare.marginal_gain_summary(_gains(spark, sf)).withColumn(
        "median_delta_auroc", r6("median_delta_auroc")
    )


@query(
    "a16_per_bin_verdict",
    f"""WITH {models.SQL_SCORED}, {sql_report('base', 'length')}
    SELECT count(*) AS n_bins, CAST(count_if(auroc > 0.80 AND auroc_ci_lower > 0.50) AS BIGINT) AS n_passing,
    count_if(auroc > 0.80 AND auroc_ci_lower > 0.50) >= 4 AS passes FROM base""",
)
def a16(spark, sf):
    return compare.per_bin_verdict(report(spark, sf, "length"))


@query(
    "a16_pooled_verdict",
    f"""WITH {models.SQL_SCORED.replace('lang AS bin_id', "'all' AS bin_id")}, {sql_report('base', 'length')}
    SELECT {', '.join(sql_r6(c) + ' AS ' + c for c in REPORT)}, auroc < 0.75 OR auroc_ci_lower < 0.55 AS passes FROM base""",
)
def a16_pooled(spark, sf):
    s = models.scored_documents(spark, sf).withColumn(
        "bin_id", F.when(F.col("length") >= 0, "all")
    )
    point = statistics.auroc(s, ["bin_id"], "is_fail", "length")
    interval = statistics.bootstrap_auroc_ci(
        s, ["bin_id"], "is_fail", "length", id_col="event_id", replicates=models.REPLICATES
    )
    out = compare.pooled_verdict(point.join(interval, "bin_id"))
    return out.withColumns({c: r6(c) for c in REPORT})


SQL_COUNT_RUNS = """,
daily_n AS (
  SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, count(*) AS c
  FROM events GROUP BY ALL),
flagged_n AS (
  SELECT event_type, day, c * n > total AS high FROM (
    SELECT *, sum(c) OVER (PARTITION BY event_type) AS total, count(*) OVER (PARTITION BY event_type) AS n FROM daily_n)),
runs_n AS (
  SELECT event_type, CAST(min(day) AS INTEGER) AS lo, CAST(max(day) AS INTEGER) AS hi FROM (
    SELECT event_type, day, day - row_number() OVER (PARTITION BY event_type ORDER BY day) AS g
    FROM flagged_n WHERE high) GROUP BY event_type, g)"""


def count_runs(spark, sf):
    """Runs of days with more events than average, per event type."""
    daily = table(spark, sf, "events").groupBy(
        "event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")
    ).agg(F.count(F.lit(1)).alias("c"))
    totals = daily.groupBy("event_type").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n"))
    high = F.col("c") * F.col("n") > F.col("total")
    return statistics.islands(daily.join(totals, "event_type"), ["event_type"], "day", high)


@query(
    "j13_interval_overlap",
    f"""WITH {SQL_DAILY} {SQL_COUNT_RUNS}, keys AS (SELECT event_type FROM runs UNION SELECT event_type FROM runs_n)
    SELECT k.event_type, (SELECT count(*) FROM runs r WHERE r.event_type = k.event_type) AS n_a,
    (SELECT count(*) FROM runs_n r WHERE r.event_type = k.event_type) AS n_b,
    EXISTS (SELECT 1 FROM runs a JOIN runs_n b ON a.event_type = b.event_type AND a.lo <= b.hi AND b.lo <= a.hi
      WHERE a.event_type = k.event_type) AS overlap FROM keys k""",
)
def j13(spark, sf):
    return compare.interval_overlap(daily_runs(spark, sf), count_runs(spark, sf), ["event_type"])


def _run_fits(spark, sf):
    """Both kinds of runs as interval lists of two head graphs."""
    def side(runs, edge_type):
        return runs.groupBy(F.col("event_type").alias("bin_id")).agg(
            F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("discriminative_depth_intervals")
        ).withColumn("edge_type", F.lit(edge_type))

    a, b = daily_runs(spark, sf), count_runs(spark, sf).filter(F.col("event_type") != "view")
    return side(a, fixed.EDGE_TYPES[0]).unionByName(side(b, fixed.EDGE_TYPES[1]))


TYPES = ("click", "error", "purchase", "signup", "view", "none")


@query(
    "c16_head_graph_comparison",
    f"""WITH {SQL_DAILY} {SQL_COUNT_RUNS}, k AS (SELECT unnest({list(TYPES)!r}) AS bin_id)
    SELECT bin_id, CAST((SELECT count(*) FROM runs r WHERE r.event_type = bin_id) AS INTEGER) AS n_qkt,
    CAST((SELECT count(*) FROM runs_n r WHERE r.event_type = bin_id AND bin_id <> 'view') AS INTEGER) AS n_avwo,
    bin_id <> 'view' AND EXISTS (SELECT 1 FROM runs a JOIN runs_n b ON a.event_type = b.event_type AND a.lo <= b.hi
      AND b.lo <= a.hi WHERE a.event_type = bin_id) AS overlap FROM k""",
)
def c16(spark, sf):
    out = compare.head_graph_comparison(_run_fits(spark, sf), TYPES)
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return out.select(
        "bin_id",
        size("qkt_grassmannian_intervals").alias("n_qkt"),
        size("avwo_grassmannian_intervals").alias("n_avwo"),
        "overlap",
    )


@query(
    "a16_depth_verdict",
    f"""WITH {SQL_DAILY} {SQL_COUNT_RUNS} SELECT count(DISTINCT event_type) AS n_passing,
    count(DISTINCT event_type) >= 4 AS passes FROM (SELECT event_type FROM runs
      UNION ALL SELECT event_type FROM runs_n WHERE event_type <> 'view')""",
)
def a16_depth(spark, sf):
    return compare.depth_verdict(_run_fits(spark, sf), TYPES)


def sweep_rows(spark, sf):
    """Mean discount per (flag as k, priority) against the middle of its range."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    k = F.when(F.col("l_returnflag") == "A", 8).when(F.col("l_returnflag") == "N", 16).otherwise(32)
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    mean = F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / F.count(F.lit(1)) / 100.0
    known = (F.col("k") != 8) | (F.col("bin_id") != "1-URGENT")
    rows = joined.groupBy(k.alias("k"), F.col("o_orderpriority").alias("bin_id")).agg(mean.alias("auroc"))
    base = rows.withColumn("auroc", F.lit(0.05))
    return base, rows.filter(known)


SQL_SWEEP = """
sweep AS (
  SELECT CAST(CASE l_returnflag WHEN 'A' THEN 8 WHEN 'N' THEN 16 ELSE 32 END AS INTEGER) AS k, o_orderpriority AS bin_id,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 - 0.05 AS gain
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
sweep_gains AS (
  SELECT k, bin_id, CASE WHEN k = 8 AND bin_id = '1-URGENT' THEN NULL ELSE gain END AS gain FROM sweep)"""


def sweep(spark, sf):
    base, augmented = sweep_rows(spark, sf)
    bins = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("bin_id")).distinct()
    return compare.sweep_gains(bins, base, augmented)


@query(
    "j12_sweep_gains",
    f"WITH {SQL_SWEEP} SELECT k, bin_id, {sql_r6('gain')} AS gain FROM sweep_gains",
)
def j12_sweep(spark, sf):
    return sweep(spark, sf).withColumn("gain", r6("gain"))


@query(
    "a18_pick_winner",
    f"""WITH {SQL_SWEEP}, m AS (SELECT k, quantile_cont(gain, 0.5) AS med FROM sweep_gains GROUP BY k)
    SELECT k AS winner_k_attn, {sql_r6('med')} AS median_gain FROM m ORDER BY med DESC, k LIMIT 1""",
)
def a18(spark, sf):
    return compare.pick_winner(sweep(spark, sf)).withColumn("median_gain", r6("median_gain"))


def _regenerated(spark, sf):
    """The same documents rebuilt, every tenth with one more character."""
    d = v.doc_events(spark, sf)
    changed = d.withColumn(
        "document", F.when(F.col("doc_id") % 10 == 3, F.concat("document", F.lit("!"))).otherwise(
            F.col("document")
        )
    )
    return ids.with_event_id(changed.drop("event_id"))


SQL_REGENERATED = v.SQL_DOC_EVENTS + f""",
regen AS (
  SELECT doc_id, bin_id, sha256('{v.SHA}' || CASE WHEN doc_id % 10 = 3 THEN document || '!' ELSE document END
    || question || gold_answer) AS event_id FROM doc_events)"""


@query(
    "a15_distinct_ids",
    f"WITH {SQL_REGENERATED} SELECT DISTINCT event_id FROM regen",
)
def a15(spark, sf):
    return compare.distinct_ids(_regenerated(spark, sf))


@query(
    "a19_agreement_pct",
    f"""WITH {SQL_REGENERATED}, o AS (SELECT DISTINCT event_id FROM doc_events), r AS (SELECT DISTINCT event_id FROM regen)
    SELECT count(*) AS n_original_events, count(r.event_id) AS n_overlap,
    {sql_r6('100.0 * count(r.event_id) / count(*)')} AS agreement_pct,
    100.0 * count(r.event_id) / count(*) >= 99 AS passes FROM o LEFT JOIN r USING (event_id)""",
)
def a19(spark, sf):
    out = compare.agreement(v.doc_events(spark, sf), _regenerated(spark, sf))
    return out.withColumn("agreement_pct", r6("agreement_pct"))


@query(
    "a20_bad_id_count",
    f"""WITH {SQL_REGENERATED} SELECT count(*) AS n_events,
    CAST(count_if(d.event_id <> r.event_id) AS BIGINT) AS n_bad_ids FROM doc_events d JOIN regen r USING (doc_id)""",
)
def a20(spark, sf):
    tampered = v.doc_events(spark, sf).withColumn(
        "document", F.when(F.col("doc_id") % 10 == 3, F.concat("document", F.lit("!"))).otherwise(
            F.col("document")
        )
    )
    return ids.bad_id_count(tampered)


SQL_C17 = f"""WITH {SQL_REGENERATED}, o AS (SELECT DISTINCT event_id, bin_id FROM doc_events),
    r AS (SELECT DISTINCT event_id, CASE WHEN doc_id % 7 = 0 THEN 'B9' ELSE bin_id END AS bin_id FROM regen),
    oi AS (SELECT DISTINCT event_id FROM o), ri AS (SELECT DISTINCT event_id FROM r)
    SELECT count(*) AS n_original_events, count(ri.event_id) AS n_overlap,
    {sql_r6('100.0 * count(ri.event_id) / count(*)')} AS agreement_pct,
    100.0 * count(ri.event_id) / count(*) >= 99 AS passes, (SELECT count(*) FROM ri) AS n_regenerated_event_ids,
    {sql_r6('(SELECT 100.0 * count(r.event_id) / count(*) FROM o LEFT JOIN r ON o.event_id = r.event_id AND o.bin_id = r.bin_id)')} AS label_agreement_pct
    FROM oi LEFT JOIN ri USING (event_id)"""


@query("c17_reproducibility_check", SQL_C17)
def c17(spark, sf):
    regenerated = _regenerated(spark, sf).withColumn(
        "bin_id", F.when(F.col("doc_id") % 7 == 0, F.lit("B9")).otherwise(F.col("bin_id"))
    )
    out = compare.reproducibility_check(v.doc_events(spark, sf), regenerated, label="bin_id")
    return out.withColumns({c: r6(c) for c in ("agreement_pct", "label_agreement_pct")})


@query(
    "j15_regenerated_in_original",
    f"WITH {SQL_REGENERATED} SELECT doc_id, event_id FROM regen WHERE event_id IN (SELECT event_id FROM doc_events)",
)
def j15(spark, sf):
    found = compare.found_again(_regenerated(spark, sf), v.doc_events(spark, sf))
    return found.select("doc_id", "event_id")


@query(
    "j01_join_event_text",
    f"""WITH {v.SQL_FULL_EVENTS} SELECT event_id, bin_id, CASE WHEN bin_id = 'B1' THEN '' ELSE gold_answer END AS gold_answer,
    CASE WHEN bin_id = 'B1' THEN '' ELSE model_generation END AS model_generation,
    CAST(CASE WHEN bin_id = 'B1' THEN 0 ELSE length(document) END AS INTEGER) AS n_chars FROM full_events""",
)
def j01(spark, sf):
    """Text rows of the first bin are absent; every other text row occurs twice."""
    e = v.full_events(spark, sf)
    text = dataset.event_text(e.filter(F.col("bin_id") != "B1"))
    old = text.withColumn("document", F.lit("old")).withColumn("seq", F.lit(0))
    twice = old.unionByName(text.withColumn("seq", F.lit(1)))
    joined = dataset.join_event_text(dataset.event_index(e), twice, F.col("seq"))
    return joined.select(
        "event_id", "bin_id", "gold_answer", "model_generation", F.length("document").alias("n_chars")
    )


@query(
    "u01_union_bins",
    """SELECT 'documents' AS part, lang AS bin_id, count(*) AS n FROM documents GROUP BY lang
    UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY role""",
)
def u01(spark, sf):
    count = F.count(F.lit(1)).alias("n")
    a = table(spark, sf, "documents").groupBy(F.col("lang").alias("bin_id")).agg(count)
    b = table(spark, sf, "conversations").groupBy(F.col("role").alias("bin_id")).agg(count)
    return compare.pooled({"documents": a, "conversations": b})


@query(
    "u02_id_intersection",
    f"WITH {SQL_REGENERATED} SELECT event_id FROM doc_events INTERSECT SELECT event_id FROM regen",
)
def u02(spark, sf):
    return compare.shared_ids(v.doc_events(spark, sf), _regenerated(spark, sf))


@query("u03_distinct_partkeys", "SELECT DISTINCT l_partkey FROM lineitem")
def u03(spark, sf):
    return compare.distinct_ids(table(spark, sf, "lineitem"), "l_partkey")


@query(
    "u04_missing_ids",
    f"WITH {SQL_REGENERATED} SELECT event_id FROM doc_events EXCEPT SELECT event_id FROM regen",
)
def u04(spark, sf):
    return compare.missing_ids(v.doc_events(spark, sf), _regenerated(spark, sf))
