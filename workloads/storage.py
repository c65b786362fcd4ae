"""Tables written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.functions import ids
from attnstrata.operators import compare, matching, series
from attnstrata.sources import catalogue, dataset, reports, tensors
from attnstrata.session import scratch_path
from workloads import comparisons, linear, models
from workloads import matching as match_queries
from workloads import views as v
from workloads.registry import query, r6, sql_r6, table
from workloads.sequences import SQL_CUSUM, SQL_DAILY, THRESHOLD, USER, _cusum


@query("s01_read_catalogue", f"WITH {v.SQL_FACTS} SELECT fact_id, template_id, subject, object, statement_form FROM facts JOIN templates USING (template_id)")
def s01(spark, sf):
    t_path, f_path = scratch_path(spark, "templates"), scratch_path(spark, "facts")
    catalogue.write_catalogue(v.templates(spark, sf), v.facts(spark, sf), t_path, f_path)
    templates, facts = catalogue.read_catalogue(spark, t_path, f_path)
    return facts.join(templates, "template_id").select(
        "fact_id", "template_id", "subject", "object", "statement_form"
    )


INDEX_SQL = ", ".join(
    f"{sql_r6(c)} AS {c}" if t == "double" else c
    for c, t in fixed.EVENT_COLUMNS
    if c not in fixed.TEXT_COLUMNS
)


@query("s02_write_event_index", f"WITH {v.SQL_FULL_EVENTS} SELECT {INDEX_SQL} FROM full_events")
def s02(spark, sf):
    path = scratch_path(spark, "index")
    dataset.write_event_index(v.full_events(spark, sf), path, sort_by="event_id")
    return dataset.read_event_index(spark, path).withColumn(
        "distractor_density", r6("distractor_density")
    )


@query(
    "s03_write_event_text",
    f"""WITH {v.SQL_FULL_EVENTS} SELECT event_id, document, question, gold_answer,
    model_generation AS model_generation_raw FROM full_events""",
)
def s03(spark, sf):
    path = scratch_path(spark, "text")
    dataset.write_event_text(v.full_events(spark, sf), path)
    return dataset.read_event_text(spark, path)


def sql_digest(source: str, columns: list[str]) -> str:
    part = lambda c: f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    text = " || ".join(part(c) for c in sorted(columns))
    lanes = " || ':' || ".join(
        f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4)
    )
    return f"""SELECT count(*) AS n_rows, sha256(count(*) || ':' || {lanes}) AS digest
    FROM (SELECT sha256({text}) AS h FROM {source})"""


@query("s04_dataset_digest", sql_digest("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def s04(spark, sf):
    return ids.dataset_digest(table(spark, sf, "documents"))


def header(spark, sf):
    """A study header whose seeds and policies come from the events' bins."""
    bins = v.qa_events(spark, sf).select("bin_id").distinct()
    seeds = bins.select("bin_id", matching.bin_seed().alias("seed"))
    return seeds.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin_id", "seed")))).alias(
            "matching_seed_per_bin"
        ),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("bin_id", F.lit("none"))))
        ).alias("adversariality_policy_per_bin"),
    ).select(
        F.lit("1").alias("schema_version"),
        F.lit("").alias("manifest_sha256"),
        F.lit("").alias("events_sha256"),
        F.lit("c0de").alias("code_commit_sha"),
        F.lit("rev").alias("model_revision_sha"),
        F.lit(v.SHA).alias("prompt_template_sha256"),
        F.sha2(F.lit("config"), 256).alias("generation_config_sha256"),
        F.lit(8).alias("k_grass"),
        F.lit(16).alias("k_attn"),
        F.lit(fixed.DENSE_LOOKBACK).alias("lookback_window_length"),
        F.array(*[F.lit(f) for f in fixed.FEATURES]).alias("feature_layout"),
        F.lit("nan_with_median_imputation_and_indicator").alias("forman_ricci_convention"),
        "adversariality_policy_per_bin",
        ids.derive_seed("split", F.lit("v1")).alias("split_seed"),
        "matching_seed_per_bin",
        F.lit("1").alias("constitution_version"),
        F.lit("1").alias("spec_version"),
        F.lit("2026-01-01T00:00:00Z").alias("write_timestamp_utc"),
    )


@query(
    "s05_header_round_trip",
    f"""WITH {v.SQL_QA_EVENTS} SELECT bin_id, {v.sql_seed('match', 'bin_id')} AS matching_seed, 'none' AS policy,
    8 AS k_grass, 7 AS n_features, '{v.SHA}' AS prompt_template_sha256, {v.sql_seed('split', "'v1'")} AS split_seed
    FROM (SELECT DISTINCT bin_id FROM qa_events)""",
)
def s05(spark, sf):
    path = scratch_path(spark, "header")
    dataset.write_header(header(spark, sf), path)
    h = dataset.read_header(spark, path)
    return h.select(
        F.explode("matching_seed_per_bin").alias("bin_id", "matching_seed"),
        "adversariality_policy_per_bin", "k_grass", F.size("feature_layout").alias("n_features"),
        "prompt_template_sha256", "split_seed",
    ).select(
        "bin_id", "matching_seed",
        F.element_at("adversariality_policy_per_bin", F.col("bin_id")).alias("policy"),
        "k_grass", "n_features", "prompt_template_sha256", "split_seed",
    )


@query(
    "s06_read_events",
    f"""WITH {v.SQL_FULL_EVENTS} SELECT {INDEX_SQL}, sha256(document) AS document_sha, question, gold_answer,
    model_generation FROM full_events""",
)
def s06(spark, sf):
    path = scratch_path(spark, "dataset")
    dataset.write_dataset(v.full_events(spark, sf), header(spark, sf), path)
    _, events = dataset.read_dataset(spark, path)
    return events.withColumn("distractor_density", r6("distractor_density")).withColumn(
        "document_sha", F.sha2("document", 256)
    ).drop("document")


def atomic_table(spark, sf):
    """Seven numbers per (event, position, layer, head), ids as hashes."""
    c = v.captured(spark, sf)
    return c.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("event_id"),
        F.expr("cast(token % 250 - 249 as int)").alias("rel_pos"),
        F.col("layer").cast("int").alias("layer"),
        F.col("head").cast("int").alias("head"),
        *[x.alias(f) for x, f in zip(v.seven(), fixed.FEATURES, strict=True)],
    )


ATOMIC_SQL = ", ".join(f"CAST(CAST({x} AS FLOAT) AS DOUBLE) AS {f}" for x, f in zip(v.SQL_SEVEN, fixed.FEATURES, strict=True))


@query(
    "s07_atomic_round_trip",
    f"""WITH {v.SQL_CAPTURED} SELECT sha256(event_id::VARCHAR) AS event_id, CAST(token % 250 - 249 AS INTEGER) AS rel_pos,
    layer, head, {ATOMIC_SQL} FROM captured""",
)
def s07(spark, sf):
    path = scratch_path(spark, "atomic")
    tensors.write_atomic(atomic_table(spark, sf), path)
    back = tensors.read_atomic(spark, path)
    return back.select(
        "event_id", "rel_pos", "layer", "head", *[F.col(f).cast("double").alias(f) for f in fixed.FEATURES]
    )


def edge_table(spark, sf):
    e = linear.trace_edges(spark, sf)
    return e.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("event_id"),
        F.lit(0).alias("lookback_j"),
        F.col("layer").cast("int").alias("layer"),
        F.lit("qkt_grassmannian").alias("edge_type"),
        F.col("h_i").cast("int").alias("h_i"),
        F.col("h_j").cast("int").alias("h_j"),
        "dist",
    )


@query(
    "s08_head_edges_round_trip",
    f"""WITH {linear.SQL_EDGES} SELECT sha256(event_id::VARCHAR) AS event_id, layer, h_i, h_j,
    {sql_r6('CAST(round(dist, 4) AS FLOAT)')} AS dist FROM edges""",
)
def s08(spark, sf):
    path = scratch_path(spark, "edges")
    both = edge_table(spark, sf).withColumn("dist", F.round("dist", 4))
    mirrored = both.withColumns({"h_i": F.col("h_j"), "h_j": F.col("h_i")})
    tensors.write_head_edges(both.unionByName(mirrored), path)
    return tensors.read_head_edges(spark, path).select(
        "event_id", "layer", "h_i", "h_j", r6(F.col("dist").cast("double")).alias("dist")
    )


STATS = ("mean", "p10", "p50", "p90", "std")


@query(
    "s09_atomic_summary_round_trip",
    f"""WITH {v.SQL_CAPTURED}, f AS (SELECT event_id, layer, head, unnest({list(fixed.FEATURES)}) AS feature,
      unnest([{', '.join(v.SQL_SEVEN)}]) AS x FROM captured)
    SELECT sha256(event_id::VARCHAR) AS event_id, layer, head, feature,
    {', '.join(f'round(CAST(CAST({e} AS FLOAT) AS DOUBLE), 4) + 0.0 AS {n}' for n, e in zip(STATS, ('avg(x)', 'quantile_cont(x, 0.1)', 'quantile_cont(x, 0.5)', 'quantile_cont(x, 0.9)', 'stddev_pop(x)')))}
    FROM f GROUP BY event_id, layer, head, feature""",
)
def s09(spark, sf):
    from attnstrata.operators.statistics import summarize

    path = scratch_path(spark, "summary")
    summary = summarize(atomic_table(spark, sf), ["event_id", "layer", "head"], list(fixed.FEATURES))
    tensors.write_atomic_summary(summary, path)
    back = tensors.read_atomic_summary(spark, path)
    return back.select(
        "event_id", "layer", "head", "feature",
        *[(F.round(F.col(s).cast("double"), 4) + F.lit(0.0)).alias(s) for s in STATS],
    )


@query(
    "s10_id_prefix_layout",
    """SELECT substr(sha256((vec_id // 250)::VARCHAR), 1, 2) AS id_prefix, count(*) * 4 AS n
    FROM embeddings GROUP BY 1""",
)
def s10(spark, sf):
    """Rows per directory, from the partition column alone."""
    path = scratch_path(spark, "atomic")
    tensors.write_atomic(atomic_table(spark, sf), path)
    return (
        spark.read.schema(tensors.ATOMIC_SCHEMA + ", id_prefix string")
        .parquet(path)
        .groupBy("id_prefix")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _stored_atomic(spark, sf):
    """The atomic table, stored, with its header row keyed by the source's digest."""
    digest = ids.dataset_digest(table(spark, sf, "embeddings").select("vec_id", "label")).first()["digest"]
    path, header_path = scratch_path(spark, "atomic"), scratch_path(spark, "atomic-header")
    tensors.write_atomic(atomic_table(spark, sf), path)
    tensors.provenance(
        spark, "atomic", manifest_sha256=digest, code_commit_sha="c0de", tensor_shape=(250, 4, 10, 7), k_attn=16
    ).write.parquet(header_path)
    stored = spark.read.schema(tensors.HEADER_SCHEMA).parquet(header_path)
    return tensors.read_atomic(spark, path), stored, digest


SQL_EMB_DIGEST = sql_digest("embeddings", ["vec_id", "label"])


@query(
    "s11_provenance_columns",
    f"""SELECT sha256((vec_id // 250)::VARCHAR) AS event_id, count(*) * 4 AS n_rows,
    (SELECT digest FROM ({SQL_EMB_DIGEST})) AS manifest_sha256, 16 AS k_attn, 8 AS k_grass, 256 AS lookback_window_length
    FROM embeddings GROUP BY 1""",
)
def s11(spark, sf):
    atomic, stored, _ = _stored_atomic(spark, sf)
    rows = tensors.rows_per_event(atomic)
    return tensors.with_provenance(rows, stored, "atomic")


@query(
    "s12_check_provenance",
    """SELECT sha256((vec_id // 250)::VARCHAR) AS event_id, count(*) * 4 AS n_rows, true AS stale_refused,
    true AS drift_refused FROM embeddings GROUP BY 1""",
)
def s12(spark, sf):
    """The right digest passes; another digest or parameter is refused."""
    atomic, stored, digest = _stored_atomic(spark, sf)
    checked = tensors.check_provenance(
        atomic, stored, table_name="atomic", expected_digest=digest, k_attn=16, k_grass=8
    )

    def refused(error, **options):
        try:
            tensors.check_provenance(atomic, stored, table_name="atomic", **options)
        except error:
            return True
        return False

    stale = refused(tensors.StaleTensorError, expected_digest="0" * 64)
    drift = refused(tensors.ConfigDriftError, expected_digest=digest, k_attn=8)
    return tensors.rows_per_event(checked).withColumns(
        {"stale_refused": F.lit(stale), "drift_refused": F.lit(drift)}
    )


def _auroc_file(spark, sf):
    path = scratch_path(spark, "auroc")
    reports.write_auroc_report(comparisons.report(spark, sf, "length"), path)
    return path


REPORT_COLUMNS = ", ".join(f"{sql_r6(c)} AS {c}" for c in comparisons.REPORT)


@query(
    "s13_auroc_report",
    f"""WITH {models.SQL_SCORED}, {comparisons.sql_report('base', 'length')}
    SELECT bin_id, n_events_train, n_events_held_out, {REPORT_COLUMNS} FROM base""",
)
def s13(spark, sf):
    back = spark.read.schema(reports.AUROC_SCHEMA).json(_auroc_file(spark, sf))
    return back.withColumns({c: r6(c) for c in comparisons.REPORT})


@query(
    "s19_read_auroc_report",
    f"""WITH {models.SQL_SCORED}, {comparisons.sql_report('base', 'length')}
    SELECT bin_id, n_events_train, n_events_held_out, {REPORT_COLUMNS} FROM base WHERE bin_id IN ('en', 'fr')""",
)
def s19(spark, sf):
    """Entries under other names than the known bins are left out."""
    back = reports.read_auroc_report(spark, _auroc_file(spark, sf), bins=("en", "fr"))
    return back.withColumns({c: r6(c) for c in comparisons.REPORT})


@query(
    "s14_yield_report",
    f"""WITH {match_queries.SQL_CELLS} SELECT bin_id, count(*) AS n_strata,
    CAST(sum(n_matched_pairs) AS BIGINT) AS total_matched_pairs,
    {sql_r6('100.0 * sum(n_matched_pairs) / least(sum(n_fail_pool), sum(n_ctrl_pool))')} AS yield_pct
    FROM cells GROUP BY bin_id""",
)
def s14(spark, sf):
    path = scratch_path(spark, "yield")
    y = matching.match_yield(matching.cell_counts(v.line_events(spark, sf)))
    reports.write_yield_report(y, path)
    return spark.read.schema("bin_id string, n_strata bigint, total_matched_pairs bigint, yield_pct double").json(
        path
    ).withColumn("yield_pct", r6("yield_pct"))


@query(
    "s15_handcheck_sample",
    f"""WITH {v.SQL_FULL_EVENTS} SELECT event_id, bin_id, question, gold_answer, model_generation,
    is_fail AS is_fail_automated, NULL::VARCHAR AS human_judgment FROM full_events
    ORDER BY sha256('handcheck:' || event_id), event_id LIMIT 50""",
)
def s15(spark, sf):
    path = scratch_path(spark, "handcheck")
    reports.write_handcheck_sample(v.full_events(spark, sf), path)
    return spark.read.schema(
        "event_id string, bin_id string, question string, gold_answer string, model_generation string, "
        "is_fail_automated boolean, human_judgment string"
    ).json(path)


@query(
    "s16_beta_functions",
    f"""WITH {SQL_DAILY} {comparisons.SQL_COUNT_RUNS},
    a AS (SELECT event_type AS bin_id, 'qkt_grassmannian' AS edge_type, lo, hi FROM runs
      UNION ALL SELECT event_type, 'avwo_grassmannian', lo, hi FROM runs_n WHERE event_type <> 'view')
    SELECT bin_id, edge_type, count(*) AS n_intervals, CAST(min(lo) AS INTEGER) AS first_layer FROM a GROUP BY ALL""",
)
def s16(spark, sf):
    path = scratch_path(spark, "beta")
    reports.write_beta_functions(comparisons._run_fits(spark, sf), path)
    back = spark.read.schema(
        "bin_id string, edge_type string, discriminative_depth_intervals array<struct<lo:int,hi:int>>"
    ).json(path)
    return back.select(
        "bin_id", "edge_type", F.size("discriminative_depth_intervals").cast("bigint").alias("n_intervals"),
        F.array_min("discriminative_depth_intervals")["lo"].alias("first_layer"),
    )


def _sweep_file(spark, sf):
    path = scratch_path(spark, "sweep")
    gains = comparisons.sweep(spark, sf)
    reports.write_report(reports.sweep_report(gains, compare.pick_winner(gains)), path)
    return path


@query(
    "s17_sweep_report",
    f"""WITH {comparisons.SQL_SWEEP}, m AS (SELECT k, quantile_cont(gain, 0.5) AS med FROM sweep_gains GROUP BY k)
    SELECT k::VARCHAR AS k, {sql_r6('med')} AS median_gain,
    (SELECT k FROM m ORDER BY med DESC, k LIMIT 1) AS winner_k_attn FROM m""",
)
def s17(spark, sf):
    back = spark.read.schema(
        "winner_k_attn int, median_marginal_gain_per_k map<string,double>, per_bin_marginal_gain map<string,string>"
    ).json(_sweep_file(spark, sf))
    return back.select(
        F.explode("median_marginal_gain_per_k").alias("k", "median_gain"), "winner_k_attn"
    ).withColumn("median_gain", r6("median_gain"))


@query(
    "s17_marginal_gain_report",
    f"""WITH {comparisons.SQL_GAINS} SELECT bin_id, {sql_r6('delta_auroc')} AS delta_auroc, {sql_r6('ci_upper_approx')} AS ci_upper_approx,
    is_significant_at_02, (SELECT CAST(count_if(is_significant_at_02) AS BIGINT) FROM gains) AS n_bins_marginal_gain_at_02,
    (SELECT count_if(is_significant_at_02) >= 4 FROM gains) AS ricci_load_bearing FROM gains""",
)
def s17_gain(spark, sf):
    path = scratch_path(spark, "gain")
    reports.write_marginal_gain_report(comparisons._gains(spark, sf), path)
    back = spark.read.schema(
        "per_bin map<string,struct<delta_auroc:double,ci_upper_approx:double,is_significant_at_02:boolean>>, "
        "n_bins_marginal_gain_at_02 bigint, ricci_load_bearing boolean"
    ).json(path)
    return back.select(
        F.explode("per_bin").alias("bin_id", "v"), "n_bins_marginal_gain_at_02", "ricci_load_bearing"
    ).select(
        "bin_id", r6("v.delta_auroc").alias("delta_auroc"), r6("v.ci_upper_approx").alias("ci_upper_approx"),
        "v.is_significant_at_02", "n_bins_marginal_gain_at_02", "ricci_load_bearing",
    )


@query(
    "s17_long_lines_report",
    f"""WITH {SQL_CUSUM}, alarms AS (SELECT user_id, CAST(coalesce(min(CASE WHEN pos > {THRESHOLD} OR neg > {THRESHOLD}
      THEN idx END), -1) AS BIGINT) AS first_alarm_idx FROM s GROUP BY user_id)
    SELECT printf('L%02d_H%02d', user_id % 7, user_id // 7 % 5) AS line, list_sort(list(first_alarm_idx)) AS first_alarms
    FROM alarms GROUP BY ALL""",
)
def s17_lines(spark, sf):
    """Users stand for lines; some share a name, as heads of several runs do."""
    path = scratch_path(spark, "lines")
    user = F.col("user_id")
    alarms = series.first_alarm(_cusum(spark, sf), USER).select(
        (user % 7).alias("layer"), (F.floor(user / 7) % 5).alias("head"), F.col("first_alarm_idx").cast("bigint")
    )
    reports.write_long_lines_report(alarms, path)
    return spark.read.schema("line string, first_alarms array<bigint>").json(path)


@query("s17_reproducibility_report", comparisons.SQL_C17)
def s17_reproducibility(spark, sf):
    path = scratch_path(spark, "reproducibility")
    reports.write_reproducibility_report(comparisons.c17(spark, sf), path)
    return spark.read.schema(
        "n_original_events bigint, n_overlap bigint, agreement_pct double, passes boolean, "
        "n_regenerated_event_ids bigint, label_agreement_pct double"
    ).json(path)


@query(
    "s20_read_sweep_winner",
    f"""WITH {comparisons.SQL_SWEEP}, m AS (SELECT k, quantile_cont(gain, 0.5) AS med FROM sweep_gains GROUP BY k)
    SELECT k AS winner_k_attn FROM m ORDER BY med DESC, k LIMIT 1""",
)
def s20(spark, sf):
    return reports.read_sweep_winner(spark, _sweep_file(spark, sf))


@query(
    "s18_verdict_tables",
    f"""WITH {models.SQL_SCORED}, {comparisons.sql_report('base', 'length')}, {SQL_DAILY} {comparisons.SQL_COUNT_RUNS},
    d AS (SELECT DISTINCT event_type FROM (SELECT event_type FROM runs UNION ALL
      SELECT event_type FROM runs_n WHERE event_type <> 'view'))
    SELECT 'per_bin_auroc' AS verdict, CAST(count_if(auroc > 0.80 AND auroc_ci_lower > 0.50) AS BIGINT) AS n_passing,
    count_if(auroc > 0.80 AND auroc_ci_lower > 0.50) >= 4 AS passes FROM base
    UNION ALL SELECT 'discriminative_depths', count(*), count(*) >= 4 FROM d""",
)
def s18(spark, sf):
    auroc = compare.per_bin_verdict(comparisons.report(spark, sf, "length")).drop("n_bins")
    depths = compare.depth_verdict(comparisons._run_fits(spark, sf), comparisons.TYPES)
    return auroc.withColumn("verdict", F.lit("per_bin_auroc")).unionByName(
        depths.withColumn("verdict", F.lit("discriminative_depths"))
    )
