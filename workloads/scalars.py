"""P: text, ids, bins and lookback projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from attnstrata.functions import bins, ids, text
from attnstrata.functions import fixed_values as fixed
from attnstrata.operators import matrices, series, statistics
from attnstrata.sources.tensors import downcast
from workloads import views as v
from workloads.registry import query, r6, sql_r6, table

PROMPT_SQL = "'" + fixed.PROMPT_TEMPLATE.replace("{document}", "' || document || '").replace(
    "{question}", "' || question || '"
) + "'"


@query(
    "p01_fill_template",
    f"""WITH {v.SQL_FACTS} SELECT fact_id,
    replace(question_form, '{{subject}}', subject) AS question, statement
    FROM sentences JOIN templates USING (template_id)""",
)
def p01(spark, sf):
    s, o = F.col("subject"), F.col("object")
    return v.facts(spark, sf).join(v.templates(spark, sf), "template_id").select(
        "fact_id",
        text.fill_template(F.col("question_form"), s).alias("question"),
        text.fill_template(F.col("statement_form"), s, o).alias("statement"),
    )


@query(
    "p02_build_prompt",
    f"""WITH {v.SQL_DOC_EVENTS} SELECT doc_id, sha256({PROMPT_SQL}) AS prompt_sha,
    CAST(length({PROMPT_SQL}) AS INTEGER) AS n_chars, '{v.SHA}' AS template_sha FROM doc_events""",
)
def p02(spark, sf):
    prompt = text.build_prompt(F.col("document"), F.col("question"))
    return v.doc_events(spark, sf).select(
        "doc_id",
        F.sha2(prompt, 256).alias("prompt_sha"),
        F.length(prompt).alias("n_chars"),
        F.sha2(F.lit(fixed.PROMPT_TEMPLATE), 256).alias("template_sha"),
    )


TRIM_SQL = (
    "CASE WHEN contains({x}, chr(10)) THEN split_part({x}, chr(10), 1) "
    "WHEN contains({x}, '<|end|>') THEN split_part({x}, '<|end|>', 1) ELSE {x} END"
)


@query(
    "p03_trim_generation",
    f"""WITH g AS (SELECT conv_id, turn,
      CASE WHEN turn % 2 = 0 THEN replace(text, chr(10), '<|end|>') ELSE text END AS t
      FROM conversations)
    SELECT conv_id, turn, sha256({TRIM_SQL.format(x='t')}) AS trimmed_sha,
    CAST(length({TRIM_SQL.format(x='t')}) AS INTEGER) AS n_chars FROM g""",
)
def p03(spark, sf):
    raw = F.when(
        F.col("turn") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("<|end|>"))
    ).otherwise(F.col("text"))
    trimmed = text.trim_generation(F.col("t"))
    return table(spark, sf, "conversations").withColumn("t", raw).select(
        "conv_id", "turn", F.sha2(trimmed, 256).alias("trimmed_sha"), F.length(trimmed).alias("n_chars")
    )


@query(
    "p04_normalize_em",
    f"""WITH n AS (SELECT doc_id, {v.sql_normalize('text')} AS t FROM documents)
    SELECT doc_id, sha256(t) AS normalized_sha, CAST(length(t) AS INTEGER) AS n_chars FROM n""",
)
def p04(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", text.normalize_em(F.col("text")).alias("t"))
        .select("doc_id", F.sha2("t", 256).alias("normalized_sha"), F.length("t").alias("n_chars"))
    )


@query(
    "p05_is_fail",
    f"""SELECT q.conv_id, q.turn,
    {v.sql_normalize('a.text')} <> {v.sql_normalize('q.text')} AS is_fail
    FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
    WHERE q.role = 'user'""",
)
def p05(spark, sf):
    c = table(spark, sf, "conversations")
    answers = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return (
        c.filter(F.col("role") == "user")
        .join(answers, ["conv_id", "turn"])
        .select("conv_id", "turn", text.is_fail(F.col("answer"), F.col("text")).alias("is_fail"))
    )


@query(
    "p06_count_word_tokens",
    f"SELECT doc_id, CAST(len({v.sql_words('text')}) AS INTEGER) AS n_words FROM documents",
)
def p06(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.count_word_tokens(F.col("text")).alias("n_words")
    )


@query(
    "p07_coarsen_density",
    f"""WITH {v.SQL_DOC_EVENTS} SELECT doc_id, {v.sql_density('distractor_density')} AS level
    FROM doc_events""",
)
def p07(spark, sf):
    return v.doc_events(spark, sf).select(
        "doc_id", bins.coarsen_density(F.col("distractor_density")).alias("level")
    )


@query(
    "p08_coarsen_length",
    f"""WITH {v.SQL_DOC_EVENTS} SELECT doc_id,
    {v.sql_length(f"len({v.sql_words('gold_answer')})")} AS level FROM doc_events""",
)
def p08(spark, sf):
    n = text.count_word_tokens(F.col("gold_answer"))
    return v.doc_events(spark, sf).select("doc_id", bins.coarsen_length(n).alias("level"))


@query(
    "p09_stratum_id",
    f"""WITH {v.SQL_QA_EVENTS} SELECT doc_id, cem_stratum_id,
    split_part(cem_stratum_id, '|', 1) AS question_template_id,
    split_part(cem_stratum_id, '|', 2) AS distractor_density_coarsening,
    split_part(cem_stratum_id, '|', 3) AS gold_answer_length_coarsening FROM qa_events""",
)
def p09(spark, sf):
    return v.qa_events(spark, sf).select(
        "doc_id", "cem_stratum_id", *bins.stratum_parts(F.col("cem_stratum_id"))
    )


@query(
    "p10_evidence_distance",
    """SELECT doc_id, CASE WHEN n_chars - 2 * length(split_part(text, chr(10), 1)) > 0
    THEN CAST(n_chars - 2 * length(split_part(text, chr(10), 1)) AS BIGINT) END AS distance FROM documents""",
)
def p10(spark, sf):
    evidence_end = F.length(F.substring_index("text", "\n", 1)) * 2
    return table(spark, sf, "documents").select(
        "doc_id", bins.evidence_distance(evidence_end, F.col("n_chars")).alias("distance")
    )


@query(
    "p11_assign_bin",
    f"""SELECT bin_id, count(*) AS n, CAST(min(n_chars) AS BIGINT) AS lowest,
    CAST(max(n_chars) AS BIGINT) AS highest
    FROM (SELECT n_chars, coalesce({v.sql_bin('n_chars')}, 'quarantine') AS bin_id FROM documents)
    GROUP BY bin_id""",
)
def p11(spark, sf):
    inside, outside = bins.split_by_bin(table(spark, sf, "documents").select("n_chars"), "n_chars")
    return (
        inside.unionByName(outside)
        .groupBy(F.coalesce("bin_id", F.lit("quarantine")).alias("bin_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("n_chars").alias("lowest"),
            F.max("n_chars").alias("highest"),
        )
    )


@query("p12_event_id", f"WITH {v.SQL_DOC_EVENTS} SELECT doc_id, event_id FROM doc_events")
def p12(spark, sf):
    return v.doc_events(spark, sf).select("doc_id", "event_id")


@query(
    "p13_verify_event_id",
    f"""WITH {v.SQL_DOC_EVENTS} SELECT doc_id, true AS id_ok,
    event_id = sha256('{v.SHA}' || upper(document) || question || gold_answer) AS tampered_ok
    FROM doc_events""",
)
def p13(spark, sf):
    e = v.doc_events(spark, sf)
    tampered = ids.event_id(v.SHA, F.upper("document"), F.col("question"), F.col("gold_answer"))
    return e.select(
        "doc_id",
        ids.id_matches().alias("id_ok"),
        (F.col("event_id") == tampered).alias("tampered_ok"),
    )


@query(
    "p14_derive_seed",
    f"""SELECT doc_id, {', '.join(v.sql_seed(ns, 'doc_id') + f' AS seed_{ns}' for ns in fixed.SEED_NAMESPACES)}
    FROM documents""",
)
def p14(spark, sf):
    key = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select(
        "doc_id", *[ids.derive_seed(ns, key).alias(f"seed_{ns}") for ns in fixed.SEED_NAMESPACES]
    )


@query(
    "p15_content_tokens",
    f"""WITH t AS (SELECT doc_id, unnest({v.sql_content_tokens('text')}) AS token FROM documents)
    SELECT doc_id, count(*) AS n_tokens, min(token) AS first_token, max(token) AS last_token
    FROM t GROUP BY doc_id""",
)
def p15(spark, sf):
    t = text.content_tokens(F.col("text"))
    return (
        table(spark, sf, "documents")
        .select("doc_id", t.alias("t"))
        .filter(F.size("t") > 0)
        .select(
            "doc_id",
            F.size("t").cast("bigint").alias("n_tokens"),
            F.array_min("t").alias("first_token"),
            F.array_max("t").alias("last_token"),
        )
    )


@query(
    "p16_lexical_overlap",
    f"""SELECT q.conv_id, q.turn,
    len(list_intersect({v.sql_content_tokens('q.text')}, {v.sql_content_tokens('a.text')})) >= 2 AS overlaps
    FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1""",
)
def p16(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("following"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", text.lexical_overlap(F.col("text"), F.col("following")).alias("overlaps")
    )


@query(
    "p17_filter_bin_min_rows",
    f"""WITH {v.SQL_QA_EVENTS}, ok AS (SELECT bin_id FROM qa_events GROUP BY bin_id HAVING count(*) >= 50)
    SELECT doc_id, bin_id FROM qa_events WHERE bin_id IN (SELECT bin_id FROM ok)""",
)
def p17(spark, sf):
    e = v.qa_events(spark, sf).select("doc_id", "bin_id")
    return statistics.rows_per_group_at_least(e, ["bin_id"], 50)


@query(
    "p18_validate_bin",
    f"WITH {v.SQL_QA_EVENTS} SELECT bin_id, count(*) AS n FROM qa_events GROUP BY bin_id",
)
def p18(spark, sf):
    return (
        bins.require_bins(v.qa_events(spark, sf).select("bin_id"))
        .groupBy("bin_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p19_validate_matrix",
    """SELECT label, count(*) AS n_rows, CAST(max(len(embedding)) AS INTEGER) AS n_cols,
    count(*) = max(len(embedding)) AS is_valid FROM embeddings GROUP BY label""",
)
def p19(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "label", F.col("vec_id").alias("row_idx"), F.col("embedding").alias("row")
    )
    return matrices.validate_matrices(e, ["label"], square=True)


@query(
    "p20_impute_nan_median",
    f"""WITH c AS (SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS x FROM events),
    m AS (SELECT event_type, quantile_cont(x, 0.5) AS med FROM c GROUP BY event_type)
    SELECT event_id, {sql_r6('coalesce(x, med, 0.0)')} AS value, x IS NULL AS value_imputed
    FROM c JOIN m USING (event_type)""",
)
def p20(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        "event_type",
        F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )
    out = statistics.impute_median(e, ["event_type"], ["value"], add_indicator=True)
    return out.select("event_id", r6("value").alias("value"), "value_imputed")


@query(
    "p21_downcast",
    "SELECT event_id, CAST(CAST(value / 3 AS FLOAT) AS DOUBLE) AS stored FROM events",
)
def p21(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 3).alias("x"))
    return downcast(e, ["x"]).select("event_id", F.col("x").cast("double").alias("stored"))


@query(
    "p22_f_lookback",
    """WITH d AS (SELECT doc_id, n_chars AS c FROM documents)
    SELECT doc_id, count(p) AS n_positions, min(p) AS first_position, max(p) AS last_position
    FROM (SELECT doc_id, unnest(CASE WHEN c >= 255 THEN range(c - 255, c + 1) ELSE [NULL] END) AS p FROM d)
    GROUP BY doc_id""",
)
def p22(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("commit"))
    return series.dense_lookback(d, F.col("commit")).groupBy("doc_id").agg(
        F.count("position").alias("n_positions"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
    )


@query(
    "p23_d_lookback",
    """SELECT doc_id, CASE WHEN n_chars >= 256 THEN CAST(j AS INTEGER) END AS lookback_j,
    CASE WHEN n_chars >= 256 THEN n_chars - j END AS position
    FROM documents, (SELECT unnest([0, 1, 2, 4, 8, 16, 32, 64, 128, 256]) AS j) o
    WHERE n_chars >= 256 OR j = 0""",
)
def p23(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("commit"))
    return series.sparse_lookback(d, F.col("commit")).select("doc_id", "lookback_j", "position")


@query(
    "p24_broadcast_positions",
    """SELECT label, CAST(p AS INTEGER) AS rel_pos, count(*) AS n, min(vec_id) AS first_vec
    FROM embeddings, range(-255, 1) r(p) GROUP BY label, p""",
)
def p24(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id")
    return series.broadcast_positions(e).groupBy("label", "rel_pos").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_vec")
    )
