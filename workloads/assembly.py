"""Documents, distractors, grading."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attnstrata.functions import ids, text
from attnstrata.operators import documents
from attnstrata.operators.positions import with_position
from workloads import views as v
from workloads.registry import query, table


def _inputs(spark, sf):
    return v.plan(spark, sf), v.templates(spark, sf), v.facts(spark, sf)


N_WORDS = "len({})"
#: Facts in a block where a query shows that blocks do not change its rows.
SMALL_BLOCK = 300
SQL_ASSEMBLE = v.SQL_FACTS + "," + v.SQL_PLAN + f""",
own AS (SELECT template_id, count(*) AS own FROM facts GROUP BY template_id),
sized AS (
  SELECT p.*, greatest(1, CAST(floor(distractor_density * ((SELECT count(*) FROM facts) - own)) AS INTEGER)) AS n,
         replace(question_form, '{{subject}}', subject) AS question,
         replace(replace(statement_form, '{{subject}}', subject), '{{object}}', object) AS evidence
  FROM plan p JOIN own USING (template_id) JOIN templates USING (template_id)),
picks AS (
  SELECT p.plan_id, p.target_words, s.fact_id, s.statement, CAST(len({v.sql_words('s.statement')}) AS INTEGER) AS words,
         row_number() OVER (PARTITION BY p.plan_id
           ORDER BY sha256('distractor:' || p.plan_id || ':' || s.fact_id), s.fact_id) AS rn
  FROM sized p JOIN sentences s ON s.template_id <> p.template_id
  QUALIFY rn <= p.n),
placed AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY plan_id ORDER BY rn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < target_words AS before FROM picks),
sides AS (
  SELECT plan_id, coalesce(sum(words) FILTER (before), 0) AS words_before,
         string_agg(statement, ' ' ORDER BY rn) FILTER (before) AS head,
         string_agg(statement, ' ' ORDER BY sha256('tail:' || plan_id || ':' || fact_id)) FILTER (NOT before) AS tail
  FROM placed GROUP BY plan_id),
docs AS (
  SELECT *, concat_ws(' ', head, evidence, tail) AS document,
         CAST(words_before + len({v.sql_words('evidence')}) AS INTEGER) AS evidence_position_token_idx
  FROM sized JOIN sides USING (plan_id)),
assembled AS (
  SELECT *, sha256('{v.SHA}' || document || question || object) AS event_id,
         CAST(len({v.sql_words('document')}) + len({v.sql_words('question')}) + 3
           - evidence_position_token_idx AS INTEGER) AS evidence_distance_tokens,
         words_before >= target_words AS target_reached,
         CAST(len({v.sql_words('object')}) AS INTEGER) AS gold_answer_length_tokens
  FROM docs)"""


ASSEMBLED = (
    "plan_id", "event_id", "question_template_id", "question", "gold_answer",
    "evidence_position_token_idx", "evidence_distance_tokens", "bin_id", "target_reached",
    "cem_stratum_id", "gold_answer_normalized", "per_event_seed",
)
SQL_C01 = f"""WITH {SQL_ASSEMBLE} SELECT plan_id, event_id, template_id AS question_template_id, question, object AS gold_answer,
    evidence_position_token_idx, evidence_distance_tokens,
    {v.sql_bin('evidence_distance_tokens')} AS bin_id, target_reached,
    template_id || '|' || {v.sql_density('distractor_density')} || '|' || {v.sql_length('gold_answer_length_tokens')} AS cem_stratum_id,
    {v.sql_normalize('object')} AS gold_answer_normalized,
    {v.sql_seed('event', 'event_id')} AS per_event_seed FROM assembled"""


@query("c01_assemble_documents", SQL_C01)
def c01(spark, sf):
    return documents.assemble_documents(*_inputs(spark, sf)).select(*ASSEMBLED)


@query("c01_small_blocks", f"SELECT q.* FROM ({SQL_C01}) q, (VALUES (1), (2)) AS twice(k)")
def c01_small_blocks(spark, sf):
    """Every plan row twice, over a catalogue cut into many blocks."""
    p, t, f = _inputs(spark, sf)
    return documents.assemble_documents(p.unionByName(p), t, f, block_facts=SMALL_BLOCK).select(*ASSEMBLED)


POLICY_SQL = """CASE plan_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'lexical'
  WHEN 2 THEN 'sibling_entity' ELSE 'self_contradiction' END"""


def _policy():
    k = F.col("plan_id") % 4
    return (
        F.when(k == 0, "none").when(k == 1, "lexical").when(k == 2, "sibling_entity")
        .otherwise("self_contradiction")
    )


def _plain_events(spark, sf):
    """One short event per customer: its evidence sentence is the whole document."""
    p, t, _ = _inputs(spark, sf)
    s, o = F.col("subject"), F.col("object")
    base = p.join(t, "template_id").select(
        "plan_id",
        F.col("template_id").alias("question_template_id"),
        F.concat(text.fill_template(F.col("statement_form"), s, o), F.lit(" No. "), F.col("plan_id").cast("string")).alias("document"),
        text.fill_template(F.col("question_form"), s).alias("question"),
        o.alias("gold_answer"),
        _policy().alias("adversariality_policy"),
    )
    return ids.with_event_id(base)


SQL_PLAIN = v.SQL_FACTS + "," + v.SQL_PLAN + f""",
plain_base AS (
  SELECT plan_id, template_id AS question_template_id,
         replace(replace(statement_form, '{{subject}}', subject), '{{object}}', object) || ' No. ' || plan_id AS document,
         replace(question_form, '{{subject}}', subject) AS question, object AS gold_answer,
         {POLICY_SQL} AS adversariality_policy, statement_form
  FROM plan JOIN templates USING (template_id)),
first_facts AS (
  SELECT template_id, object, arg_min(subject, fact_id) AS fact_subject FROM facts GROUP BY ALL),
plain AS (
  SELECT b.*, sha256('{v.SHA}' || document || question || gold_answer) AS event_id,
         coalesce(f.fact_subject, gold_answer) AS fact_subject
  FROM plain_base b LEFT JOIN first_facts f ON f.template_id = b.question_template_id AND f.object = b.gold_answer)"""


SQL_C02 = f"""WITH {SQL_PLAIN}, candidates AS (
      SELECT e.event_id, s.fact_id, CASE WHEN adversariality_policy = 'self_contradiction'
          THEN replace(replace(e.statement_form, '{{subject}}', e.fact_subject), '{{object}}', s.object)
          ELSE s.statement END AS statement,
        row_number() OVER (PARTITION BY e.event_id ORDER BY sha256('adversarial:' || e.event_id || ':' || s.fact_id)) AS rn,
        CASE WHEN adversariality_policy = 'self_contradiction' THEN 1 ELSE 3 END AS n
      FROM plain e JOIN sentences s ON CASE
        WHEN adversariality_policy = 'lexical' THEN s.object <> e.gold_answer
          AND len(list_intersect({v.sql_content_tokens('e.question')}, {v.sql_content_tokens('s.statement')})) >= 2
        WHEN adversariality_policy = 'none' THEN false
        ELSE s.template_id = e.question_template_id AND s.subject <> e.fact_subject AND s.object <> e.gold_answer END
      QUALIFY rn <= n),
    extra AS (SELECT event_id, count(*) AS k, string_agg(statement, ' ' ORDER BY rn) AS t FROM candidates GROUP BY event_id),
    done AS (SELECT p.plan_id, p.adversariality_policy, p.question, p.gold_answer, p.event_id AS old_id,
        CASE WHEN t IS NULL THEN document ELSE document || ' ' || t END AS document,
        CAST(coalesce(k, 0) AS INTEGER) AS n_injected FROM plain p LEFT JOIN extra USING (event_id))
    SELECT plan_id, adversariality_policy, document, n_injected,
    CASE WHEN n_injected > 0 THEN sha256('{v.SHA}' || document || question || gold_answer) ELSE old_id END AS event_id
    FROM done"""
INJECTED = ("plan_id", "adversariality_policy", "document", "n_injected", "event_id")


@query("c02_inject_distractors", SQL_C02)
def c02(spark, sf):
    _, t, f = _inputs(spark, sf)
    return documents.inject_distractors(_plain_events(spark, sf), t, f).select(*INJECTED)


@query("c02_small_blocks", f"SELECT q.* FROM ({SQL_C02}) q, (VALUES (1), (2)) AS twice(k)")
def c02_small_blocks(spark, sf):
    """Every event twice, over a catalogue cut into many blocks."""
    _, t, f = _inputs(spark, sf)
    events = _plain_events(spark, sf)
    return documents.inject_distractors(
        events.unionByName(events), t, f, block_facts=SMALL_BLOCK
    ).select(*INJECTED)


TRIM = (
    "CASE WHEN contains(g, chr(10)) THEN split_part(g, chr(10), 1) "
    "WHEN contains(g, '<|end|>') THEN split_part(g, '<|end|>', 1) ELSE g END"
)


@query(
    "c03_grade",
    f"""WITH {v.SQL_DOC_EVENTS}, raw AS (
      SELECT e.*, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN ' The ' || gold_answer || '.' || chr(10) || lower(source)
        ELSE question_template_id || '<|end|>' || gold_answer END AS g
      FROM doc_events e LEFT JOIN labels l USING (doc_id)),
    t AS (SELECT *, {TRIM} AS model_generation FROM raw)
    SELECT doc_id, {v.sql_normalize('model_generation')} AS model_generation_normalized,
    {v.sql_normalize('gold_answer')} AS gold_answer_normalized,
    {v.sql_normalize('model_generation')} <> {v.sql_normalize('gold_answer')} AS is_fail FROM t""",
)
def c03(spark, sf):
    e = v.doc_events(spark, sf)
    good = F.concat(F.lit(" The "), "gold_answer", F.lit(".\n"), F.lower("source"))
    bad = F.concat("question_template_id", F.lit("<|end|>"), "gold_answer")
    generations = e.join(table(spark, sf, "labels"), "doc_id").select(
        "event_id", F.when(F.col("quality") == 1, good).otherwise(bad).alias("generation")
    )
    return documents.grade(e, generations).select(
        "doc_id", "model_generation_normalized", "gold_answer_normalized", "is_fail"
    )


@query(
    "j04_other_template_facts",
    f"""WITH {v.SQL_FACTS} SELECT t.template_id AS for_template, f.fact_id, f.template_id
    FROM templates t JOIN facts f ON t.template_id <> f.template_id""",
)
def j04(spark, sf):
    return documents.other_template_facts(v.templates(spark, sf), v.facts(spark, sf))


@query(
    "j05_sibling_facts",
    f"""WITH {v.SQL_FACTS}, {v.SQL_PLAN} SELECT plan_id, (SELECT count(*) FROM facts f
      WHERE f.template_id = p.template_id AND f.subject <> p.subject AND f.object <> p.object) AS n_siblings
    FROM plan p""",
)
def j05(spark, sf):
    p, _, f = _inputs(spark, sf)
    return documents.sibling_facts(p, f).select("plan_id", "n_siblings")


@query(
    "j06_lexical_pairs",
    f"""WITH d AS (SELECT doc_id, unnest({v.sql_content_tokens('text')}) AS token FROM documents),
    b AS (SELECT item_id, unnest({v.sql_content_tokens('text')}) AS token FROM benchmark)
    SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (token)
    GROUP BY ALL HAVING count(*) >= 2""",
)
def j06(spark, sf):
    return documents.lexical_pairs(
        table(spark, sf, "documents"),
        table(spark, sf, "benchmark"),
        question_id="doc_id",
        candidate_id="item_id",
    )


SQL_PAIRS = f"""d AS (SELECT doc_id, unnest({v.sql_content_tokens("text || ' everywhere'")}) AS token FROM documents),
    b AS (SELECT item_id, unnest({v.sql_content_tokens("text || ' everywhere'")}) AS token FROM benchmark),
    pairs AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (token) GROUP BY ALL HAVING count(*) >= 2)"""


def _with_common_word(spark, sf):
    """Documents and benchmark items with one word that all of them have."""
    everywhere = F.concat("text", F.lit(" everywhere"))
    return table(spark, sf, "documents").withColumn("text", everywhere), table(spark, sf, "benchmark").withColumn("text", everywhere)


@query("j06_common_word", f"WITH {SQL_PAIRS} SELECT doc_id, item_id, n_shared FROM pairs")
def j06_common_word(spark, sf):
    return documents.lexical_pairs(*_with_common_word(spark, sf), question_id="doc_id", candidate_id="item_id")


@query(
    "j06_lexical_distractors",
    f"""WITH {SQL_PAIRS} SELECT doc_id, item_id, n_shared FROM pairs
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sha256('adversarial:' || doc_id || '|' || item_id), item_id) <= 3""",
)
def j06_lexical_distractors(spark, sf):
    found = documents.lexical_distractors(*_with_common_word(spark, sf), question_id="doc_id", candidate_id="item_id")
    return found.drop("position")


@query(
    "j07_first_fact",
    f"""WITH {v.SQL_FACTS}, {v.SQL_PLAN} SELECT plan_id, coalesce((SELECT arg_min(f.subject, f.fact_id)
      FROM facts f WHERE f.template_id = p.template_id AND f.object = p.object), p.object) AS fact_subject
    FROM plan p""",
)
def j07(spark, sf):
    p, _, f = _inputs(spark, sf)
    events = p.withColumnsRenamed({"template_id": "question_template_id", "object": "gold_answer"})
    return documents.first_fact(events, f).select("plan_id", "fact_subject")


SQL_SENTENCES = f"""
sents AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s AS sentence,
         CAST(len({v.sql_words('s')}) AS INTEGER) AS words
  FROM (SELECT doc_id, string_split(text, '.') AS parts FROM documents), 
       LATERAL (SELECT unnest(parts) AS s, unnest(range(1, len(parts) + 1)) AS i))"""


def _sentences(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", r"\.")).alias("pos", "sentence")
    )
    return d.withColumn("words", text.count_word_tokens(F.col("sentence")))


@query(
    "w06_running_words",
    f"""WITH {SQL_SENTENCES}, r AS (SELECT doc_id, pos, words,
      coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS placed FROM sents)
    SELECT doc_id, pos, CAST(placed AS BIGINT) AS placed FROM r""",
)
def w06(spark, sf):
    return documents.running_words(_sentences(spark, sf), ["doc_id"], "pos").select("doc_id", "pos", "placed")


@query(
    "l04_shuffle_tail",
    f"""WITH {SQL_SENTENCES} SELECT doc_id, sha256(string_agg(sentence, ' '
      ORDER BY sha256('tail:' || doc_id || ':' || pos))) AS shuffled_sha FROM sents GROUP BY doc_id""",
)
def l04(spark, sf):
    """Sentences of each document in seeded order, joined again."""
    key = ids.order_key("tail", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")))
    out = documents.shuffle_tail(_sentences(spark, sf), ["doc_id"], key)
    return out.select("doc_id", F.sha2("shuffled", 256).alias("shuffled_sha"))
