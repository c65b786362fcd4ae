"""The study's input tables, derived from the given tables by Spark, and the same
derivations as SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attnstrata.functions import bins, ids, text
from attnstrata.functions import fixed_values as fixed
from workloads.registry import table

SHA = ids.PROMPT_TEMPLATE_SHA256

# Python's whitespace, spelled for RE2.
SQL_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_bin(x: str, edges=fixed.BINS) -> str:
    whens = " ".join(f"WHEN {x} >= {lo} AND {x} < {hi} THEN '{b}'" for b, lo, hi in edges)
    return f"CASE {whens} END"


def sql_normalize(x: str) -> str:
    s = SQL_SPACE
    out = f"lower({x})"
    out = f"regexp_replace({out}, '^{s}*[[:punct:]]*{s}*', '')"
    out = f"regexp_replace({out}, '^(the |an |a ){s}*', '')"
    out = f"regexp_replace({out}, '{s}+', ' ', 'g')"
    return f"regexp_replace({out}, '{s}*[[:punct:]]*{s}*$', '')"


def sql_words(x: str) -> str:
    return f"[w for w in string_split_regex({x}, '{SQL_SPACE}+') if w <> '']"


def sql_content_tokens(x: str) -> str:
    return (
        f"list_distinct([w for w in string_split_regex(lower({x}), '{SQL_SPACE}+') "
        "if length(w) > 3])"
    )


def sql_seed(namespace: str, key: str, digits: int = 8) -> str:
    return f"('0x' || substr(sha1('{namespace}:' || {key}), 1, {digits}))::BIGINT"


def sql_density(x: str) -> str:
    return f"CASE WHEN {x} < 0.25 THEN 'low' WHEN {x} < 0.75 THEN 'med' ELSE 'high' END"


def sql_length(x: str) -> str:
    return f"CASE WHEN {x} <= 1 THEN '1' WHEN {x} <= 3 THEN '2-3' ELSE '4+' END"


# ---------------------------------------------------------------- events from documents


def doc_events(spark: SparkSession, sf: str) -> DataFrame:
    """One ungraded event per document: distance = n_chars, gold = first line."""
    d = table(spark, sf, "documents")
    question = F.concat(
        F.lit("What opens the "), "lang", F.lit(" document "), F.col("doc_id").cast("string"),
        F.lit(" of "), "source", F.lit("?"),
    )
    density = F.substring("source", 4, 3).cast("int") / F.lit(20.0)
    return ids.with_event_id(
        d.select(
            "doc_id",
            F.col("text").alias("document"),
            question.alias("question"),
            F.substring_index("text", "\n", 1).alias("gold_answer"),
            F.col("lang").alias("question_template_id"),
            F.col("n_chars").cast("int").alias("evidence_distance_tokens"),
            bins.assign_bin(F.col("n_chars")).alias("bin_id"),
            density.alias("distractor_density"),
            "source",
        )
    )


SQL_DOC_EVENTS = f"""
doc_base AS (
  SELECT doc_id, text AS document,
         'What opens the ' || lang || ' document ' || doc_id || ' of ' || source || '?' AS question,
         split_part(text, chr(10), 1) AS gold_answer, lang AS question_template_id,
         CAST(n_chars AS INTEGER) AS evidence_distance_tokens,
         {sql_bin('n_chars')} AS bin_id,
         CAST(substr(source, 4) AS INTEGER) / 20.0::DOUBLE AS distractor_density, source
  FROM documents),
doc_events AS (
  SELECT *, sha256('{SHA}' || document || question || gold_answer) AS event_id FROM doc_base)
"""


def qa_events(spark: SparkSession, sf: str) -> DataFrame:
    """Graded, stratified events: the labelled documents inside the bins.

    A document of quality 0 answers with its language instead of its first line.
    """
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    n_gold = text.count_word_tokens(F.col("gold_answer"))
    return (
        doc_events(spark, sf)
        .filter(F.col("bin_id").isNotNull())
        .join(labels, "doc_id")
        .withColumn("is_fail", F.col("quality") == 0)
        .withColumn("distractor_density_coarsening", bins.coarsen_density(F.col("distractor_density")))
        .withColumn("gold_answer_length_tokens", n_gold)
        .withColumn("gold_answer_length_coarsening", bins.coarsen_length(n_gold))
        .withColumn(
            "cem_stratum_id",
            bins.stratum_id(
                F.col("question_template_id"),
                F.col("distractor_density_coarsening"),
                F.col("gold_answer_length_coarsening"),
            ),
        )
    )


SQL_QA_EVENTS = SQL_DOC_EVENTS + f""",
qa_base AS (
  SELECT e.*, l.quality = 0 AS is_fail,
         {sql_density('distractor_density')} AS distractor_density_coarsening,
         CAST(len({sql_words('gold_answer')}) AS INTEGER) AS gold_answer_length_tokens
  FROM doc_events e JOIN labels l USING (doc_id) WHERE bin_id IS NOT NULL),
qa_events AS (
  SELECT *, {sql_length('gold_answer_length_tokens')} AS gold_answer_length_coarsening,
         question_template_id || '|' || distractor_density_coarsening || '|' ||
         {sql_length('gold_answer_length_tokens')} AS cem_stratum_id
  FROM qa_base)
"""


def full_events(spark: SparkSession, sf: str) -> DataFrame:
    """The 19-column event table of the labelled documents."""
    e = qa_events(spark, sf)
    generation = F.when(F.col("is_fail"), F.col("question_template_id")).otherwise(
        F.concat(F.lit(" The "), F.col("gold_answer"), F.lit(". "))
    )
    full = (
        e.withColumn("evidence_position_token_idx", F.lit(0))
        .withColumn("adversariality_policy", F.lit("none"))
        .withColumn("model_generation", generation)
        .withColumn("model_generation_normalized", text.normalize_em(generation))
        .withColumn("gold_answer_normalized", text.normalize_em(F.col("gold_answer")))
        .withColumn("per_event_seed", ids.derive_seed("event", F.col("event_id")))
    )
    return full.select(*[F.col(c).cast(t).alias(c) for c, t in fixed.EVENT_COLUMNS])


SQL_FULL_EVENTS = SQL_QA_EVENTS + f""",
full_base AS (
  SELECT *, 0 AS evidence_position_token_idx, 'none' AS adversariality_policy,
         CASE WHEN is_fail THEN question_template_id
              ELSE ' The ' || gold_answer || '. ' END AS model_generation
  FROM qa_events),
full_events AS (
  SELECT *, {sql_normalize('model_generation')} AS model_generation_normalized,
         {sql_normalize('gold_answer')} AS gold_answer_normalized,
         {sql_seed('event', 'event_id')} AS per_event_seed
  FROM full_base)
"""


# ---------------------------------------------------------------- matching at scale


def line_events(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as events: returned lines fail, order priority is the bin."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    band = F.floor(F.col("l_quantity") / 13).cast("string")
    disc = F.floor(F.col("l_discount") * 100 / 4 + 0.001).cast("string")
    key = F.concat_ws(
        "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
        F.col("l_quantity").cast("int").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
    )
    return li.join(o.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("bin_id"),
        F.concat_ws("|", "l_linestatus", band, disc).alias("cem_stratum_id"),
        (F.col("l_returnflag") == "R").alias("is_fail"),
        key.alias("event_id"),
    )


SQL_LINE_EVENTS = """
line_events AS (
  SELECT o_orderpriority AS bin_id,
         l_linestatus || '|' || CAST(floor(l_quantity / 13) AS INTEGER) || '|' ||
         CAST(floor(l_discount * 100 / 4 + 0.001) AS INTEGER) AS cem_stratum_id,
         l_returnflag = 'R' AS is_fail,
         concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   CAST(l_quantity AS INTEGER), CAST(round(l_extendedprice * 100) AS BIGINT)) AS event_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


# ---------------------------------------------------------------- fact catalogue


def templates(spark: SparkSession, sf: str) -> DataFrame:
    """Three sentence forms for the three kinds of facts in the given tables."""
    return spark.createDataFrame(
        [
            ("region_of", "Which region is {subject} in?", "{subject} lies in {object}."),
            ("maker_of", "What goods come from {subject}?", "Goods from {subject} are {object}."),
            ("segment_of", "Which market does {subject} serve?", "The market of {subject} is {object}."),
        ],
        "template_id string, question_form string, statement_form string",
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts: nation-region, brand-type and nation-segment pairs of the tables."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    p, c = table(spark, sf, "part"), table(spark, sf, "customer")
    region = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("region_of").alias("template_id"), F.col("n_name").alias("subject"), F.col("r_name").alias("object")
    )
    maker = p.select(
        F.lit("maker_of").alias("template_id"), F.col("p_brand").alias("subject"), F.col("p_type").alias("object")
    ).distinct()
    segment = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lit("segment_of").alias("template_id"), F.col("n_name").alias("subject"), F.col("c_mktsegment").alias("object")
    ).distinct()
    union = region.unionByName(maker).unionByName(segment)
    return union.withColumn(
        "fact_id", ids.derive_long("fact", F.concat_ws("|", "template_id", "subject", "object"))
    )


SQL_FACTS = f"""
templates AS (
  SELECT * FROM (VALUES
    ('region_of', 'Which region is {{subject}} in?', '{{subject}} lies in {{object}}.'),
    ('maker_of', 'What goods come from {{subject}}?', 'Goods from {{subject}} are {{object}}.'),
    ('segment_of', 'Which market does {{subject}} serve?', 'The market of {{subject}} is {{object}}.')
  ) t(template_id, question_form, statement_form)),
fact_rows AS (
  SELECT 'region_of' AS template_id, n_name AS subject, r_name AS object
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT 'maker_of', p_brand, p_type FROM part
  UNION ALL SELECT DISTINCT 'segment_of', n_name, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
facts AS (
  SELECT *, {sql_seed('fact', "template_id || '|' || subject || '|' || object", 15)} AS fact_id
  FROM fact_rows),
sentences AS (
  SELECT f.*, replace(replace(statement_form, '{{subject}}', subject), '{{object}}', object) AS statement
  FROM facts f JOIN templates USING (template_id))
"""


def plan(spark: SparkSession, sf: str) -> DataFrame:
    """One planned event per customer: a fact about its nation, a target and a density."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(
        r, F.col("n_regionkey") == F.col("r_regionkey")
    )
    about_region = F.col("c_custkey") % 2 == 0
    key = F.col("c_custkey").cast("string")
    return joined.select(
        F.col("c_custkey").alias("plan_id"),
        F.when(about_region, "region_of").otherwise("segment_of").alias("template_id"),
        F.col("n_name").alias("subject"),
        F.when(about_region, F.col("r_name")).otherwise(F.col("c_mktsegment")).alias("object"),
        (ids.derive_seed("target", key) % 600).cast("int").alias("target_words"),
        ((ids.derive_seed("density", key) % 1000) / 1000.0).alias("distractor_density"),
    )


SQL_PLAN = f"""
plan AS (
  SELECT c_custkey AS plan_id,
         CASE WHEN c_custkey % 2 = 0 THEN 'region_of' ELSE 'segment_of' END AS template_id,
         n_name AS subject, CASE WHEN c_custkey % 2 = 0 THEN r_name ELSE c_mktsegment END AS object,
         CAST({sql_seed('target', 'c_custkey')} % 600 AS INTEGER) AS target_words,
         ({sql_seed('density', 'c_custkey')} % 1000) / 1000.0::DOUBLE AS distractor_density
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


# ---------------------------------------------------------------- attention


def attention(spark: SparkSession, sf: str) -> DataFrame:
    """Trade between nations as attention, one graph per order month: the share of a
    customer nation's spending that goes to each supplier nation.
    """
    li, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    flows = (
        li.select("l_orderkey", "l_suppkey", "l_extendedprice")
        .join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("gid"),
            F.col("c_nationkey").alias("src"),
            F.col("s_nationkey").alias("dst"),
        )
        .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    )
    total = flows.groupBy("gid", "src").agg(F.sum("cents").alias("total"))
    return flows.join(total, ["gid", "src"]).select(
        "gid", "src", "dst", (F.col("cents") / F.col("total")).alias("w")
    )


SQL_ATTENTION = """
flows AS (
  SELECT year(o_orderdate) * 100 + month(o_orderdate) AS gid, c_nationkey AS src, s_nationkey AS dst,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY ALL),
attn AS (
  SELECT CAST(gid AS INTEGER) AS gid, src, dst,
         CAST(cents AS DOUBLE) / CAST(sum(cents) OVER (PARTITION BY gid, src) AS DOUBLE) AS w
  FROM flows)
"""

SQL_GRAPH = SQL_ATTENTION + """,
topk AS (
  SELECT * FROM attn WHERE src <> dst
  QUALIFY row_number() OVER (PARTITION BY gid, src ORDER BY w DESC, dst) <= 4),
sym AS (
  SELECT t.gid, t.src, t.dst, (t.w + coalesce(b.w, 0)) * 0.5 AS w
  FROM topk t LEFT JOIN attn b ON b.gid = t.gid AND b.src = t.dst AND b.dst = t.src),
edges AS (
  SELECT gid, least(src, dst) AS lo, greatest(src, dst) AS hi, max(w) AS w
  FROM sym WHERE w > 0 GROUP BY ALL),
nodes AS (SELECT DISTINCT gid, unnest([src, dst]) AS node FROM attn),
adj AS (SELECT gid, lo AS u, hi AS v, w FROM edges UNION ALL SELECT gid, hi, lo, w FROM edges)
"""


# ---------------------------------------------------------------- captured vectors

N_LAYERS, N_HEADS, D_HEAD, K_GRASS = 4, 10, 8, 4


def captured(spark: SparkSession, sf: str) -> DataFrame:
    """Query and key vectors per (event, layer, head, token): 250 consecutive
    embeddings form an event, the label is the head, slices of the vector are layers.
    """
    e = table(spark, sf, "embeddings")
    layers = F.explode(F.sequence(F.lit(0), F.lit(N_LAYERS - 1)))

    def part(offset: int):
        start = F.col("layer") * D_HEAD + offset + 1
        return F.transform(F.slice(F.col("embedding"), start, F.lit(D_HEAD)), lambda v: v.cast("double"))

    return (
        e.select(
            F.expr("vec_id div 250").alias("event_id"),
            F.col("label").alias("head"),
            F.col("vec_id").alias("token"),
            "embedding",
        )
        .withColumn("layer", layers)
        .select("event_id", "layer", "head", "token", part(0).alias("q"), part(32).alias("k"))
    )


SQL_CAPTURED = f"""
captured AS (
  SELECT vec_id // 250 AS event_id, CAST(layer AS INTEGER) AS layer, label AS head, vec_id AS token,
         [x::DOUBLE for x in embedding[layer * {D_HEAD} + 1 : layer * {D_HEAD} + {D_HEAD}]] AS q,
         [x::DOUBLE for x in embedding[layer * {D_HEAD} + 33 : layer * {D_HEAD} + 32 + {D_HEAD}]] AS k
  FROM embeddings, range({N_LAYERS}) r(layer)),
entries AS (
  SELECT event_id, layer, head, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j,
         sum(q[i] * k[j]) AS qk, sum(q[i] * q[j]) AS qq
  FROM captured, range(1, {D_HEAD + 1}) a(i), range(1, {D_HEAD + 1}) b(j)
  GROUP BY ALL)
"""


#: Seven numbers that take in all entries of both vectors: sums of entries of the same place, the last of two places.
SQL_SEVEN = [f"(q[{i}] + k[{i}])" for i in range(1, 7)] + ["(q[7] + k[7] + q[8] + k[8])"]


def seven():
    """``SQL_SEVEN`` as columns."""
    q, k = (lambda i: F.get("q", F.lit(i))), (lambda i: F.get("k", F.lit(i)))
    return [q(i) + k(i) for i in range(6)] + [q(6) + k(6) + q(7) + k(7)]


def user_series(spark: SparkSession, sf: str) -> DataFrame:
    """Event values of each user, less the user's mean, in time order."""
    e = table(spark, sf, "events")
    mean = e.groupBy("user_id").agg((F.sum(F.round(F.col("value") * 100).cast("bigint")) / F.count(F.lit(1)) / 100).alias("m"))
    return e.select("event_id", "user_id", "ts", "event_type", "value").join(mean, "user_id").select(
        "event_id", "user_id", "ts", "event_type", (F.col("value") - F.col("m")).alias("x")
    )


SQL_SERIES = """
means AS (
  SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS m
  FROM events GROUP BY user_id),
series AS (
  SELECT event_id, user_id, ts, event_type, value - m AS x,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
  FROM events JOIN means USING (user_id))
"""
