"""Counting, allocating, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from attnstrata.operators import compare, documents, matching, statistics
from attnstrata.sources.dataset import write_table
from attnstrata.session import materialize, scratch_path
from workloads import views as v
from workloads.registry import query, r6, sql_r6, table

TARGET = 500

SQL_CELLS = v.SQL_LINE_EVENTS + """,
cells AS (
  SELECT bin_id, cem_stratum_id, count_if(is_fail) AS n_fail_pool, count_if(NOT is_fail) AS n_ctrl_pool,
         least(count_if(is_fail), count_if(NOT is_fail)) AS n_matched_pairs
  FROM line_events GROUP BY ALL)"""


def sql_alloc(target: int) -> str:
    return f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY n_matched_pairs DESC, cem_stratum_id) AS cell_rank,
         CAST(sum(n_matched_pairs) OVER (PARTITION BY bin_id) AS BIGINT) AS total
  FROM cells WHERE n_matched_pairs > 0),
floors AS (
  SELECT *, {target} * n_matched_pairs // total AS base FROM ranked WHERE total >= {target}),
alloc AS (
  SELECT *, CAST(base + CASE WHEN cell_rank <= {target} - sum(base) OVER (PARTITION BY bin_id)
    THEN 1 ELSE 0 END AS BIGINT) AS n_take FROM floors)"""


def sql_matched(source: str) -> str:
    return f""",
matched AS (
  SELECT bin_id, cem_stratum_id, is_fail, event_id FROM {source} JOIN alloc USING (bin_id, cem_stratum_id)
  WHERE n_take > 0
  QUALIFY row_number() OVER (PARTITION BY bin_id, cem_stratum_id, is_fail
    ORDER BY sha256({v.sql_seed('match', 'bin_id')} || ':' || event_id), event_id) <= n_take)"""


@query(
    "a01_cell_counts",
    f"""WITH {SQL_CELLS} SELECT bin_id, cem_stratum_id, CAST(n_fail_pool AS BIGINT) AS n_fail_pool,
    CAST(n_ctrl_pool AS BIGINT) AS n_ctrl_pool, CAST(n_matched_pairs AS BIGINT) AS n_matched_pairs FROM cells""",
)
def a01(spark, sf):
    return matching.cell_counts(v.line_events(spark, sf))


@query(
    "a02_achievable_pairs",
    f"""WITH {SQL_CELLS} SELECT bin_id, CAST(sum(n_matched_pairs) AS BIGINT) AS achieved,
    CAST(4000 AS BIGINT) AS requested,
    CASE WHEN sum(n_matched_pairs) >= 4000 THEN 'matched' ELSE 'short' END AS status
    FROM cells GROUP BY bin_id""",
)
def a02(spark, sf):
    return matching.achievable_pairs(matching.cell_counts(v.line_events(spark, sf)), 4000)


@query(
    "a03_match_yield",
    f"""WITH {SQL_CELLS}, y AS (SELECT bin_id, count(*) AS n_strata,
      count_if(n_matched_pairs > 0) AS n_strata_with_matches, CAST(sum(n_fail_pool) AS BIGINT) AS total_fail_pool,
      CAST(sum(n_ctrl_pool) AS BIGINT) AS total_ctrl_pool, CAST(sum(n_matched_pairs) AS BIGINT) AS total_matched_pairs
      FROM cells GROUP BY bin_id)
    SELECT bin_id, n_strata, CAST(n_strata_with_matches AS BIGINT) AS n_strata_with_matches,
    total_fail_pool, total_ctrl_pool, total_matched_pairs,
    {sql_r6('CASE WHEN least(total_fail_pool, total_ctrl_pool) > 0 THEN 100.0 * total_matched_pairs / least(total_fail_pool, total_ctrl_pool) ELSE 0 END')} AS yield_pct,
    CASE WHEN least(total_fail_pool, total_ctrl_pool) > 0 THEN 100.0 * total_matched_pairs / least(total_fail_pool, total_ctrl_pool) ELSE 0 END < 50 AS is_compromised
    FROM y""",
)
def a03(spark, sf):
    y = matching.match_yield(matching.cell_counts(v.line_events(spark, sf)))
    return y.withColumn("yield_pct", r6("yield_pct"))


@query(
    "w01_rank_cells",
    f"""WITH {SQL_CELLS} {sql_alloc(TARGET)} SELECT bin_id, cem_stratum_id,
    CAST(n_matched_pairs AS BIGINT) AS n_matched_pairs, CAST(cell_rank AS INTEGER) AS cell_rank FROM ranked""",
)
def w01(spark, sf):
    cells = matching.cell_counts(v.line_events(spark, sf))
    return matching.rank_cells(cells).select("bin_id", "cem_stratum_id", "n_matched_pairs", "cell_rank")


@query(
    "w02_allocate",
    f"WITH {SQL_CELLS} {sql_alloc(777)} SELECT bin_id, cem_stratum_id, n_take FROM alloc",
)
def w02(spark, sf):
    cells = matching.cell_counts(v.line_events(spark, sf))
    return matching.allocate(cells, 777).select("bin_id", "cem_stratum_id", "n_take")


@query(
    "w03_sample_in_cell",
    f"""WITH {SQL_CELLS}
    SELECT bin_id, cem_stratum_id, is_fail, event_id FROM line_events JOIN cells USING (bin_id, cem_stratum_id)
    QUALIFY row_number() OVER (PARTITION BY bin_id, cem_stratum_id, is_fail
      ORDER BY sha256('cell:' || event_id), event_id) <= n_matched_pairs // 2""",
)
def w03(spark, sf):
    # counted twice and sampled: the join is shuffled once
    e = materialize(v.line_events(spark, sf), "line-events")
    half = matching.cell_counts(e).select(
        "bin_id", "cem_stratum_id", F.expr("n_matched_pairs div 2").alias("n_take")
    )
    return matching.sample_in_cells(e, half, seed="cell").select(
        "bin_id", "cem_stratum_id", "is_fail", "event_id"
    )


def sql_split(name: str, source: str, seed: str, key: str = "bin_id") -> str:
    """CTE of the source's rows with ``held_out``: a fifth of each group, shared out over both labels."""
    return f"""
{name}_c AS (SELECT {key}, is_fail, count(*) AS n, sum(count(*)) OVER (PARTITION BY {key}) AS total FROM {source} GROUP BY {key}, is_fail),
{name}_w AS (SELECT *, CAST(ceil(0.2 * total) AS BIGINT) AS wanted FROM {name}_c),
{name}_b AS (SELECT *, wanted * n // total AS base, wanted * n % total AS rest FROM {name}_w),
{name}_n AS (SELECT {key}, is_fail, base + CASE WHEN row_number() OVER (PARTITION BY {key} ORDER BY rest DESC, is_fail)
    <= wanted - sum(base) OVER (PARTITION BY {key}) THEN 1 ELSE 0 END AS n_out FROM {name}_b),
{name} AS (SELECT s.*, row_number() OVER (PARTITION BY s.{key}, s.is_fail ORDER BY sha256('{seed}:' || event_id), event_id) <= n_out AS held_out
  FROM {source} s JOIN {name}_n o ON s.{key} = o.{key} AND s.is_fail = o.is_fail)"""


@query(
    "w04_stratified_split",
    f"""WITH {v.SQL_LINE_EVENTS}, {sql_split('parts', 'line_events', 'split')} SELECT bin_id, is_fail, event_id, held_out FROM parts""",
)
def w04(spark, sf):
    e = v.line_events(spark, sf).select("bin_id", "is_fail", "event_id")
    return statistics.stratified_split(e, ["bin_id"], "is_fail", id_col="event_id")


@query(
    "c04_cem_match",
    f"""WITH {v.SQL_QA_EVENTS}, cells AS (
      SELECT bin_id, cem_stratum_id, count_if(is_fail) AS n_fail_pool, count_if(NOT is_fail) AS n_ctrl_pool,
             least(count_if(is_fail), count_if(NOT is_fail)) AS n_matched_pairs
      FROM qa_events GROUP BY ALL)
    {sql_alloc(3)} {sql_matched('qa_events')}
    SELECT bin_id, cem_stratum_id, is_fail, event_id FROM matched""",
)
def c04(spark, sf):
    matched, _ = matching.cem_match(v.qa_events(spark, sf), 3)
    return matched.select("bin_id", "cem_stratum_id", "is_fail", "event_id")


@query(
    "c04_cem_match_lines",
    f"""WITH {SQL_CELLS} {sql_alloc(TARGET)} {sql_matched('line_events')}
    SELECT bin_id, cem_stratum_id, is_fail, event_id FROM matched""",
)
def c04_lines(spark, sf):
    matched, _ = matching.cem_match(v.line_events(spark, sf), TARGET)
    return matched.select("bin_id", "cem_stratum_id", "is_fail", "event_id")


@query(
    "c04_cem_strata",
    f"""WITH {SQL_CELLS} {sql_alloc(TARGET)},
    s AS (SELECT bin_id, CAST(sum(n_matched_pairs) AS BIGINT) AS achieved FROM cells GROUP BY bin_id)
    SELECT c.bin_id, c.cem_stratum_id, CAST(c.n_fail_pool AS BIGINT) AS n_fail_pool,
    CAST(c.n_ctrl_pool AS BIGINT) AS n_ctrl_pool, CAST(c.n_matched_pairs AS BIGINT) AS n_matched_pairs,
    coalesce(a.n_take, 0) AS n_take, s.achieved, CAST({TARGET} AS BIGINT) AS requested,
    CASE WHEN s.achieved >= {TARGET} THEN 'matched' ELSE 'short' END AS status
    FROM cells c JOIN s USING (bin_id)
    LEFT JOIN alloc a ON a.bin_id = c.bin_id AND a.cem_stratum_id = c.cem_stratum_id""",
)
def c04_strata(spark, sf):
    return matching.cem_match(v.line_events(spark, sf), TARGET)[1]


TIER_TARGET = 200
SQL_TIERS = v.SQL_LINE_EVENTS + f""",
pooled AS (
  SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY sha256('pool:' || event_id), event_id) - 1 AS p
  FROM line_events QUALIFY p < {int(TIER_TARGET * 2 * 3.0)}),
counts AS (
  SELECT bin_id, cem_stratum_id, count_if(is_fail AND p < {int(TIER_TARGET * 2 * 1.5)}) AS f1,
         count_if(NOT is_fail AND p < {int(TIER_TARGET * 2 * 1.5)}) AS c1,
         count_if(is_fail) AS f2, count_if(NOT is_fail) AS c2
  FROM pooled GROUP BY ALL),
sums AS (
  SELECT bin_id, sum(least(f1, c1)) AS p1, sum(least(f2, c2)) AS p2,
         CASE WHEN least(sum(f1), sum(c1)) > 0 THEN 100.0 * sum(least(f1, c1)) / least(sum(f1), sum(c1)) ELSE 0 END AS y1,
         CASE WHEN least(sum(f2), sum(c2)) > 0 THEN 100.0 * sum(least(f2, c2)) / least(sum(f2), sum(c2)) ELSE 0 END AS y2
  FROM counts GROUP BY bin_id),
picked AS (SELECT *, p1 >= {TIER_TARGET} AND y1 >= 50 AS first FROM sums),
report AS (
  SELECT bin_id, CASE WHEN first THEN 1.5::DOUBLE ELSE 3.0::DOUBLE END AS oversample_factor,
         CAST(CASE WHEN first THEN {int(TIER_TARGET * 2 * 1.5)} ELSE {int(TIER_TARGET * 2 * 3.0)} END AS BIGINT) AS pool_size,
         CASE WHEN first THEN y1 ELSE y2 END AS yield_pct,
         CAST(CASE WHEN first THEN p1 ELSE p2 END AS BIGINT) AS achieved, CAST({TIER_TARGET} AS BIGINT) AS requested
  FROM picked),
judged AS (
  SELECT *, CASE WHEN achieved < requested OR yield_pct < 10 THEN 'needs_review'
                 WHEN yield_pct < 30 THEN 'compromised' ELSE 'matched' END AS status FROM report)"""


@query(
    "c05_cem_match_tiered",
    f"""WITH {SQL_TIERS}, usable AS (SELECT p.* FROM pooled p JOIN judged j USING (bin_id)
      WHERE status <> 'needs_review' AND p.p < j.pool_size),
    cells AS (
      SELECT bin_id, cem_stratum_id, least(count_if(is_fail), count_if(NOT is_fail)) AS n_matched_pairs
      FROM usable GROUP BY ALL)
    {sql_alloc(TIER_TARGET)} {sql_matched('usable')}
    SELECT bin_id, cem_stratum_id, is_fail, event_id FROM matched""",
)
def c05(spark, sf):
    matched, _, _ = matching.cem_match_tiered(v.line_events(spark, sf), TIER_TARGET)
    return matched.select("bin_id", "cem_stratum_id", "is_fail", "event_id")


@query(
    "c05_tier_report",
    f"""WITH {SQL_TIERS} SELECT bin_id, oversample_factor, pool_size, {sql_r6('yield_pct')} AS yield_pct,
    achieved, requested, status FROM judged""",
)
def c05_report(spark, sf):
    report = matching.cem_match_tiered(v.line_events(spark, sf), TIER_TARGET)[2]
    return report.withColumn("yield_pct", r6("yield_pct"))


@query(
    "l01_take_distractors",
    f"""WITH {v.SQL_FACTS} SELECT template_id, fact_id FROM facts
    QUALIFY row_number() OVER (PARTITION BY template_id
      ORDER BY sha256('distractor:' || template_id || '|' || fact_id), fact_id) <= 7""",
)
def l01(spark, sf):
    f = v.facts(spark, sf).select("template_id", "fact_id")
    return documents.take_distractors(f, keys=["template_id"], candidate="fact_id", n=7).drop("position")


@query(
    "l02_handcheck_sample",
    f"""WITH {v.SQL_LINE_EVENTS} SELECT DISTINCT bin_id, event_id, is_fail FROM
    (SELECT * FROM line_events ORDER BY sha256('handcheck:' || event_id), event_id LIMIT 50)""",
)
def l02(spark, sf):
    e = v.line_events(spark, sf).select("bin_id", "event_id", "is_fail")
    return matching.handcheck_sample(e).distinct()


@query(
    "l03_argmax",
    """SELECT l_returnflag, arg_max(l_shipmode, (total, -rank)) AS winner FROM (
      SELECT l_returnflag, CAST(l_linenumber AS INTEGER) AS l_shipmode, sum(CAST(l_quantity AS BIGINT)) AS total,
             CAST(l_linenumber AS INTEGER) AS rank FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""",
)
def l03(spark, sf):
    totals = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("total")
    )
    return compare.largest(totals, ["l_returnflag"], "total", "l_linenumber")


@query(
    "l05_stable_order",
    f"""WITH {v.SQL_DOC_EVENTS} SELECT event_id, doc_id,
    count(*) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before FROM doc_events""",
)
def l05(spark, sf):
    """Write the events in id order, read them back and number them."""
    from attnstrata.operators.positions import hash_segment, with_position

    e = v.doc_events(spark, sf).select("event_id", "doc_id")
    path = scratch_path(spark, "ordered")
    write_table(e, path, sort_by="event_id")
    back = spark.read.schema(e.schema).parquet(path).withColumn("_all", F.lit(1))
    placed = with_position(
        back, ["_all"], ["event_id"], segment=hash_segment("event_id"), name="n_before"
    )
    return placed.select("event_id", "doc_id", F.col("n_before").cast("bigint").alias("n_before"))
