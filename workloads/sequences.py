"""Series and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from attnstrata.operators import series
from attnstrata.operators import statistics
from workloads import views as v
from workloads.registry import query, r6, sql_r6, table

USER = ["user_id"]
ORDER = ["ts", "event_id"]
THRESHOLD = 200.0
DRIFT = 0.1414213562373095  # no sum of values lands on a rounding edge

SQL_CUSUM = v.SQL_SERIES + f""",
c AS (SELECT *, sum(x - {DRIFT!r}::DOUBLE) OVER w AS c FROM series WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
s AS (
  SELECT *, c - least(0, min(c) OVER w) AS pos, greatest(0, max(c) OVER w) - c AS neg
  FROM c WINDOW w AS (PARTITION BY user_id ORDER BY idx))"""


def _day():
    return F.to_date("ts")


def _cusum(spark, sf):
    return series.cusum(
        v.user_series(spark, sf), USER, ORDER, "x", threshold=THRESHOLD, drift=DRIFT, segment=_day()
    )


@query(
    "w08_cusum",
    f"""WITH {SQL_CUSUM} SELECT event_id, user_id, CAST(idx AS BIGINT) AS idx,
    {sql_r6('pos')} AS positive_cusum, {sql_r6('neg')} AS negative_cusum FROM s""",
)
def w08(spark, sf):
    return _cusum(spark, sf).select(
        "event_id",
        "user_id",
        F.col("idx").cast("bigint").alias("idx"),
        r6("positive_cusum").alias("positive_cusum"),
        r6("negative_cusum").alias("negative_cusum"),
    )


SQL_EWMA = v.SQL_SERIES + """,
lists AS (SELECT user_id, list(x ORDER BY idx) AS xs FROM series GROUP BY user_id),
smoothed AS (
  SELECT user_id, i, e FROM (
    SELECT user_id, i, list_reduce(list_prepend(DRIFT::DOUBLE, xs[1:i]), lambda a, b: 0.7 * a + 0.3 * b) AS e
    FROM (SELECT user_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM lists)))""".replace("DRIFT", repr(DRIFT))


@query(
    "w09_ewma",
    f"""WITH {SQL_EWMA} SELECT user_id, CAST(i - 1 AS BIGINT) AS idx, {sql_r6('e')} AS ewma,
    abs(e - {DRIFT!r}) > 25 AS alarm FROM smoothed""",
)
def w09(spark, sf):
    out = series.ewma(
        v.user_series(spark, sf), USER, ORDER, "x", threshold=25.0, drift=DRIFT, segment=_day()
    )
    return out.select("user_id", F.col("idx").cast("bigint").alias("idx"), r6("ewma").alias("ewma"), "alarm")


@query(
    "w10_first_alarm",
    f"""WITH {SQL_CUSUM} SELECT user_id, CAST(coalesce(min(CASE WHEN pos > {THRESHOLD} OR neg > {THRESHOLD}
    THEN idx END), -1) AS BIGINT) AS first_alarm_idx FROM s GROUP BY user_id""",
)
def w10(spark, sf):
    return series.first_alarm(_cusum(spark, sf), USER)


SQL_DAILY = """
daily AS (
  SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
         sum(CAST(round(value * 100) AS BIGINT)) AS cents
  FROM events GROUP BY ALL),
flagged AS (
  SELECT event_type, day, cents * n > total AS high FROM (
    SELECT *, sum(cents) OVER (PARTITION BY event_type) AS total,
           count(*) OVER (PARTITION BY event_type) AS n FROM daily)),
runs AS (
  SELECT event_type, CAST(min(day) AS INTEGER) AS lo, CAST(max(day) AS INTEGER) AS hi FROM (
    SELECT event_type, day, day - row_number() OVER (PARTITION BY event_type ORDER BY day) AS g
    FROM flagged WHERE high) GROUP BY event_type, g)"""


def daily_runs(spark, sf):
    """Runs of days with above-average totals per event type."""
    daily = table(spark, sf, "events").groupBy(
        "event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")
    ).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    totals = daily.groupBy("event_type").agg(
        F.sum("cents").alias("total"), F.count(F.lit(1)).alias("n")
    )
    high = F.col("cents") * F.col("n") > F.col("total")
    return statistics.islands(daily.join(totals, "event_type"), ["event_type"], "day", high)


@query("w11_islands", f"WITH {SQL_DAILY} SELECT event_type, lo, hi FROM runs")
def w11(spark, sf):
    return daily_runs(spark, sf)


@query(
    "w12_long_line_series",
    f"""WITH {v.SQL_CAPTURED} SELECT event_id, layer, head, count(*) AS n_points,
    {sql_r6('sum(list_sum(list_concat(q, k)) * rn)')} AS weighted FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id, layer, head ORDER BY token) AS rn FROM captured)
    GROUP BY ALL""",
)
def w12(spark, sf):
    total = F.aggregate(F.concat("q", "k"), F.lit(0.0), lambda a, x: a + x)
    atomic = v.captured(spark, sf).select(
        "event_id", "layer", "head", F.col("token").alias("rel_pos"), total.alias("f")
    )
    lines = series.long_line_series(atomic, "f")
    weighted = F.aggregate(
        F.transform("curve", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return lines.select(
        "event_id", "layer", "head", F.size("curve").cast("bigint").alias("n_points"), r6(weighted).alias("weighted")
    )


@query(
    "j14_align_to_commit",
    f"""WITH {v.SQL_SERIES}, commits AS (
      SELECT user_id, max(idx) AS commit FROM series WHERE event_type = 'error' GROUP BY user_id),
    o AS (SELECT unnest([0, 1, 2, 4, 8, 16, 32]) AS j)
    SELECT s.user_id, CAST(j AS INTEGER) AS lookback_j, s.event_id, {sql_r6('x')} AS x
    FROM commits c JOIN o ON c.commit >= 32 JOIN series s ON s.user_id = c.user_id AND s.idx = c.commit - j""",
)
def j14(spark, sf):
    from attnstrata.operators.positions import with_position

    s = with_position(v.user_series(spark, sf), USER, ORDER, segment=_day(), name="position")
    commits = (
        s.filter(F.col("event_type") == "error").groupBy("user_id").agg(F.max("position").alias("commit"))
    )
    aligned = series.align_to_commit(
        s.select("user_id", "position", "event_id", "x"), commits, USER, offsets=(0, 1, 2, 4, 8, 16, 32)
    )
    return aligned.select("user_id", "lookback_j", "event_id", r6("x").alias("x"))
