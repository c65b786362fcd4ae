"""Content-derived ids, seeds and digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed

PROMPT_TEMPLATE_SHA256 = hashlib.sha256(fixed.PROMPT_TEMPLATE.encode()).hexdigest()


def event_id(
    template_sha: Column | str, document: Column, question: Column, gold: Column
) -> Column:
    """SHA-256 of the plain concatenation; null if any part is null."""
    sha = F.lit(template_sha) if isinstance(template_sha, str) else template_sha
    return F.sha2(F.concat(sha, document, question, gold), 256)


def with_event_id(df: DataFrame, template_sha: str = PROMPT_TEMPLATE_SHA256) -> DataFrame:
    return df.withColumn(
        "event_id",
        event_id(template_sha, F.col("document"), F.col("question"), F.col("gold_answer")),
    )


def id_matches(template_sha: str = PROMPT_TEMPLATE_SHA256) -> Column:
    """True where ``event_id`` is the one its own text gives."""
    return F.col("event_id") == event_id(
        template_sha, F.col("document"), F.col("question"), F.col("gold_answer")
    )


def bad_id_count(df: DataFrame, template_sha: str = PROMPT_TEMPLATE_SHA256) -> DataFrame:
    ok = F.coalesce(id_matches(template_sha), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(~ok).alias("n_bad_ids")
    )


def _hex_number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def derive_seed(namespace: str, key: Column) -> Column:
    """Unsigned 32-bit seed: the first eight hex digits of SHA-1(namespace:key)."""
    return _hex_number(F.sha1(F.concat(F.lit(f"{namespace}:"), key)), 8)


def derive_long(namespace: str, key: Column) -> Column:
    """The same rule with fifteen hex digits, for draws over large ranges."""
    return _hex_number(F.sha1(F.concat(F.lit(f"{namespace}:"), key)), 15)


def order_key(seed: Column | str, key: Column) -> Column:
    """Hash that puts rows into a seeded pseudo-random, repeatable order."""
    seed = F.lit(seed) if isinstance(seed, str) else seed.cast("string")
    return F.sha2(F.concat(seed, F.lit(":"), key.cast("string")), 256)


def _row_text(df: DataFrame) -> Column:
    parts = []
    for name in sorted(df.columns):
        text = F.col(name).cast("string")
        parts.append(
            F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.concat(*parts)


def dataset_digest(df: DataFrame) -> DataFrame:
    """One-row digest of the table's content, whatever its order and file layout.

    Each row is hashed, the hash is cut into four numbers, and the numbers are
    summed: a plain partial + final aggregate of constant size, so duplicates
    count and no task ever holds more than one running row.
    Arrays, maps and structs are digested through their string form.
    """
    hashed = df.select(F.sha2(_row_text(df), 256).alias("h"))
    lanes = [
        F.sum(F.conv(F.substring(F.col("h"), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
        for i in range(4)
    ]
    total = hashed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.coalesce(lane, F.lit(0)).cast("string").alias(f"s{i}") for i, lane in enumerate(lanes)],
    )
    return total.select(
        "n_rows",
        F.sha2(
            F.concat_ws(":", F.col("n_rows").cast("string"), "s0", "s1", "s2", "s3"), 256
        ).alias("digest"),
    )
