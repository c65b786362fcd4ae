"""Quality rules as a ledger of failure bits.

Every rule is evaluated once a document. The ledger keeps the measurements and one bit for each rule that
the document fails. Policies are versions of a mask over these bits, so a new policy, or the effect of
leaving a rule out, needs the ledger alone and never the texts again. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of blanks: space and the controls 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

#: Bit by rule, and when the rule fails, from the measurements.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (1, "n_words < 10"),
    "repeated_words": (2, "100 * n_repeat_words > 20 * n_words"),
    "symbols": (4, "100 * n_symbols > 10 * word_chars"),
    "repeated_lines": (8, "100 * n_dup_lines > 30 * n_lines"),
    "capitals": (16, "100 * n_capitals > 50 * word_chars"),
    "word_length": (32, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
}
#: Rules of each policy version.
POLICIES: dict[str, tuple[str, ...]] = {
    "1": ("few_words", "repeated_words"),
    "2": tuple(RULES),
}
LATEST = "2"


def mask(version: str) -> int:
    return sum(RULES[rule][0] for rule in POLICIES[version])


def _removed(text: str, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each row; null texts count as empty.

    ``n_repeat_words`` counts words in windows of five words whose hash occurs at two or more places of the text. Windows
    are sorted with their places only where some window repeats.
    """
    shifted = lambda array, by: F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))
    joined = lambda a, b: F.filter(
        F.zip_with(a, b, lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y))), lambda x: x.isNotNull()
    )
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", BLANKS), lambda x: x != ""))
    rows = rows.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        _removed("t", BLANK_CHARS).cast("long").alias("word_chars"),
        (F.char_length("t") - _removed("t", SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length("t") - _removed("t", CAPITALS)).cast("long").alias("n_capitals"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # windows of 2, of 4 and of 5 words
    rows = rows.withColumn("two", joined("h", shifted("h", 1)))
    rows = rows.withColumn("four", joined("two", shifted("two", 2)))
    rows = rows.withColumn("five", joined("four", shifted("h", 4))).drop("two", "four", "h")
    placed = F.array_sort(F.transform("five", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    rows = rows.withColumn(
        "s", F.when(F.size(F.array_distinct("five")) < F.size("five"), placed)
    ).drop("five")
    twins = F.zip_with(
        "s", shifted("s", 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>"))
    )
    rows = rows.withColumn("p", F.array_sort(F.array_distinct(F.flatten(twins)))).drop("s")
    steps = F.zip_with("p", shifted("p", 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeated = F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    return rows.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long")).drop("p")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failures``, the bits of all rules that fail. Rows with null or repeated ids stay."""
    bits = [F.when(F.expr(test), F.lit(bit)).otherwise(0) for bit, test in RULES.values()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs).withColumn("failures", total)


def kept(version: str = LATEST) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(version))) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """(version, rule, failed, failed_alone, kept, kept_without) for each rule of each policy, from the ledger.

    ``failed_alone`` counts rows that fail no other rule of the policy. One aggregate over the ledger.
    """
    wanted = [(version, rule) for version, rules in POLICIES.items() for rule in rules]
    sums = []
    for k, (version, rule) in enumerate(wanted):
        bit, whole = RULES[rule][0], mask(version)
        hit = F.col("failures").bitwiseAND(F.lit(whole))
        sums += [
            F.count_if(hit.bitwiseAND(F.lit(bit)) != 0).alias(f"failed_{k}"),
            F.count_if(hit == bit).alias(f"failed_alone_{k}"),
            F.count_if(hit == 0).alias(f"kept_{k}"),
            F.count_if(hit.bitwiseAND(F.lit(whole & ~bit)) == 0).alias(f"kept_without_{k}"),
        ]
    lines = F.array(*[
        F.struct(
            F.lit(version).alias("version"), F.lit(rule).alias("rule"),
            *[F.col(f"{name}_{k}").alias(name) for name in ("failed", "failed_alone", "kept", "kept_without")],
        )
        for k, (version, rule) in enumerate(wanted)
    ])
    return rows.agg(*sums).select(F.inline(lines))


def op4(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the failure bits, of every row.

    A null or empty text has no words and fails the base. An empty table gives no rows.
    """
    base = F.col("failures").bitwiseAND(F.lit(mask("1"))) != 0
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & kept()).alias("kept"), F.col("failures").cast("int").alias("failures"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS times FROM g),
v AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM c WHERE times > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
  FROM w LEFT JOIN v USING (r)),
f AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 50 * word_chars THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 32 ELSE 0 END AS failures
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures::INTEGER AS failures
FROM f
"""
