"""Text columns: templates, answer normalization, token counts."""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attnstrata.functions import fixed_values as fixed

# Whitespace as Python's str methods see it, spelled for java.util.regex: the ASCII
# part, and all of it.
ASCII_SPACE = r"[\t-\r\x1c-\x20]"
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# ASCII plus the precomposed Latin letters: NFKC leaves any such text alone, and its
# only whitespace is ASCII.
NFKC_STABLE = r"^[\x00-\x7f\xc0-\xff]*\z"

_ASCII_SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
# Whitespace runs other than one plain space.
_ODD_RUN = rf" {ASCII_SPACE}+|[\t-\r\x1c-\x1f]{ASCII_SPACE}*"


def _is_stable(text: Column) -> Column:
    return F.rlike(text, F.lit(NFKC_STABLE))


def fill_template(form: Column, subject: Column, obj: Column | None = None) -> Column:
    """Put subject (and object) into a question or statement form."""
    filled = F.replace(form, F.lit("{subject}"), subject)
    return filled if obj is None else F.replace(filled, F.lit("{object}"), obj)


def build_prompt(
    document: Column, question: Column, template: str = fixed.PROMPT_TEMPLATE
) -> Column:
    """The prompt for one event; text inside the document is never re-expanded."""
    before, rest = template.split("{document}")
    between, after = rest.split("{question}")
    return F.concat(
        F.lit(before), document, F.lit(between), question, F.lit(after)
    )


def trim_generation(text: Column, stops: tuple[str, ...] = fixed.STOP_STRINGS) -> Column:
    """Cut at the first hit of the first stop string (in list order) that occurs."""
    out = text
    for stop in reversed(stops):
        out = F.when(
            F.contains(text, F.lit(stop)), F.substring_index(text, stop, 1)
        ).otherwise(out)
    return out


def _normalize_stable(text: Column) -> Column:
    space, punct = F.lit(_ASCII_SPACE_CHARS), F.lit(string.punctuation)
    out = F.ltrim(F.ltrim(F.ltrim(F.lower(text), space), punct), space)
    without = out
    for article in reversed(fixed.LEADING_ARTICLES):
        rest = F.ltrim(F.substring(out, len(article) + 1, 2**31 - 1), space)
        without = F.when(F.startswith(out, F.lit(article)), rest).otherwise(without)
    out = F.regexp_replace(without, _ODD_RUN, " ")
    return F.rtrim(F.rtrim(F.rtrim(out, space), punct), space)


@F.pandas_udf(T.StringType())
def _normalize_any(text: pd.Series) -> pd.Series:
    """Rows that need Unicode folding; every other row arrives as null."""

    def one(value):
        if value is None:
            return None
        value = unicodedata.normalize("NFKC", value).lower()
        value = value.lstrip().lstrip(string.punctuation).lstrip()
        article = next((a for a in fixed.LEADING_ARTICLES if value.startswith(a)), "")
        value = " ".join(value[len(article):].split())
        return value.rstrip(string.punctuation).rstrip()

    return text.map(one)


def normalize_em(text: Column) -> Column:
    """Exact-match normalization of an answer.

    Text that NFKC cannot change stays in the JVM. The remaining rows go through
    one Arrow UDF, which receives nulls in place of all other rows, so the input
    is scanned once and only the odd rows are shipped.
    """
    stable = _is_stable(text)
    return F.when(stable, _normalize_stable(text)).otherwise(
        _normalize_any(F.when(~stable, text))
    )


def is_fail(generated: Column, gold: Column) -> Column:
    return normalize_em(generated) != normalize_em(gold)


def _split(text: Column) -> Column:
    """Pieces between whitespace; only text with other than Latin letters needs the
    slower full class."""
    return F.when(_is_stable(text), F.split(text, f"{ASCII_SPACE}+")).otherwise(
        F.split(text, f"{SPACE}+")
    )


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(_split(text), lambda w: w != "")


def count_word_tokens(text: Column) -> Column:
    pieces = _split(text)
    ends = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) + F.when(
        (F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1
    ).otherwise(0)
    return F.size(pieces) - ends


def content_tokens(text: Column) -> Column:
    """Distinct lower-cased words longer than three characters."""
    return F.array_distinct(F.filter(_split(F.lower(text)), lambda w: F.length(w) > 3))


def lexical_overlap(
    question: Column, candidate: Column, at_least: int = fixed.MIN_SHARED_TOKENS
) -> Column:
    shared = F.array_intersect(content_tokens(question), content_tokens(candidate))
    return F.size(shared) >= at_least
