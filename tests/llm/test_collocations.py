"""Phrase mining against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from attnstrata.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, words int, rank int, hash long"


def documents(spark, rows):
    """(doc_id, text, lang) with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "p", 5, 1, 2, 3) for r in rows], SCHEMA)


def count(rows):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for part in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", part)
            totals[lang or "und" if lang != "" else ""] += len(words)
            for n in range(1, 6):
                for k in range(len(words) - n + 1):
                    counts[lang if lang is not None else "und", tuple(words[k : k + n])] += 1
    return counts, totals


def brute(rows, least, first):
    counts, totals = count(rows)
    found = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    out = []
    for lang in {p[0] for p in found}:
        kept = []
        for (of, words), a in found.items():
            if of != lang:
                continue
            inside = lambda long: any(long[k : k + len(words)] == words for k in range(len(long) - len(words) + 1))  # noqa: B023, E731
            if any(x[0] == lang and len(x[1]) > len(words) and b >= a and inside(x[1]) for x, b in found.items()):
                continue
            cuts = []
            for k in range(1, len(words)):
                l, r = counts[lang, words[:k]], counts[lang, words[k:]]  # noqa: E741
                cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
            score, _, l, r = min(cuts)  # noqa: E741
            kept.append((-score, -a, " ".join(words).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:first], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def texts():
    rng = random.Random(2)
    phrases = ["New York City", "on the other hand", "a b c d e f", "x x", "the cat", "Straße é"]
    word = lambda: rng.choice(["the", "a", "cat", "dog", "é", "x", "É", "!", "co-op", "d'or"]) if rng.random() < 0.7 else f"w{rng.randrange(40)}"
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", ";", "\x0b"])
    rows = []
    for k in range(150):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else word() for _ in range(rng.randrange(25))]
        rows.append((k, "".join(p + gap() for p in parts), rng.choice(["en", "fr", None, "und", "", "en"])))
    rows += [(1, None, "en"), (None, "a b c d e f", None), (2, "", "fr"), (3, "y " * 3000, "de"), (4, " . \n", "en"), (5, "\x00 \x1c \xa0 z", "en")]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("sample_share, least, first", [(1, 6, 2000), (4, 10, 5), (10**6, 4, 2000)])
def test_matches_plain_counting(spark, sample_share, least, first):
    """Also where the sample holds nothing, so that all phrases come by expansion, a length at a time."""
    rows = texts()
    got = collocations.collocations(documents(spark, rows), least, first, sample_share).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, first)


def test_frequent_phrases_are_exact(spark):
    rows = texts()
    counts, totals = count(rows)
    got = collocations.frequent_phrases(documents(spark, rows), 7, 8).collect()
    want = {(lang, " ".join(p), len(p), n) for (lang, p), n in counts.items() if n >= 7}
    assert {tuple(r) for r in got if r["phrase"] is not None} == want
    assert {r["lang"]: r["n"] for r in got if r["phrase"] is None and r["n"]} == {k: n for k, n in totals.items() if n}


def test_an_empty_table(spark):
    assert collocations.collocations(documents(spark, texts()).limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    """a n of 10^13 and 10^15 words: the products pass 64 bits and are exact."""
    a, n, l, r = 10**13 + 7, 9 * 10**15 + 11, 10**14 + 3, 10**13 + 9  # noqa: E741
    known = [("en", "b c", 2, a), ("en", "b", 1, l), ("en", "c", 1, r), ("en", None, 0, n)]
    frame = spark.createDataFrame(known, "lang string, phrase string, words int, n long")
    original = collocations.frequent_phrases
    collocations.frequent_phrases = lambda *_: frame
    try:
        got = collocations.collocations(frame).collect()
    finally:
        collocations.frequent_phrases = original
    assert [tuple(x) for x in got] == [("en", 1, "b c", a, l, r, n, 1000 * a * n // (l * r))]


def test_counts_as_bytes():
    counts = np.array([1, 254, 255, 256, 70000, 3], dtype=np.uint32)
    data = collocations._small(counts)
    assert collocations._large(data, len(counts)).tolist() == counts.tolist()
