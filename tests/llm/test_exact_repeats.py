"""Substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from attnstrata.llm import exact_repeats, parcels

SCHEMA = "doc_id long, text string, piece string, bucket int, hits boolean, repeats string"


def documents(spark, rows):
    """Documents with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "p", 3, True, "r") for i, t in rows], SCHEMA)


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept) by looking at every window of every text."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        if i is not None:
            for k in range(len(words) - window + 1):
                if least[tuple(words[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def found(spark, rows, window, piece_bytes):
    got = exact_repeats.repeats(documents(spark, rows), window, piece_bytes).collect()
    for r in got:
        runs = [(x["begin"], x["end"]) for x in r["repeats"]]
        assert sum(b - a for a, b in runs) == r["n_removed"]
        assert all(b - a >= window for a, b in runs) and all(x[1] < y[0] for x, y in zip(runs, runs[1:], strict=False))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr)


@pytest.mark.parametrize("window", [13, 4, 1])
@pytest.mark.parametrize("piece_bytes", [60, 2000, 1 << 20])
def test_repeats_match_brute_force(spark, window, piece_bytes):
    rng = random.Random(window)
    word = lambda: f"w{rng.randrange(400)}" if rng.random() < 0.8 else rng.choice(["É", "é", "the", "The"])
    blanks = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]
    join = lambda words: "".join(w + rng.choice(blanks) for w in words)
    passages = [[word() for _ in range(n)] for n in (window - 1, window, window + 1, 2 * window, 40)]
    rows = []
    for k in range(60):
        words = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((rng.randrange(10**9), join(words)))
    # nulls, empty, short and long texts, copies, a row that repeats, an id with several texts, passages that overlap
    rows += [(5, None), (6, ""), (7, " \n"), (8, "one"), (None, rows[0][1]), (None, None), (1, "x " * 5000), (2, "x " * 30), rows[3], rows[3]]
    rows += [(9, join(passages[4])), (9, join(passages[4] * 2)), (-4, join(passages[3] + passages[4][:20])), (2**62, join(passages[4][10:] + passages[3]))]
    assert found(spark, rows, window, piece_bytes) == brute(rows, window)


def test_many_copies_over_many_pieces(spark, monkeypatch):
    """One text a third of the rows; more buckets than hashes of a piece."""
    monkeypatch.setattr(parcels, "BUCKET_BYTES", 200)
    rng = random.Random(4)
    text = " ".join(f"a{rng.randrange(99)}" for _ in range(30))
    rows = [(k, text if k % 3 == 0 else f"{k} " + " ".join(f"b{rng.randrange(10**6)}" for _ in range(25))) for k in range(300)]
    assert found(spark, rows, 13, 500) == brute(rows, 13)


def test_query_digests_and_an_empty_table(spark):
    rows = [(2, "a b c d e f g h i j k l m n"), (1, "z a  b c d e f g h i j k l m")]
    got = sorted(map(tuple, exact_repeats.op11(documents(spark, rows)).collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [(1, 14, 0, sha("z a b c d e f g h i j k l m")), (2, 14, 13, sha("n"))]
    assert exact_repeats.op11(documents(spark, rows).limit(0)).collect() == []


def test_arrays_that_travel():
    rng = np.random.default_rng(0)
    for values in ([5], [-3, 2**62], [-(2**63), 2**63 - 1], rng.integers(0, 300, 50), rng.integers(-(2**40), 2**40, 50)):
        values = np.array(values, dtype=np.int64)
        assert (parcels.widened(*parcels.narrow(values)) == values).all()
    marks = rng.random(77) < 0.4
    assert (parcels.flags(parcels.bits(marks), 77) == marks).all()
    keys = rng.integers(0, 9, 40).astype(np.uint64)
    distinct, least, place = parcels.least_of_runs(keys, np.arange(40))
    assert (distinct[place] == keys).all() and all(least[k] == np.flatnonzero(keys == d)[0] for k, d in enumerate(distinct))
    got, starts = parcels.arrays(pa.chunked_array([pa.array([b"", b"\x01\x02"])]), np.uint8)
    assert got.tolist() == [1, 2] and starts.tolist() == [0, 0, 2]
