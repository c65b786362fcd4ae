"""Removal of repeated passages by fixed-block anchors.

A document is cut into non-overlapping blocks of ``(window + 1) / 2`` words; the blocks of all documents are the index. Every
rolling window of a block's length of every document probes it. A passage of ``window`` words that stands in two documents holds at
least one whole block of each of them, wherever it begins, so the other document's rolling windows hit that block: no repeat is
missed. Around each hit, all windows of ``window`` words that hold the hit are extended to: their hashes meet, each with the least
id that it starts in, and windows that overlap make up maximal repeats.

1. Texts are written in pieces. A piece sends each bucket its distinct rolling hashes (32 bits inside the bucket) and which of
   them are its blocks. The bucket answers which are blocks of some document and stand in more than one piece; the piece itself sees
   those that stand in it twice. A wrong hit of 32 bits only costs work.
2. Windows around hits are sent with 64-bit hashes and the piece's least id of each; the bucket answers whether a smaller id
   is known elsewhere.
3. Back at the texts, windows with a smaller id here or elsewhere cover the words that go.

A passage that a third of all documents share is one hash a piece, not one a document; no pairs of documents are made. Two
different windows count as one if both their 64 bits and their bucket agree (with a million windows a bucket: odds of 1 in
10^7 that a bucket has such a pair).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnstrata.llm.common import string_column
from attnstrata.llm.parcels import (
    PIECE_BYTES,
    arrays,
    bits,
    bucket_count,
    bucket_of,
    by_bucket,
    flags,
    in_pieces,
    least_of_runs,
    narrow,
    widened,
)
from attnstrata.llm.wordhash import hash_spans, is_blank, raw_bytes, shingles, spans
from attnstrata.session import materialize, ship_package

WINDOW = 13
_ANSWER = "piece long, bucket int, hits boolean, answer binary"
_ANSWER_ARROW = pa.schema([("piece", pa.int64()), ("bucket", pa.int32()), ("hits", pa.bool_()), ("answer", pa.binary())])


class _Piece:
    """Word hashes of a piece's texts; documents without an id, or too short for a window, take no part."""

    def __init__(self, rows: pa.Table, window: int, buckets: int):
        batch = rows.select(["doc_id", "text"]).combine_chunks().to_batches()[0]
        self.texts, self.ids = string_column(batch, "text"), batch.column(0)
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets
        data, offsets = raw_bytes(self.texts)
        starts, ends = spans(~is_blank(data), offsets)
        self.hashes = hash_spans(data, starts, ends)
        self.first = np.searchsorted(starts, offsets)
        sizes = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        known = np.asarray(self.ids.is_valid())
        self.numbers = self.ids.fill_null(0).to_numpy().astype(np.int64)
        ends = np.where(known & (sizes >= window), self.first[1:], 0)
        #: words from each place to its text's end, itself included; 0 where the text takes no part
        self.left = np.maximum(ends[self.doc] - np.arange(len(self.doc)), 0)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rolling windows of a block's length: places, keys (bucket and 32 bits), and which are blocks."""
        at = np.flatnonzero(self.left >= self.block)
        hashed = shingles(self.hashes, self.block)[at] if len(at) else np.zeros(0, np.uint64)
        high, low = hashed >> np.uint64(32), hashed & np.uint64(0xFFFFFFFF)
        keys = (high * np.uint64(self.buckets) >> np.uint64(32)) << np.uint64(32) | low
        return at, keys, (at - self.first[self.doc[at]]) % self.block == 0

    def windows(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold a hit: places, distinct hashes in bucket order, their least ids and buckets, each window's hash."""
        at, keys, blocks = self.probes()
        distinct, place, times = np.unique(keys, return_inverse=True, return_counts=True)
        indexed = np.zeros(len(distinct), dtype=bool)
        indexed[place[blocks]] = True
        live = indexed & (times > 1)
        edges = _edges(distinct)
        for bucket, answer in _answers(answers, True):
            a, b = edges[bucket]
            live[a:b] |= flags(answer, b - a)
        hit = np.zeros(len(self.doc) + self.block, dtype=np.int64)
        hit[at[live[place]]] = 1
        near = np.r_[0, np.cumsum(hit)]
        begin = np.flatnonzero(self.left >= self.window)
        begin = begin[near[begin + self.window - self.block + 1] > near[begin]]
        hashed = shingles(self.hashes, self.window)[begin] if len(begin) else np.zeros(0, np.uint64)
        distinct, least, place = least_of_runs(hashed, self.numbers[self.doc[begin]])
        bucket = bucket_of(distinct, self.buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return begin, distinct[order], least[order], bucket[order], rank[place]

    def removed(self, answers: pa.Table) -> np.ndarray:
        """Whether each word goes."""
        begin, _, least, bucket, place = self.windows(answers)
        repeated = np.zeros(len(least), dtype=bool)
        edges = {k: (a, b) for k, a, b in by_bucket(bucket)}
        for key, answer in _answers(answers, False):
            a, b = edges[key]
            repeated[a:b] = flags(answer, b - a)
        goes = begin[repeated[place] | (least[place] < self.numbers[self.doc[begin]])]
        change = np.zeros(len(self.doc) + 1, dtype=np.int64)
        np.add.at(change, goes, 1)
        np.add.at(change, goes + self.window, -1)
        return np.cumsum(change[:-1]) > 0


def _edges(keys: np.ndarray) -> dict[int, tuple[int, int]]:
    return {k: (a, b) for k, a, b in by_bucket((keys >> np.uint64(32)).astype(np.int64))}


def _answers(rows: pa.Table, hits: bool):
    for bucket, kind, answer in zip(rows["bucket"].to_pylist(), rows["hits"].to_pylist(), rows["answer"].to_pylist(), strict=True):
        if kind == hits:
            yield bucket, answer


def _probe(window: int, buckets: int):
    """A piece's rows (bucket, piece, hashes, blocks)."""

    def run(rows: pa.Table) -> pa.Table:
        _, keys, blocks = _Piece(rows, window, buckets).probes()
        distinct, place = np.unique(keys, return_inverse=True)
        indexed = np.zeros(len(distinct), dtype=bool)
        indexed[place[blocks]] = True
        low = distinct.astype(np.uint32)
        piece = rows["piece"][0].as_py()
        out = [(k, piece, low[a:b].tobytes(), bits(indexed[a:b])) for k, (a, b) in _edges(distinct).items()]
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
            names=["bucket", "piece", "hashes", "blocks"],
        )

    return run


def _answered(rows: pa.Table, starts: np.ndarray, marked: np.ndarray, hits: bool) -> pa.Table:
    """One row a piece that has a marked hash."""
    out = [
        (piece, bucket, hits, bits(marked[a:b]))
        for piece, bucket, a, b in zip(rows["piece"].to_pylist(), rows["bucket"].to_pylist(), starts[:-1], starts[1:], strict=True)
        if marked[a:b].any()
    ]
    return pa.Table.from_pylist([dict(zip(_ANSWER_ARROW.names, x, strict=True)) for x in out], schema=_ANSWER_ARROW)


def _find_hits(rows: pa.Table) -> pa.Table:
    """Which hashes of each piece are a block of some document and stand in several pieces."""
    hashes, starts = arrays(rows["hashes"], np.uint32)
    blocks = np.concatenate([flags(x, n) for x, n in zip(rows["blocks"].to_pylist(), np.diff(starts), strict=True)])
    distinct, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
    indexed = np.zeros(len(distinct), dtype=bool)
    indexed[place[blocks]] = True
    return _answered(rows, starts, (indexed & (times > 1))[place], True)


def _extend(window: int, buckets: int):
    """A piece's rows (bucket, piece, hashes, base, width, ids): windows around hits, with the least id of each."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        _, hashed, least, bucket, _ = _Piece(rows, window, buckets).windows(answers)
        piece = rows["piece"][0].as_py()
        out = [(k, piece, hashed[a:b].tobytes(), *narrow(least[a:b])) for k, a, b in by_bucket(bucket)]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)],
            names=["bucket", "piece", "hashes", "base", "width", "ids"],
        )

    return run


def _find_smaller(rows: pa.Table) -> pa.Table:
    """Which windows of each piece start in a document with an id below the piece's own."""
    hashes, starts = arrays(rows["hashes"], np.uint64)
    ids = np.concatenate([widened(*x) for x in zip(*(rows[n].to_pylist() for n in ("base", "width", "ids")), strict=True)])
    _, least, place = least_of_runs(hashes, ids)
    return _answered(rows, starts, least[place] < ids, False)


def _runs(gone: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    return [{"begin": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def _finish(window: int, buckets: int):
    """(doc_id, n_words, n_removed, kept, repeats) of each row."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        piece = _Piece(rows, window, buckets)
        gone = piece.removed(answers)
        kept, found = [], []
        for text, a, b in zip(piece.texts.cast(pa.binary()).to_pylist(), piece.first[:-1].tolist(), piece.first[1:].tolist(), strict=True):
            words = (text or b"").split()  # splits at the same six bytes
            part = gone[a:b]
            kept.append(b" ".join(compress(words, (~part).tolist()) if part.any() else words))
            found.append(_runs(part))
        total = np.r_[0, np.cumsum(gone)]
        return pa.table({
            "doc_id": piece.ids,
            "n_words": pa.array(np.diff(piece.first), pa.int64()),
            "n_removed": pa.array(np.diff(total[piece.first]), pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "repeats": pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
        })

    return run


def repeats(docs: DataFrame, window: int = WINDOW, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeats) of every row.

    ``repeats`` are the maximal runs of words [begin, end) that go: those covered by windows of ``window`` words whose words also
    start in a document with a smaller id; ``kept`` are the other words, joined by one space. Windows are judged on the
    given texts, not on what is left of them.

    A null text has no words. Rows with a null id neither lose words nor count for others. Rows of one id are one document
    with several texts: they take nothing from each other. Texts with fewer words than a window stay whole. An empty table gives no
    rows; further columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = bucket_count(rows)
    placed = in_pieces(rows, buckets, piece_bytes)
    probes = placed.groupBy("piece").applyInArrow(_probe(window, buckets), "bucket int, piece long, hashes binary, blocks binary")
    hits = materialize(probes.groupBy("bucket").applyInArrow(_find_hits, _ANSWER), "hits")
    windows = placed.groupBy("piece").cogroup(hits.groupBy("piece")).applyInArrow(
        _extend(window, buckets), "bucket int, piece long, hashes binary, base long, width int, ids binary"
    )
    smaller = materialize(windows.groupBy("bucket").applyInArrow(_find_smaller, _ANSWER), "smaller")
    answers = hits.unionByName(smaller)
    return placed.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(
        _finish(window, buckets),
        "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<begin: int, end: int>>",
    )


def op11(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, odd rows as in ``repeats``."""
    return repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT row_id, doc_id, place, array_to_string(words[place:place + 12], ' ') AS passage
    FROM (SELECT row_id, doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM texts WHERE doc_id IS NOT NULL)
), earliest AS (
    SELECT passage, min(doc_id) AS least FROM windows GROUP BY passage
), gone AS (
    SELECT DISTINCT row_id, place + unnest(range(0, 13)) AS place
    FROM (SELECT row_id, place FROM windows JOIN earliest USING (passage) WHERE doc_id > least)
), spread AS (
    SELECT row_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
), kept AS (
    SELECT row_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept
    FROM spread ANTI JOIN gone USING (row_id, place) GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (row_id)
"""
