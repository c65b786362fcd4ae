"""Texts in pieces, and hashes that travel between pieces and buckets as arrays.

Operators that look at every window of every text would shuffle a row a word. Here a *piece* (rows of about ``PIECE_BYTES`` of
text) sends each *bucket* (a range of hash values) one row with all its distinct hashes as an array, and the bucket answers with
one bit a hash. The number of buckets follows the bytes of text, so a bucket's arrays keep their size as the data grows.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from attnstrata.llm.common import map_batches, replaced, string_column, with_fields
from attnstrata.llm.wordhash import mix
from attnstrata.session import scratch_path

#: Bytes of text in a piece; one row at least.
PIECE_BYTES = 8 << 20
#: Bytes of text for each bucket of hashes, and for each file group of the table of pieces.
BUCKET_BYTES, GROUP_BYTES = 8 << 20, 64 << 20
_SALT = np.uint64(0x6A09E667F3BCC909)


def bucket_count(docs: DataFrame, bytes_each: int = BUCKET_BYTES) -> int:
    """Buckets for a table's texts: one for so many bytes, one for each shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bytes_each))


def _piece_rows(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = 0, limit
        for batch in batches:
            names = np.empty(batch.num_rows, dtype=np.int64)
            for k, size in enumerate(pc.binary_length(string_column(batch, "text")).fill_null(0).to_pylist()):
                if held + size > limit and held:
                    piece, held = int.from_bytes(os.urandom(8)) >> 1, 0
                held += size + 1
                names[k] = piece
            yield replaced(batch, piece=pa.array(names))

    return run


def in_pieces(docs: DataFrame, buckets: int, limit: int = PIECE_BYTES) -> DataFrame:
    """``docs`` with a column ``piece``, written as a table that is bucketed by it.

    Names of pieces are random, so they are frozen by writing. Later passes group by piece without a shuffle of texts.
    The table stays in the session's catalogue, under a name of its own, as long as its files stay in the shared folder.
    """
    path = scratch_path(docs.sparkSession, "pieces")
    name = path.rpartition("/")[2].replace("-", "_")
    rows = map_batches(docs, _piece_rows(limit), with_fields(docs, StructField("piece", LongType())))
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(buckets * BUCKET_BYTES / GROUP_BYTES))
    rows.write.bucketBy(groups, "piece").option("path", path).option("compression", "zstd").saveAsTable(name)
    return docs.sparkSession.table(name)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, from bits that do not depend on the hash's own order."""
    return ((mix(hashes ^ _SALT) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of an ascending array."""
    if not len(bucket):
        return
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    yield from zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True)


def arrays(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a binary column in a row, and where each begins (one place more than rows)."""
    found = [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]
    sizes = np.array([0, *map(len, found)], dtype=np.int64)
    return (np.concatenate(found) if found else np.zeros(0, kind)), np.cumsum(sizes)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def least_of_runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, the least value of each, and each row's place among them."""
    distinct, place = np.unique(keys, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max, dtype=np.int64)
    np.minimum.at(least, place, values)
    return distinct, least, place


def narrow(values: np.ndarray) -> tuple[int, int, bytes]:
    """Whole numbers as (least, bytes each, offsets from the least), as narrow as they fit."""
    base = int(values.min())
    offsets = values.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)
    size = next(s for s in (1, 2, 4, 8) if s == 8 or int(offsets.max()) < 1 << 8 * s)
    return base, size, offsets.astype(f"u{size}").tobytes()


def widened(base: int, size: int, data: bytes) -> np.ndarray:
    return (np.frombuffer(data, dtype=f"u{size}").astype(np.uint64) + np.uint64(base & (1 << 64) - 1)).astype(np.int64)


#: Bits of a bitmap that one task makes.
_CHUNK_BITS = 16


def _bits_of(bits_: int):
    def run(rows: pa.Table) -> pa.Table:
        at = rows["hash"].to_numpy().view(np.uint64) >> np.uint64(64 - bits_) & np.uint64((1 << _CHUNK_BITS) - 1)
        marks = np.zeros(1 << _CHUNK_BITS, dtype=bool)
        marks[at.astype(np.int64)] = True
        return pa.table({"chunk": rows["chunk"][:1], "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()])})

    return run


def bitmap_of(hashes: DataFrame, bits_: int) -> np.ndarray:
    """A bitmap of the top bits of some hashes (column ``hash``), made chunk by chunk in tasks; its size is fixed, whatever their number."""
    out = np.zeros(1 << bits_ - 3, dtype=np.uint8)
    chunk = F.shiftrightunsigned("hash", 64 - bits_ + _CHUNK_BITS)
    found = hashes.select(chunk.alias("chunk"), "hash").groupBy("chunk").applyInArrow(_bits_of(bits_), "chunk long, bits binary").toArrow()
    for k, data in zip(found["chunk"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[k << _CHUNK_BITS - 3 :][: len(data)] = np.frombuffer(data, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether the bitmap has each hash; it may also have others of the same top bits."""
    at = (hashed >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
