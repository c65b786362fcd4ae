"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Texts are taken block by block (about ``BLOCK_BYTES`` of a partition). In a block, each pre-token that the pattern
finds becomes a number; a text is the list of its numbers, which is the position of every pre-token. Two kinds of rows
leave a block: its distinct pre-tokens, and its texts as packed numbers. Pre-tokens of all blocks are shuffled by their
bytes and encoded once each, whatever the number of blocks that hold them; their ids go back
to the blocks, where the texts are put together by position. A frequent word gives one row a block, never one
a use, so no key grows with the use of a word.

Decoding turns ids into the bytes of the tokens by a lookup join with the table of all tokens, whose size is that of the
vocabulary and does not grow with the data.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from attnstrata.llm.common import give_back, map_batches, pieces, replaced, string_column, with_fields
from attnstrata.session import scratch_path

#: Bytes of text in a block; one text at least.
BLOCK_BYTES = 32 << 20
#: Words whose ids one task holds before it sends them back to their blocks.
HELD_WORDS = 200_000
RANKS = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """The ranks of a tokenizer file, lines of a base64 token and its id."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_ROUGH = re.compile(r"^\s|\s\Z|\s | \s")
_BLOCK = (
    "block long, code int, word string, doc_ids array<long>, sizes array<int>, "
    "codes binary, words binary, chunk_sizes binary"
)
_BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("code", pa.int32()), ("word", pa.string()), ("doc_ids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("words", pa.binary()), ("chunk_sizes", pa.binary()),
])
_LEVEL = 3
#: Numbers that are worked on at once where intermediate arrays are larger than the result.
_SLICE = 1 << 18


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed numbers of 0 or more: the width of each, then the bits below its first one, by width.

    Where numbers are ranks by frequency, this comes near the entropy of the sequence.
    """
    numbers = np.asarray(numbers, dtype=np.int32) + 1
    width = np.concatenate([
        (np.frexp(numbers[a : a + _SLICE])[1] - 1).astype(np.uint8) for a in range(0, max(1, len(numbers)), _SLICE)
    ])
    parts = [width.tobytes()]
    for w in range(1, int(width.max(initial=0)) + 1):
        low = (numbers[width == w] - (1 << w)).astype(">u4").view(np.uint8).reshape(-1, 4)
        step = _SLICE  # a multiple of 8, so slices of bits end at whole bytes
        parts.append(b"".join(
            np.packbits(np.unpackbits(low[a : a + step], axis=1)[:, 32 - w :]).tobytes() for a in range(0, len(low), step)
        ))
    head = np.array([len(width), *map(len, parts[1:])], dtype="<i8")
    packed = zstandard.ZstdCompressor(level=_LEVEL).compress(parts[0])
    return np.array([len(head), len(packed)], dtype="<i8").tobytes() + head.tobytes() + packed + b"".join(parts[1:])


def _unpack(data: bytes) -> np.ndarray:
    n_head, n_packed = np.frombuffer(data, dtype="<i8", count=2)
    head = np.frombuffer(data, dtype="<i8", count=n_head, offset=16)
    at = 16 + 8 * int(n_head)
    width = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + n_packed]), dtype=np.uint8)
    at += int(n_packed)
    out = np.ones(int(head[0]), dtype=np.int32)
    for w, size in enumerate(head[1:].tolist(), 1):
        where = np.flatnonzero(width == w)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=len(where) * w).reshape(-1, w)
        for a in range(0, len(where), _SLICE):
            wide = np.zeros((len(where[a : a + _SLICE]), 32), dtype=np.uint8)
            wide[:, 32 - w :] = bits[a : a + _SLICE]
            out[where[a : a + _SLICE]] = np.packbits(wide, axis=1).view(">u4").ravel().astype(np.int32) + (1 << w)
        at += size
    return out - 1


class _Codes(dict):
    """Chunk -> number; a new chunk gets the next number of the block, and is kept to be split."""

    def __init__(self, chunks: list[str], kinds: bytearray, kind: int):
        super().__init__()
        self.chunks, self.kinds, self.kind = chunks, kinds, kind

    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self.chunks)
        self.chunks.append(chunk)
        self.kinds.append(self.kind)
        return at


#: Kinds of chunks: at a text's begin, behind a space, and one pre-token as it is.
_FIRST, _SPACED, _WHOLE = 0, 1, 2


class _Block:
    """Numbers for the chunks of a block's texts, and the pre-tokens that each chunk is made of.

    A chunk is a run up to the next space, with the space before it. It splits alike wherever it stands
    if its text has no blank at an end and none beside a space, so it is split once a block. In other
    texts, each pre-token is a chunk.
    """

    def __init__(self, find):
        self.find = find
        self.chunks: list[str] = []
        self.kinds = bytearray()
        self.known = [_Codes(self.chunks, self.kinds, kind) for kind in (_FIRST, _SPACED, _WHOLE)]
        self.doc_ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        # if all blanks of any kind are single and between words, they are one less than the words; else a closer look
        words = text.split()
        even = len(text) - sum(map(len, words)) == len(words) - 1
        if not even and _ROUGH.search(text):
            codes = list(map(self.known[_WHOLE].__getitem__, self.find(text)))
        elif text:
            first, *rest = text.split(" ")
            codes = [self.known[_FIRST][first], *map(self.known[_SPACED].__getitem__, rest)]
        else:
            codes = []
        self.doc_ids.append(doc_id)
        self.codes.append(np.array(codes, dtype=np.int32))
        self.sizes.append(len(codes))
        self.bytes += len(text)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row with all texts, and a row for each distinct pre-token."""
        if not self.doc_ids:
            return
        name = int.from_bytes(os.urandom(8)) >> 1
        codes = np.concatenate(self.codes)
        self.codes.clear()
        for known in self.known:  # from here on numbers suffice
            known.clear()
        # frequent chunks get small numbers, which pack better; words are numbered in their order
        order = np.argsort(-np.bincount(codes, minlength=len(self.chunks)), kind="stable")
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        packed = _pack(place[codes])
        del codes, place
        known: dict[str, int] = {}
        content, sizes = array("i"), array("i")
        for at in order.tolist():
            chunk, kind = self.chunks[at], self.kinds[at]
            parts = (chunk,) if kind == _WHOLE else self.find(" " + chunk if kind == _SPACED else chunk)
            content.extend([known.setdefault(w, len(known)) for w in parts])
            sizes.append(len(parts))
        self.chunks.clear()
        words = sorted(known)
        rank = np.empty(len(words), dtype=np.int32)
        rank[[known[w] for w in words]] = np.arange(len(words))
        known.clear()
        yield pa.RecordBatch.from_pylist(
            [{
                "block": name, "doc_ids": self.doc_ids, "sizes": self.sizes, "codes": packed,
                "words": _pack(rank[np.array(content)]), "chunk_sizes": _pack(np.array(sizes)),
            }],
            schema=_BLOCK_ARROW,
        )
        for start in range(0, len(words), 50_000):
            part = words[start : start + 50_000]
            columns = [
                pa.array([name] * len(part), pa.int64()), pa.array(range(start, start + len(part)), pa.int32()), pa.array(part, pa.string()),
            ]
            nulls = [pa.nulls(len(part), f.type) for f in _BLOCK_ARROW][3:]
            yield pa.RecordBatch.from_arrays([*columns, *nulls], schema=_BLOCK_ARROW)


def _split(pattern: str, block_bytes: int):
    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        block = _Block(find)
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids = piece.column(piece.schema.get_field_index("doc_id")).to_pylist()
                texts = string_column(piece, "text").to_pylist()
                for doc_id, text in zip(ids, texts, strict=True):
                    block.add(doc_id, text or "")
                    if block.bytes >= block_bytes:
                        yield from block.rows()
                        block = _Block(find)
        yield from block.rows()

    return run


def _encode_words(ranks, pattern: str):
    """Rows sorted by word to packed (block, codes, sizes, ids): each distinct word of the partition is encoded once."""

    def packed(blocks, codes, coded) -> pa.RecordBatch:
        block, code = np.concatenate(blocks), np.concatenate(codes)
        order = np.lexsort((code, block))
        cuts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
        rows = []
        for part in np.split(order, cuts[1:]):
            ids = [coded[i] for i in part.tolist()]
            steps = np.diff(code[part].astype(np.int64), prepend=0)
            rows.append((int(block[part[0]]), _pack(steps), _pack(np.array([len(x) for x in ids])), b"".join(ids)))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["block", "word_codes", "word_sizes", "word_ids"])

    def run(batches):
        import tiktoken

        table = ranks.value
        whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        encode = whole._core_bpe.encode_single_piece
        kind = np.uint16 if max(table.values(), default=0) < 1 << 16 else np.uint32
        last, ids = None, b""
        blocks, codes, coded = [], [], []
        for batch in batches:
            for word in batch.column(1).to_pylist():
                if word != last:
                    last, ids = word, np.array(encode(word.encode()), dtype=kind).tobytes()
                coded.append(ids)
            blocks.append(batch.column(0).to_numpy())
            codes.append(batch.column(2).to_numpy())
            if len(coded) >= HELD_WORDS:
                yield packed(blocks, codes, coded)
                blocks, codes, coded = [], [], []
        if coded:
            yield packed(blocks, codes, coded)

    return run


def _gather(values: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` (``sizes`` long each) in the order of ``picks``, and the sizes of these runs."""
    starts = np.cumsum(sizes) - sizes
    count = sizes[picks]
    ends = np.cumsum(count)
    at = np.repeat(starts[picks] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
    return values[at], count


def _as_lists(doc_ids: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))
    return pa.table({"doc_id": doc_ids, "ids": lists})


def _join_back(ids_type, finish):
    """Texts of a block from its words' ids; ``finish`` gets the ids of all texts in a row and where each begins."""

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        out = texts_of(block, words)
        give_back()
        return out

    def texts_of(block: pa.Table, words: pa.Table) -> pa.Table:
        row = {n: block[n][0] for n in ("doc_ids", "sizes", "codes", "words", "chunk_sizes")}
        empty = np.zeros(0, dtype=np.int64)
        code = np.concatenate([empty, *(np.cumsum(_unpack(x)) for x in words["word_codes"].to_pylist())])
        lengths = np.concatenate([empty, *(_unpack(x) for x in words["word_sizes"].to_pylist())]) // np.dtype(ids_type).itemsize
        flat, lengths = _gather(np.frombuffer(b"".join(words["word_ids"].to_pylist()), dtype=ids_type), lengths, np.argsort(code))
        # ids of each chunk, then of all chunks in a row, then cut into texts
        content, chunk_words = _unpack(row["words"].as_py()), _unpack(row["chunk_sizes"].as_py())
        chunk_ids, word_sizes = _gather(flat, lengths, content)
        ends = np.r_[0, np.cumsum(word_sizes)]
        chunk_sizes = np.diff(ends[np.r_[0, np.cumsum(chunk_words)]])
        codes = _unpack(row["codes"].as_py())
        ends = np.r_[0, np.cumsum(chunk_sizes[codes])]
        cuts = ends[np.r_[0, np.cumsum(np.array(row["sizes"].as_py(), dtype=np.int64))]]
        ids = np.empty(int(ends[-1]), dtype=np.int32)
        for a in range(0, len(codes), _SLICE):
            b = min(a + _SLICE, len(codes))
            ids[ends[a] : ends[b]] = _gather(chunk_ids, chunk_sizes, codes[a:b])[0]
        del codes, ends
        doc_ids = pa.array(row["doc_ids"].as_py(), pa.int64())
        del row, flat, lengths, content, chunk_words, chunk_ids, word_sizes, chunk_sizes, code
        return finish(doc_ids, ids, cuts)

    return run


def _written(blocks: DataFrame) -> DataFrame:
    """The blocks as a table in the shared folder, bucketed by block: texts are put together where they lie.

    Its name in the catalogue is gone at once; the files are what later steps read.
    """
    spark = blocks.sparkSession
    path = scratch_path(spark, "blocks")
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int] | None = None,
    pattern: str | None = None,
    block_bytes: int = BLOCK_BYTES,
    finish=_as_lists,
    schema: str = "doc_id long, ids array<int>",
) -> DataFrame:
    """(doc_id, ids) of every row: the ids of all pre-tokens of the whole text, without special tokens.

    ``finish`` and ``schema`` are for a caller that wants other rows of the ids, made where they are put together.

    A null text counts as empty; an empty text has no ids. Rows with null or repeated doc_id are kept as they are. An empty
    table gives no rows.
    """
    ranks = read_ranks() if ranks is None else ranks
    pattern = _pattern() if pattern is None else pattern
    ids_type = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _written(map_batches(rows, _split(pattern, block_bytes), _BLOCK))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    words = blocks.where("word is not null").select("block", "word", "code").repartition("word").sortWithinPartitions("word")
    coded = map_batches(
        words, _encode_words(shared, pattern), "block long, word_codes binary, word_sizes binary, word_ids binary"
    ).withColumnRenamed("block", "word_block")
    texts = blocks.where("doc_ids is not null").drop("code", "word")
    return texts.groupBy("block").cogroup(coded.groupBy("word_block")).applyInArrow(
        _join_back(ids_type, finish), schema
    )


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[list[int] | None]:
    """The lists of a column, faster than by single values."""
    column = batch.column(batch.schema.get_field_index(name))
    flat, at = column.flatten(), 0
    flat = flat.to_numpy(zero_copy_only=False)
    for size in pc.list_value_length(column).to_pylist():
        if size is None:
            yield None
        else:
            yield flat[at : at + size].tolist()
            at += size


def join_bytes(tokens: dict[int, bytes], ids: list[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def _join_tokens(table, ids: str, out: str):
    def run(batches):
        tokens = table.value
        for batch in batches:
            found = [None if x is None else join_bytes(tokens, x) for x in _lists(batch, ids)]
            yield replaced(batch, **{out: pa.array(found, pa.large_binary()).cast(pa.binary())})

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The table with the bytes of its ids in ``out``: a join with the table of tokens, of vocabulary size.

    Null ids give null, no ids empty bytes; an id that the vocabulary lacks is an error.
    """
    ranks = read_ranks() if ranks is None else ranks
    table = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    return map_batches(encoded, _join_tokens(table, ids, out), with_fields(encoded, StructField(out, BinaryType())))


def _digests(table):
    """Number, digest and decoded digest of each text's ids."""

    def finish(doc_ids: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> pa.Table:
        tokens = table.value
        names = {i: str(i) for i in tokens}
        coded, decoded = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = ids[a:b].tolist()
            coded.append(hashlib.sha256(",".join(map(names.__getitem__, part)).encode()).hexdigest())
            decoded.append(hashlib.sha256(join_bytes(tokens, part)).hexdigest())
        return pa.table({
            "doc_id": doc_ids, "n_tokens": pa.array(np.diff(cuts), pa.int64()),
            "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()),
        })

    return finish


def op3(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; the decoded bytes come from the ids alone.

    Smaller blocks take less memory in a task and more disk: a word is sent once a block.
    """
    ranks = read_ranks()
    table = docs.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    return encode(
        docs, ranks, block_bytes=block_bytes, finish=_digests(table),
        schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
