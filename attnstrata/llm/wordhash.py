"""Hashes of words and of runs of words for whole batches of texts, with numpy.

A word hash is a polynomial over the word's bytes modulo 2^64, taken from prefix sums, so a batch
costs a few passes over its bytes and no loop over words. Hashes are the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Longest run of bytes that is hashed at once; longer texts are cut between words.
SLICE = 1 << 18
#: Bytes that separate words: space and the controls 9 to 13.
BLANKS = (0x20, *range(0x09, 0x0E))


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _splitmix
_BASE = 0x9E3779B97F4A7C55 | 1
_VALUES = _splitmix(np.arange(1, 257, dtype=np.uint64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = _splitmix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        size = max(size, SLICE)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [
            np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, b, dtype=np.uint64)])
            for b in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one offset more than texts)."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last places of the runs of true values; a text's begin ends a run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of byte values (already folded), long inputs slice by slice."""
    out = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        base = int(starts[done])
        stop = max(done + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        size = int(ends[stop - 1]) - base
        power, inverse = _power_tables(size)
        with np.errstate(over="ignore"):
            sums = np.empty(size + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(_VALUES[values[base : base + size]] * power[:size], out=sums[1:])
            at = starts[done:stop] - base
            out[done:stop] = (sums[ends[done:stop] - base] - sums[at]) * inverse[at]
        done = stop
    with np.errstate(over="ignore"):
        return _splitmix(out ^ (ends - starts).astype(np.uint64))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True


def is_blank(data: np.ndarray) -> np.ndarray:
    """Whether each byte separates words."""
    return _BLANK[data]


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _FOLD[data]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the blank-separated words, A-Z folded, and each text's first word."""
    data, offsets = raw_bytes(texts)
    starts, ends = spans(~_BLANK[data], offsets)
    return hash_spans(_FOLD[data], starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, whatever text they are in."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = hashes[:n] * _STEP[0]
        for k in range(1, width):
            total = total + hashes[k : k + n] * _STEP[k]
        return _splitmix(total)


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a sequence of few words as one value; its length counts."""
    with np.errstate(over="ignore"):
        salt = np.uint64(len(hashes)) * _STEP[63]
        return _splitmix(np.array([shingles(hashes, len(hashes))[0] ^ salt], dtype=np.uint64))[0]


def distinct_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending; its whole sequence if it has fewer words."""
    hashes, first = words(texts)
    rolled = shingles(hashes, width)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(np.array([whole(hashes[a:b])], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


class PlainWords:
    """Words of letters, digits and bytes beyond ASCII; a point or comma between two digits belongs to its number.

    ``hashes`` are of the folded words (A-Z, and capitals of Latin-1 in UTF-8); ``starts`` and ``ends`` are places in
    ``data``; ``first`` is each text's first word, one more than texts.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = raw_bytes(texts)
        data = self.data
        inside = _LETTER[data]
        digit = _DIGIT[data]
        if len(data) > 2:
            begins = np.zeros(len(data) + 1, dtype=bool)
            begins[self.offsets] = True
            joint = np.flatnonzero(digit[:-2] & digit[2:] & ((data[1:-1] == 46) | (data[1:-1] == 44))) + 1
            joint = joint[~begins[joint] & ~begins[joint + 1]]  # all three are of one text
            inside[joint] = True
        self.digit, self.inside = digit, inside
        self.starts, self.ends = spans(inside, self.offsets)
        folded = _FOLD[data]
        if len(data) > 1:
            lead = np.flatnonzero(data[:-1] == 0xC3) + 1
            second = data[lead]
            lead = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
            folded[lead] += 0x20
            self.latin_capitals = lead - 1
        else:
            self.latin_capitals = np.zeros(0, np.int64)
        self.hashes = hash_spans(folded, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)


def word_hashes(words) -> np.ndarray:
    """Hashes of single words as ``PlainWords`` gives them."""
    found = PlainWords(pa.array(list(words), pa.string()))
    return found.hashes


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A table of 2^bits flags of the top bits of some hashes; its size does not follow theirs."""
    flags = np.zeros(1 << bits, dtype=bool)
    flags[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
    return flags


def maybe_in(flags: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    return flags[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
