"""The hash that seeds draws, over whole arrays of short texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of a text that fits one block of SHA-1, beside its end mark and length.
ONE_BLOCK = 55
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
_ADDED = (0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6)


def _blocks(texts: np.ndarray) -> np.ndarray:
    """16 x texts: the words of each padded block."""
    n, length = texts.shape
    block = np.zeros((n, 64), np.uint8)
    block[:, :length] = texts
    block[:, length] = 0x80
    block[:, 56:] = np.frombuffer((8 * length).to_bytes(8, "big"), np.uint8)
    return block.view(">u4").T.astype(np.uint32, order="C")


def sha1_numbers(texts: np.ndarray) -> np.ndarray:
    """The first 64 bits of SHA-1 of each row of ``texts``, a matrix of bytes (all texts are of one length).

    Every step works on all texts, in place; ``hashlib`` makes an object for each. Texts of more than one block go there.
    """
    if texts.shape[1] > ONE_BLOCK:
        heads = b"".join([hashlib.sha1(text.tobytes()).digest()[:8] for text in texts])
        return np.frombuffer(heads, ">u8").astype(np.uint64)
    words, u = _blocks(texts), np.uint32
    a, b, c, d, e, x, y = np.empty((7, len(texts)), u)
    for state, value in zip((a, b, c, d, e), _START):
        state.fill(value)
    for i in range(80):
        word = words[i % 16]
        if i >= 16:
            np.bitwise_xor(word, words[(i - 3) % 16], out=x)
            np.bitwise_xor(x, words[(i - 8) % 16], out=x)
            np.bitwise_xor(x, words[(i - 14) % 16], out=x)
            np.left_shift(x, u(1), out=word)
            np.right_shift(x, u(31), out=x)
            np.bitwise_or(word, x, out=word)
        if i < 20:
            np.bitwise_xor(c, d, out=x)
            np.bitwise_and(x, b, out=x)
            np.bitwise_xor(x, d, out=x)
        elif 40 <= i < 60:
            np.bitwise_or(b, c, out=x)
            np.bitwise_and(x, d, out=x)
            np.bitwise_and(b, c, out=y)
            np.bitwise_or(x, y, out=x)
        else:
            np.bitwise_xor(b, c, out=x)
            np.bitwise_xor(x, d, out=x)
        np.add(e, x, out=e)
        np.add(e, word, out=e)
        np.add(e, u(_ADDED[i // 20]), out=e)
        np.left_shift(a, u(5), out=x)
        np.right_shift(a, u(27), out=y)
        np.bitwise_or(x, y, out=x)
        np.add(e, x, out=e)
        np.left_shift(b, u(30), out=x)
        np.right_shift(b, u(2), out=b)
        np.bitwise_or(b, x, out=b)
        a, b, c, d, e = e, a, b, c, d
    high, low = a + u(_START[0]), b + u(_START[1])
    return (high.astype(np.uint64) << np.uint64(32)) | low


def _digits(numbers: np.ndarray, width: int) -> np.ndarray:
    """Decimal digits, one row a number of ``width`` digits, as bytes."""
    return (numbers[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + ord("0")).astype(np.uint8)


def _by_width(numbers: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(digits, places of the numbers that have so many)."""
    widths = np.array([len(str(x)) for x in numbers.tolist()])
    return [(int(w), np.flatnonzero(widths == w)) for w in np.unique(widths)]


def pair_numbers(head: bytes, first: np.ndarray, second: np.ndarray, held: int = 32_768) -> np.ndarray:
    """second x first: ``sha1_numbers`` of the texts head, first, ``|``, second, for all pairs of two arrays of numbers that are
    not negative; about ``held`` texts at a time.
    """
    out = np.empty((len(second), len(first)), np.uint64)
    for wide, across in _by_width(first):
        left = _digits(first[across], wide)
        step = max(1, held // len(across))
        for high, down in _by_width(second):
            length = len(head) + wide + 1 + high
            for a in range(0, len(down), step):
                rows = down[a : a + step]
                texts = np.empty((len(rows), len(across), length), np.uint8)
                texts[:, :, : len(head)] = np.frombuffer(head, np.uint8)
                texts[:, :, len(head) : len(head) + wide] = left
                texts[:, :, len(head) + wide] = ord("|")
                texts[:, :, length - high :] = _digits(second[rows], high)[:, None, :]
                out[np.ix_(rows, across)] = sha1_numbers(texts.reshape(-1, length)).reshape(len(rows), len(across))
    return out
