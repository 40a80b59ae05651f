"""Word hashes of whole Arrow batches in numpy: no Python loop over words, and no copy of the text but its bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
#: Texts are taken in slices of about this many bytes, so that memory is bounded whatever the size of a batch.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every bit of the input over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(chars: str) -> np.ndarray:
    """Table of 256 flags: True for the ASCII characters given."""
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


BLANK = byte_class(" \t\n\v\f\r")
#: ASCII letters and every byte of a longer UTF-8 character.
LETTER = byte_class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 128)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spans(texts: pa.Array, most: int = SLICE_BYTES):
    """(first, last) row numbers of runs of texts that have `most` bytes together at most, or are one text."""
    size = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))))
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(size, size[first] + most, side="right")) - 1, first + 1)
        yield first, last
        first = last


def slices(texts: pa.Array):
    """(first row, bytes of the texts with one line feed after each, start of every text and of the end), in slices."""
    for first, last in spans(texts):
        part = [x.encode() if x else b"" for x in texts[first:last].to_pylist()]
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        yield first, data, np.concatenate(([0], np.cumsum([len(x) + 1 for x in part])))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n-1); kept for slices of the usual size."""
    if n > SLICE_BYTES + 4096:
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base))))
    if int(base) not in _powers:
        _powers[int(base)] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(SLICE_BYTES + 4095, base))))
    return _powers[int(base)][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of the first word of every text and of the end). Words are runs of bytes that aren't blank, or runs of letters; ASCII capitals count as small letters."""
    low = _LOWER[data]
    inside = LETTER[data] if letters_only else ~BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    n = len(data)
    terms = low.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(_P, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    inverse = powers(_P_INV, n)
    hashed = mix((total[end] - total[begin]) * inverse[begin])
    return hashed, np.searchsorted(begin, starts)


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of n words within a text, number of the first run of every text and of the end); a text of 1 to n - 1 words has one run of all."""
    counts = np.diff(first)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(runs)))
    text = np.repeat(np.arange(len(counts)), runs)
    begin = first[text] + (np.arange(at[-1]) - at[text])
    length = np.minimum(counts[text], n)
    out = np.full(len(begin), 0x243F6A8885A308D3, np.uint64)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    for d in range(n):
        out = np.where(length > d, mix(out * _P + padded[begin + d]), out)
    return out, at
