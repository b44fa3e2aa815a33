"""Word shingles of whole texts, hashed in numpy straight from Arrow buffers.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased; a shingle is
``width`` consecutive words, and a text of fewer words (but at least one) has its whole sequence as its only
shingle.  Words and shingles are 64-bit hashes: two given texts of thousands of shingles disagree with their
true sets with a chance below 1e-11.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5
BLOCK = 1 << 20  # bytes hashed at once, unless a text is longer


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
PLACE = mixed(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, and where each row begins (one more entry ends the last)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(
    data: np.ndarray, edges: np.ndarray, white: np.ndarray = WHITE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end and row of each word; ``edges`` cuts ``data`` into rows, ``white`` bytes cut words."""
    size = len(data)
    dark = ~white[data]
    begins, ends = dark.copy(), dark.copy()
    begins[1:] &= ~dark[:-1]
    ends[:-1] &= ~dark[1:]
    inner = edges[(edges > 0) & (edges < size)]
    begins[inner] = dark[inner]
    ends[inner - 1] = dark[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, size), out=sums[1:])
    words = (sums[stops] - sums[starts]) * powers(INVERSE, size + 1)[starts]
    return mixed(words), starts, stops, np.searchsorted(edges, starts, "right") - 1


def row_shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The shingle at each place of one row's word hashes, repeats included."""
    if not len(words):
        return words
    if len(words) < width:
        return mixed((words * PLACE[: len(words)]).sum(keepdims=True, dtype=np.uint64) + PLACE[63 - len(words)])
    places = len(words) - width + 1
    total = words[:places] * PLACE[0]
    for k in range(1, width):
        total += words[k : k + places] * PLACE[k]
    return mixed(total)


def blocks(offsets: np.ndarray):
    """Row ranges of about BLOCK bytes."""
    first = 0
    while first < len(offsets) - 1:
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield first, past
        first = past


def shingle_sets(texts: pa.Array, width: int = WIDTH):
    """The sorted distinct shingles of each row."""
    data, offsets = buffers(texts)
    for first, past in blocks(offsets):
        edges = offsets[first : past + 1] - offsets[first]
        words, _, _, row = word_hashes(data[offsets[first] : offsets[past]], edges)
        at = np.searchsorted(row, np.arange(past - first + 1))
        for k in range(past - first):
            yield np.unique(row_shingles(words[at[k] : at[k + 1]], width))
