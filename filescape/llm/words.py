"""Words and shingles of whole texts as 64-bit hashes, for many texts at once.

A word is a run of bytes other than space and \\t..\\r; A-Z count as a-z. Hashes are
polynomial in the bytes with random coefficients and a mixing step, so two different words
or shingles share one with a probability of about 2**-64.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from filescape.llm.tables import bytes_of

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bytes hashed at once; no range of fewer bytes is split.
_BLOCK = 1 << 20


@cache
def _codes(fold: bool = True) -> np.ndarray:
    codes = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse, for the places of a block."""
    base, inverse = np.full(_BLOCK + 1, _ODD, np.uint64), np.full(_BLOCK + 1, pow(_ODD, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def mix(keys: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    keys = keys.astype(np.uint64, copy=True)
    keys ^= keys >> np.uint64(30)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(27)
    keys *= np.uint64(0x94D049BB133111EB)
    keys ^= keys >> np.uint64(31)
    return keys


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, words per text) of all words of all texts, in order."""
    data, bounds = bytes_of(texts)
    solid = np.ones(len(data) + 1, bool)
    solid[:-1] = (data != 32) & ((data < 9) | (data > 13))
    solid[-1] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge))
    ends = np.flatnonzero(before & (~solid | edge))
    counts = np.diff(np.searchsorted(starts, bounds))
    return data, starts, ends, counts


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash of data[start:end] for every pair; starts and ends both ascend.

    Without `fold` A-Z are letters of their own. Ranges are worked on in blocks, so a text
    of any size needs one small table of powers.
    """
    sums = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        begin = int(starts[low])
        high = int(np.searchsorted(ends, begin + _BLOCK, side="right"))
        if high <= low:
            sums[low] = _long_sum(data[begin : int(ends[low])], _codes(fold))
            low += 1
            continue
        block = data[begin : int(ends[high - 1])]
        line, inverses = _running_sums(block, _codes(fold))
        first = starts[low:high] - begin
        sums[low:high] = (line[ends[low:high] - begin] - line[first]) * inverses[first]
        low = high
    return mix(sums ^ mix((ends - starts).astype(np.uint64)))


def _running_sums(block: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums before every place of a block, what undoes the powers at every place)."""
    powers, inverses = _powers()
    line = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(codes[block] * powers[: len(block)], out=line[1:])
    return line, inverses


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` bytes, far fewer than a block; case counts."""
    count = max(len(data) - width + 1, 0)
    out = np.empty(count, np.uint64)
    for low in range(0, count, _BLOCK - width):
        high = min(low + _BLOCK - width, count)
        line, inverses = _running_sums(data[low : high + width - 1], _codes(False))
        out[low:high] = (line[width:] - line[:-width]) * inverses[: high - low]
    return mix(out)


def _long_sum(data: np.ndarray, codes: np.ndarray) -> np.uint64:
    """The sum behind the hash of one range longer than a block."""
    total, powers = 0, _powers()[0]
    for low in range(0, len(data), _BLOCK):
        block = data[low : low + _BLOCK]
        part = int((codes[block] * powers[: len(block)]).sum(dtype=np.uint64))
        total += part * pow(_ODD, low, 1 << 64)
    return np.uint64(total & _MASK)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words per text)."""
    data, starts, ends, counts = spans(texts)
    return range_hashes(data, starts, ends), counts


def shingle_hashes(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every run of `size` words, runs per text); repeats are kept.

    A text with fewer words gives the whole sequence as one, a text without words none.
    """
    words, counts = word_hashes(texts)
    found = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    width = np.minimum(counts, size)
    first = np.repeat(np.cumsum(counts) - counts, found) + (np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found))
    length = np.repeat(width, found)
    total = mix(length.astype(np.uint64))
    for step in range(size):
        inside = step < length
        at = np.minimum(first + step, max(len(words) - 1, 0))
        if len(words):
            total = np.where(inside, total * np.uint64(_ODD) + words[at], total)
    return mix(total), found


def distinct_in_rows(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every row, and how many each row has."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[fresh], np.bincount(row[fresh], minlength=len(counts))
