"""Words and word shingles of whole batches of texts, and their MinHash signatures, in numpy.

Words are runs of anything but the ASCII white space U+0009..U+000D and U+0020; A-Z count as lower case. A text of fewer words
than a shingle is one shingle of all its words; one without words has none.
"""

from __future__ import annotations

import numpy as np

from factloom.llm.common import BASE, code_points, mixed, range_hashes


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where each text's words begin (with the end as last entry)."""
    codes, starts = code_points(texts)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    codes = codes + (((codes >= 65) & (codes <= 90)) * np.uint32(32))
    inner = (codes != 32) & ((codes < 9) | (codes > 13))
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    heads = starts[:-1][np.diff(starts) > 0]
    first[heads] = inner[heads]
    last = inner.copy()
    last[:-1] &= ~inner[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mixed(range_hashes(codes, begin, end)), np.searchsorted(begin, starts)


def shingle_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each shingle of so many words (repeats included), and where each text's begin."""
    words, at = word_hashes(texts)
    count = np.diff(at)
    shingles = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    out_at = np.concatenate(([0], np.cumsum(shingles)))
    begin = np.arange(out_at[-1]) + np.repeat(at[:-1] - out_at[:-1], shingles)
    end = np.minimum(begin + size, np.repeat(at[1:], shingles))
    return mixed(range_hashes(words, begin, end) + (end - begin).astype(np.uint64)), out_at


def distinct_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in rising order, and where each text's begin."""
    hashes, at = shingle_hashes(texts, size)
    document = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((hashes, document))
    hashes, document = hashes[order], document[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
    return hashes[new], np.searchsorted(document[new], np.arange(len(texts) + 1))


def permutations(number: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of so many universal hash functions (multiply, add, take the upper half)."""
    seeds = mixed(np.arange(1, 2 * number + 1, dtype=np.uint64) * np.uint64(BASE))
    return seeds[:number] | np.uint64(1), seeds[number:]


def signatures(hashes: np.ndarray, at: np.ndarray, number: int) -> np.ndarray:
    """The lower 16 bits of each text's least value under each hash function; all ones where there is no shingle."""
    out = np.full((len(at) - 1, number), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        begin = at[full]
        value = np.empty(len(hashes), np.uint64)
        for j, (a, b) in enumerate(zip(*permutations(number), strict=True)):
            np.multiply(hashes, a, out=value)
            np.add(value, b, out=value)
            out[full, j] = (np.minimum.reduceat(value, begin) >> np.uint64(32)).astype(np.uint16)
    return out
