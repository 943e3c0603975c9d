"""Splitting texts into words by character class, for whole batches at once, and finding the distinct words."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from factloom.llm.common import range_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    kinds = np.array(first, dtype="U1")
    out = np.full(0x110000, OTHER, np.uint8)
    out[kinds == "L"] = LETTER
    out[kinds == "N"] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def _contractions(codes: np.ndarray, kind: np.ndarray, new: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes at these places, those that begin 's 't 're 've 'm 'll 'd, and where these end."""
    n = len(codes)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER)]
    one = codes[at + 1]
    two = np.where((at + 2 < n), codes[np.minimum(at + 2, n - 1)], 0)
    two = np.where((at + 2 < n) & ~new[np.minimum(at + 2, n - 1)], two, 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    keep = short | long
    return at[keep], (at + np.where(long, 3, 2))[keep]


def split(codes: np.ndarray, starts: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that begin at these places.

    spaced: a space joins the word after it, and white space makes words too (the pattern of byte-level vocabularies);
    else white space is dropped and each digit is a word (the pattern of word-end vocabularies).
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[codes]
    text_start = np.zeros(n + 1, bool)
    text_start[starts] = True  # of an empty text at the end too
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run |= text_start[:n]
    new = run.copy()
    if spaced:
        ends = np.flatnonzero(np.append(run[1:], True)) + 1  # of runs
        ends = ends[kind[ends - 1] == SPACE]
        ends = ends[(ends < n)]
        ends = ends[~text_start[ends]]
        new[ends - 1] = True
        new[ends[codes[ends - 1] == 0x20]] = False
    else:
        new |= kind == NUMBER
    quote = np.flatnonzero((codes == 0x27) & run & new)
    if len(quote):
        quote = quote[(quote + 1 < n)]
        quote = quote[~text_start[quote + 1]]
        at, end = _contractions(codes, kind, run, quote)
        new[at + 1] = False
        end = end[end < n]
        new[end] = True
    begins = np.flatnonzero(new)
    stops = np.append(begins[1:], n)
    if not spaced:
        keep = kind[begins] != SPACE
        begins, stops = begins[keep], stops[keep]
    return begins, stops


def distinct(codes: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and each word's number among those. Exact: hashes that meet are told apart."""
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = range_hashes(codes, begins, stops)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    length = stops - begins
    same = length == length[first][which]
    if same.all():
        offset = np.repeat(begins[first][which] - begins, length)
        place = np.repeat(begins - (np.cumsum(length) - length), length) + np.arange(length.sum())
        if (codes[place] == codes[place + offset]).all():
            return first, which
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(codes[a:b].tobytes(), len(seen)) for a, b in zip(begins, stops, strict=True)])
    _, first = np.unique(which, return_index=True)
    return first, which
