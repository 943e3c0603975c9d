"""Byte-pair encoding of whole batches in padded numpy matrices.

Distinct words are put in buckets by length. In each round every row merges its leftmost pair of minimum rank; pairs are
looked up in a hashed table, and rows without a further merge leave the matrix. A word beyond the widest bucket is a matrix of
one row, in which a round does at once the rounds that would merge the same pair one after another (see merge_wide).
"""

from __future__ import annotations

import base64
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

from factloom.llm import pretokens
from factloom.llm.common import HashedKeys, code_points, ragged

NO_RANK = np.iinfo(np.int32).max
#: Bytes of the widest matrix row.
WIDEST = 256
#: Distinct words whose ids a worker keeps.
KNOWN = 200_000
BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, WIDEST)


def located(path: str) -> str:
    """A vocabulary file: a path, or the name of one of the public tokenizers, looked up where the task runs."""
    if os.path.dirname(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


class Pairs:
    """(left, right) -> (rank, merged id)."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        keys = (left << 32 | right).astype(np.uint64)
        self.keys = HashedKeys(keys)
        self.rank = np.append(np.asarray(rank, np.int32)[self.keys.order], NO_RANK)
        self.merged = np.append(np.asarray(merged, np.int32)[self.keys.order], -1)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.keys.find((left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).astype(np.uint64))
        return self.rank[at], self.merged[at]


class Vocabulary:
    """pairs; first ids of bytes and of bytes that end a word; the bytes of each id (if it decodes)."""

    def __init__(self, pairs, inner, final, pieces=None, spaced=True):
        self.pairs, self.inner, self.final, self.spaced = pairs, np.asarray(inner, np.int32), np.asarray(final, np.int32), spaced
        self.known: dict[bytes, int] = {}
        self.known_ids, self.known_at, self.known_count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if pieces is not None:
            self.lengths = np.array([len(p) for p in pieces], np.int64)
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def rank_vocabulary(path: str) -> Vocabulary:
    """A file of base64 tokens with ranks: any two tokens whose bytes together are a token may merge, at that token's rank."""
    with open(located(path), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    found = [(ranks[token[:k]], ranks[token[k:]], rank, rank) for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    single = [ranks[bytes([b])] for b in range(256)]
    pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return Vocabulary(Pairs(*zip(*found, strict=True)), single, single, pieces)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


@lru_cache(maxsize=2)
def word_vocabulary(path: str) -> Vocabulary:
    """A file of merges with word ends."""
    with open(located(path), encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids, end = model["vocab"], model["end_of_word_suffix"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    letters = byte_letters()
    pairs = Pairs([ids[a] for a, _ in merges], [ids[b] for _, b in merges], range(len(merges)), [ids[a + b] for a, b in merges])
    return Vocabulary(pairs, [ids[c] for c in letters], [ids[c + end] for c in letters], spaced=False)


def merge_wide(ids: np.ndarray, pairs: Pairs) -> np.ndarray:
    """One wide row: in each round its pairs of minimum rank merge from the left, up to the first that makes a pair of lower rank.

    So many rounds of one merge each would have done the same: until then the leftmost of these pairs has the minimum rank.
    """
    rank, merged = pairs.find(ids[:-1], ids[1:])
    while len(rank) and (best := rank.min()) != NO_RANK:
        at = np.flatnonzero(rank == best)
        run = np.concatenate(([True], np.diff(at) > 1))  # of pairs that overlap every second one merges
        head = np.flatnonzero(run)[np.cumsum(run) - 1]
        at = at[(np.arange(len(at)) - head) % 2 == 0]
        made = merged[at]
        left = np.where(np.concatenate(([False], at[:-1] + 2 == at[1:])), np.concatenate((made[:1], made[:-1])), ids[np.maximum(at - 1, 0)])
        after = np.minimum(at + 2, len(ids) - 1)
        lower = ((at > 0) & (pairs.find(left, made)[0] < best)) | ((at + 2 < len(ids)) & (pairs.find(made, ids[after])[0] < best))
        if lower.any():
            last = int(lower.argmax()) + 1
            at, made = at[:last], made[:last]
        ids = ids.copy()
        ids[at] = made
        ids = np.delete(ids, at + 1)
        place = at - np.arange(len(at))
        gone = np.minimum(at + 1, len(rank) - 1)  # the pair that began with the second half, or the last one
        rank, merged = np.delete(rank, gone), np.delete(merged, gone)
        fresh = np.unique(np.concatenate((place - 1, place)))
        fresh = fresh[(fresh >= 0) & (fresh < len(ids) - 1)]
        rank[fresh], merged[fresh] = pairs.find(ids[fresh], ids[fresh + 1])
    return ids


def merge_rows(ids: np.ndarray, width: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids padded with -1 (width: ids in each); the merged rows and their widths, in the same order."""
    count, wide = ids.shape
    rows = np.arange(count)
    out, out_width = ids, width.copy()
    if wide < 2 or not count:
        return out, out_width
    rank, merged = pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
    work = ids.copy()
    rank, merged = rank.reshape(count, wide - 1), merged.reshape(count, wide - 1)
    while len(rows):
        best = rank.argmin(axis=1)
        each = np.arange(len(rows))
        more = rank[each, best] != NO_RANK
        if not more.all():
            done = ~more
            out[rows[done], : work.shape[1]] = work[done]
            out[rows[done], work.shape[1] :] = -1
            rows, work, rank, merged, best, width = rows[more], work[more], rank[more], merged[more], best[more], width[more]
            if not len(rows):
                break
            each = np.arange(len(rows))
        work[each, best] = merged[each, best]
        width = width - 1
        w = work.shape[1]
        column = np.arange(w - 1)
        source = column + (column > best[:, None])
        work = np.take_along_axis(work, source, 1)
        if w == 2:
            out[rows, :1] = work
            out[rows, 1:] = -1
            out_width[rows] = 1
            break
        source = column[:-1] + (column[:-1] >= best[:, None])
        rank, merged = np.take_along_axis(rank, source, 1), np.take_along_axis(merged, source, 1)
        for at in (best - 1, best):
            ok = np.flatnonzero((at >= 0) & (at < w - 2))
            i = at[ok]
            rank[ok, i], merged[ok, i] = pairs.find(work[ok, i], work[ok, i + 1])
        out_width[rows] = width
    return out, out_width


def encode_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all words in one array, and where each word's ids begin and how many they are."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(size) - size
    first = vocabulary.inner[flat]
    full = size > 0
    first[(start + size - 1)[full]] = vocabulary.final[flat[(start + size - 1)[full]]]
    found, begins, counts, used = [first], start.copy(), size.copy(), len(first)
    low = 1
    for wide in BUCKETS:
        rows = np.flatnonzero((size > low) & (size <= wide))
        low = wide
        for piece in np.array_split(rows, max(1, -(-len(rows) * wide // 400_000))) if len(rows) else []:
            column = np.arange(wide)
            inside = column < size[piece][:, None]
            ids = np.where(inside, first[np.minimum(start[piece][:, None] + column, len(first) - 1)], -1)
            ids, width = merge_rows(ids, size[piece], vocabulary.pairs)
            found.append(ids[column < width[:, None]])
            counts[piece], begins[piece] = width, used + np.cumsum(width) - width
            used += len(found[-1])
    for row in np.flatnonzero(size > WIDEST):
        ids = merge_wide(first[start[row] : start[row] + size[row]], vocabulary.pairs)
        found.append(ids)
        counts[row], begins[row] = len(ids), used
        used += len(ids)
    return np.concatenate(found), begins, counts


def remembered(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As encode_words, for distinct words; those of earlier batches are not merged again (up to KNOWN words are kept)."""
    known = vocabulary.known
    fresh = [w for w in words if w not in known]
    if len(known) + len(fresh) > KNOWN:
        if len(words) > KNOWN // 2:
            return encode_words(words, vocabulary)
        known.clear()
        vocabulary.known_ids, vocabulary.known_at, vocabulary.known_count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh = words
    if fresh:
        ids, at, count = encode_words(fresh, vocabulary)
        ids, at = ids[ragged(at, count)], np.cumsum(count) - count
        vocabulary.known_at = np.concatenate((vocabulary.known_at, at + len(vocabulary.known_ids)))
        vocabulary.known_ids = np.concatenate((vocabulary.known_ids, ids))
        vocabulary.known_count = np.concatenate((vocabulary.known_count, count))
        known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
    place = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return vocabulary.known_ids, vocabulary.known_at[place], vocabulary.known_count[place]


def encode(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and where each text's ids begin (with the end as last entry)."""
    codes, starts = code_points(texts)
    begins, stops = pretokens.split(codes, starts[:-1], vocabulary.spaced)
    first, which = pretokens.distinct(codes, begins, stops)
    joined = "".join(texts)
    words = [joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(begins[first].tolist(), stops[first].tolist(), strict=True)]
    ids, at, count = remembered(words, vocabulary)
    lengths = count[which]
    flat = ids[ragged(at[which], lengths)]
    total = np.concatenate(([0], np.cumsum(lengths)))
    return flat, total[np.searchsorted(begins, starts)]


def word_form(text: str) -> str:
    """The normal form before a word-end vocabulary: composed, lower case by single characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()
