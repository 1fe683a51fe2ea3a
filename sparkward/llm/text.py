"""Words of whole Arrow text columns as numpy arrays, in pieces of bounded size.

Every text is read to its end. Work per byte is done in segments of about a
megabyte; what is kept per document is a few numbers per word. Null texts have no
words. Words are runs of the bytes a `Charset` counts as letters, so they never
cross documents, and multi-byte characters stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20


@dataclass(frozen=True)
class Charset:
    """Which bytes belong to words, and what each byte counts as."""

    letters: np.ndarray
    folded: np.ndarray


def _charset(separators: list[int], fold: bool) -> Charset:
    letters = np.ones(256, bool)
    letters[separators] = False
    folded = np.arange(256, dtype=np.uint8)
    if fold:
        folded[65:91] += 32
        letters[65:91] = True
    return Charset(letters, folded)


_SPACES = [0x20, *range(0x09, 0x0E)]
#: Words between white space, as they are, and with A-Z lower-cased.
SPACED = _charset(_SPACES, False)
SPACED_FOLDED = _charset(_SPACES, True)
#: Letters, digits and everything beyond ASCII; A-Z lower-cased.
PLAIN = _charset([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], True)
#: Lines.
LINES = _charset([0x0A], False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def odd_numbers(n: int, salt: int = 1) -> np.ndarray:
    return mix(np.arange(salt, salt + n, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


@dataclass
class Words:
    """Of one piece: each word's document (from 0), byte range and hash; bounds[d] is document d's first word."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


@dataclass
class Piece:
    """Consecutive documents `first`.. of a batch: their bytes, and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array | pa.ChunkedArray, size: int = SEGMENT) -> Iterator[Piece]:
    """Documents in order, as many at a time as fit in `size` bytes, one at least."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        chunk = chunk.fill_null("").cast(pa.large_string())
        _, offsets, data = chunk.buffers()
        offsets = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield Piece(first + at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
        first += len(chunk)


def _cuts(data: np.ndarray, letters: np.ndarray) -> list[int]:
    """Segment ends, none inside a word."""
    ends, n = [], len(data)
    at = 0
    while n - at > SEGMENT + SEGMENT // 4:
        at += SEGMENT
        while at < n:
            gaps = np.flatnonzero(~letters[data[at : at + 4096]])
            if len(gaps):
                at += int(gaps[0])
                break
            at = min(n, at + 4096)
        ends.append(at)
    return [*ends, n] if not ends or ends[-1] < n else ends


def words(piece: Piece, charset: Charset) -> Words:
    """All words of a piece."""
    found, at = [], 0
    for to in _cuts(piece.data, charset.letters):
        if to > at:
            found.append(_segment(piece, charset, at, to))
        at = to
    if found:
        start, end, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        start = end = np.zeros(0, np.int64)
        hashes = np.zeros(0, np.uint64)
    bounds = np.searchsorted(start, piece.offsets)
    doc = np.repeat(np.arange(len(piece)), np.diff(bounds))
    return Words(doc, start, end, hashes, bounds)


def _segment(piece: Piece, charset: Charset, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = piece.data[at:to]
    inside = charset.letters[data]
    begins = piece.offsets[(piece.offsets > at) & (piece.offsets < to)] - at
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[begins] = False
    after[begins - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.multiply.accumulate(np.full(int(length.max()), _GOLDEN, np.uint64))
    terms = _VALUE[charset.folded[data[inside]]] * power[place]
    return start + at, end + at, mix(np.add.reduceat(terms, first) + length.astype(np.uint64) * _GOLDEN)


def windows(found: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of every k consecutive words of a document.

    A document of fewer words, but not none, is one window.
    """
    h, n = found.hash, len(found.hash)
    odd = odd_numbers(k)
    count = np.diff(found.bounds)
    full = np.zeros(0, np.int64)
    total = np.zeros(0, np.uint64)
    if n >= k:
        full = np.flatnonzero(found.doc[: n - k + 1] == found.doc[k - 1 :])
        total = np.zeros(len(full), np.uint64)
        for j in range(k):
            total += h[full + j] * odd[j]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = found.bounds[short]
        part = count[short].astype(np.uint64) * _GOLDEN
        for j in range(k - 1):
            has = count[short] > j
            part[has] += h[first[has] + j] * odd[j]
        full, total = np.concatenate([full, first]), np.concatenate([total, part])
        order = np.argsort(full, kind="stable")
        full, total = full[order], total[order]
    return mix(total), found.doc[full], full
