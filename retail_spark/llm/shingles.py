"""Distinct word shingles of texts as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from retail_spark.llm.common import mix

SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = mix(np.arange(1, SHINGLE_WORDS + 2, dtype=np.uint64)) | np.uint64(1)


def _byte_codes() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    blank = np.zeros(256, dtype=bool)
    blank[[32, *range(9, 14)]] = True
    return mix(lower + np.uint64(1)), blank


_CODE, _BLANK = _byte_codes()
#: Texts are hashed in pieces of so many bytes, so that memory does not grow by many bytes for each byte of a text.
PIECE = 1 << 16


def _powers(base: int) -> np.ndarray:
    steps = np.full(2 * PIECE, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A text in pieces that end before a blank; only a word longer than a piece makes one longer."""
    at = 0
    while at < len(raw):
        cut = at + PIECE
        while cut < len(raw):
            blank = _BLANK[raw[cut : cut + PIECE]]
            cut += int(blank.argmax()) if blank.any() else len(blank)
            if blank.any():
                break
        yield raw[at:cut]
        at = cut


def _sum_of(word: np.ndarray) -> np.uint64:
    """The sum of a long word's codes times powers, chunk by chunk."""
    total, start = 0, 1
    for at in range(0, len(word), PIECE):
        part = _CODE[word[at : at + PIECE]]
        total += int((part * _UP[: len(part)]).sum()) * start
        start = start * pow(_BASE, PIECE, 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def _hashes(raw: np.ndarray) -> np.ndarray:
    """The hashes of the words of a piece."""
    inside = np.concatenate([~_BLANK[raw[at : at + PIECE]] for at in range(0, len(raw), PIECE)])
    turn = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = turn[0::2], turn[1::2]
    if len(raw) <= 2 * PIECE:
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_CODE[raw] * _UP[: len(raw)], out=total[1:])
        return mix((total[end] - total[start]) * _DOWN[start])
    return mix(np.array([_sum_of(raw[s:e]) for s, e in zip(start, end)], np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word of a text, with A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found = [_hashes(piece) for piece in _pieces(raw)]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted: ``size`` words each, or all words if there are fewer.

    A text without words has none.
    """
    word = word_hashes(text)
    if not len(word):
        return word
    width = min(size, len(word))
    total = np.full(len(word) - width + 1, width, np.uint64)
    for k in range(width):
        total += word[k : len(word) - width + 1 + k] * _PLACE[k]
    return np.unique(mix(total))


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingles, the same for equal sets."""
    both = np.bitwise_xor.reduce(shingles) if len(shingles) else np.uint64(0)
    spread = np.add.reduce(mix(shingles ^ np.uint64(_BASE))) if len(shingles) else np.uint64(0)
    digest = mix(np.array([both ^ mix(np.array([spread + np.uint64(len(shingles))]))[0]]))
    return int(digest.view(np.int64)[0])
