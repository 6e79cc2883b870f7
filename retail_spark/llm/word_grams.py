"""Words and word runs of many texts at once as 64-bit numbers, a bounded slice of bytes at a time.

A text is lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends and those into words at blanks and
tabs.  A word has two independent 64-bit numbers that also depend on a salt (its language), a run of words the
sums of its words' numbers times powers of a constant, so any part of a run has a number too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.common import mix

SLICE_BYTES = 1 << 20
#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 256
#: A set of numbers as a bitmap: so many bits an entry, and never more than a bounded number.
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
BLOCK_BITS = 1 << 15

_BREAK, _BLANK = 10, 32


def _folding() -> bytes:
    table = bytearray(range(256))
    for upper in range(65, 91):
        table[upper] = upper + 32
    for separator in (*b".,;:!?", *range(0x0A, 0x0E)):
        table[separator] = _BREAK
    table[9] = _BLANK
    return bytes(table)


FOLDING = _folding()
_EDGE = re.compile(rb"[ \n]")
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_STEP = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)
_POWER = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def salt_of(name: str) -> tuple[int, int]:
    digest = hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


def fold(texts: list[bytes]) -> bytes:
    """Texts as one, in lower case, with a line feed between pieces and blanks between words."""
    return b"\n".join(texts).translate(FOLDING)


@dataclass
class Words:
    """The words of a slice; those in ``own`` belong to it, others only show what comes before and after."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    own: slice

    def numbers(self, salt: tuple[int, int], which: int) -> np.ndarray:
        """One of the two numbers of every word."""
        size = self.end - self.start
        raw = np.frombuffer(self.data + bytes(16), dtype=np.uint8)
        chunks = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        step = np.uint64(_STEP[which])
        total = (size.astype(np.uint64) * np.uint64(_POWER[which])) ^ np.uint64(salt[which])
        at, live = 0, None
        short = size <= LONG_WORD
        while True:
            live = np.flatnonzero((size > at) & short) if at else np.flatnonzero(short)
            if not len(live):
                break
            take = np.minimum(size[live] - at, 8)
            mixed = (total[live] ^ (chunks[self.start[live] + at] & _MASK[take])) * step
            total[live] = mixed ^ (mixed >> np.uint64(32))
            at += 8
        for k in np.flatnonzero(~short):
            digest = hashlib.blake2b(self.data[self.start[k] : self.end[k]], digest_size=16).digest()
            total[k] ^= np.uint64(int.from_bytes(digest[8 * which : 8 * which + 8], "little"))
        return mix(total)

    def within(self, words: int) -> np.ndarray:
        """For every own word, whether ``words`` words from it on lie in one piece."""
        first = self.own.start + np.arange(self.own.stop - self.own.start)
        last = first + words - 1
        inside = last < len(self.piece)
        inside[inside] = self.piece[last[inside]] == self.piece[first[inside]]
        return inside

    def text(self, first: int, words: int) -> bytes:
        """A run of words with single blanks."""
        cut = self.data[self.start[first] : self.end[first + words - 1]]
        return b" ".join(cut.split(b" ")) if b"  " not in cut else b" ".join(w for w in cut.split(b" ") if w)


def runs(numbers: np.ndarray, own: slice, words: int, which: int, out: np.ndarray | None = None) -> np.ndarray:
    """The number of the run of ``words`` words from every own word on (rubbish where it leaves the slice).

    ``out`` may hold that of one word less.
    """
    n = own.stop - own.start
    if out is None:
        out, done = np.zeros(n, np.uint64), 0
    else:
        out, done = out.copy(), words - 1
    for k in range(done, words):
        part = numbers[own.start + k : own.stop + k]
        out[: len(part)] += part * np.uint64(pow(_POWER[which], k, 1 << 64))
    return out


def slices(data: bytes, before: int, after: int) -> Iterator[Words]:
    """Folded bytes in slices that end after a word, each with up to ``before`` (0 or 1) and ``after`` words around it."""
    at, left = 0, 0
    following = re.compile(rb"(?: *[^ \n]+){0,%d}" % after)
    while at < len(data):
        edge = _EDGE.search(data, at + SLICE_BYTES) if at + SLICE_BYTES < len(data) else None
        cut = edge.start() if edge else len(data)
        stop = following.match(data, cut).end() if edge else cut
        part = data[left:stop]
        raw = np.frombuffer(part, dtype=np.uint8)
        gap = raw == _BREAK
        inside = ~(gap | (raw == _BLANK))
        turn = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = turn[0::2], turn[1::2]
        piece = np.cumsum(gap, dtype=np.int32)[start]
        own = slice(int(np.searchsorted(start, at - left)), int(np.searchsorted(start, cut - left)))
        yield Words(part, start, end, piece, own)
        # The last word, if the next slice goes on in its piece, is what lies left of its first.
        last = left + int(start[own.stop - 1]) if before and own.stop else cut
        at, left = cut, last if cut < len(data) and b"\n" not in data[last : cut + 1] else cut


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """A set of 64-bit numbers as bits, least number of bits first; true for every member and for few others.

    It grows with the set up to ``MOST_BITS`` (32 MB): that bounds what the driver and each
    worker hold.  Beyond, more others pass, which costs time and changes no result.
    """
    count = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * count).bit_length()))
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    blocks = rows.groupBy(F.shiftright(place, BLOCK_BITS.bit_length() - 1).alias("block")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit(BLOCK_BITS - 1))).alias("bits")
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.collect():  # at most bits / BLOCK_BITS rows
        at = row["block"] * BLOCK_BITS // 8
        out[at : at + BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def among(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each number may be in the set of a bitmap."""
    place = numbers & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def grouped(number: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal numbers together: the order, where each group begins in it, and whether ``second`` agrees.

    Rows with equal ``number`` and different ``second`` stay apart.
    """
    order = np.lexsort((second, number))
    a, b = number[order], second[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return order, first, np.diff(first, append=len(order))
