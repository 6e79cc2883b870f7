"""Packing documents into sequences of at most 4096 tokens, in order, by dynamic programming.

The documents of an input partition stay in their order and form one run of tokens.
A window of the run becomes a sequence.  Windows may end at a document's end (free), at
a sentence's end (a small penalty) and, where a sentence is very long, at regular places inside
it (a larger one).  Among all ways to cut a run the one with the least padding plus
penalties is chosen: with ``best[j] + position[j]`` in a monotone queue over the places
that a window may start from, each place is decided in constant time on average; a
window whose length is a power of two needs no padding and is tried besides.

Nothing is shuffled: a partition is packed where it is read, in runs of about
``RUN_TOKENS`` tokens, so memory does not depend on the partition's size.  Only the last
window of a run can be far from full.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.common import safe_id, true_id
from retail_spark.llm.tokens import END_ID, TextTokenizer, tokenizer_path

SEQUENCE_TOKENS = 4096
RUN_TOKENS = 2_000_000
SENTENCE_PENALTY = 8
FORCED_PENALTY = 48
#: Between two places to cut there are at most so many tokens.
LONGEST_STEP = 256


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending from 0, and the penalty of each."""
    sentence = np.flatnonzero(ends_sentence[ids]) + 1
    places = np.unique(np.concatenate([[0], sentence, doc_ends]))
    gaps = np.diff(places)
    more = [np.arange(s + LONGEST_STEP, s + g, LONGEST_STEP) for s, g in zip(places[:-1][gaps > LONGEST_STEP], gaps[gaps > LONGEST_STEP])]
    powers = len(ids) - (1 << np.arange(SEQUENCE_TOKENS.bit_length()))
    forced = np.setdiff1d(np.concatenate([*more, powers[powers > 0]]).astype(np.int64), places)
    penalty = np.concatenate([np.full(len(places), SENTENCE_PENALTY), np.full(len(forced), FORCED_PENALTY)])
    places = np.concatenate([places, forced])
    order = np.argsort(places)
    places, penalty = places[order], penalty[order]
    penalty[np.searchsorted(places, doc_ends)] = 0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, longest: int = SEQUENCE_TOKENS) -> list[int]:
    """The places to cut at, the first and the last included, with the least padding plus penalties."""
    exact: dict[int, list[int]] = {}
    size = 1
    while size < longest:
        at = np.searchsorted(places, places - size)
        for i in np.flatnonzero((places >= size) & (places[at] == places - size)).tolist():
            exact.setdefault(i, []).append(int(at[i]))
        size *= 2
    where, cost = places.tolist(), penalty.tolist()
    best, came = [0] * len(where), [0] * len(where)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + place, index), ascending in both
    for i in range(1, len(where)):
        place = where[i]
        while where[queue[0][1]] < place - longest:
            queue.popleft()
        low, start = queue[0]
        low += longest - place
        for j in exact.get(i, ()):
            if best[j] < low:
                low, start = best[j], j
        best[i], came[i] = low + cost[i], start
        key = best[i] + place
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    cuts = [len(where) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return [where[i] for i in reversed(cuts)]


def _packed(doc_ids: list[int], parts: list[np.ndarray], tokenizer: TextTokenizer, first: int) -> pd.DataFrame:
    """The pieces of a run, with sequences numbered from ``first``."""
    ids = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    cuts = np.array(best_cuts(*cut_places(ids, ends, tokenizer.ends_sentence)))
    stops = np.union1d(cuts, ends)
    stops = stops[stops > 0]
    starts = np.concatenate([[0], stops[:-1]])
    doc = np.searchsorted(ends, starts, "right")
    window = np.searchsorted(cuts, starts, "right") - 1
    raw = memoryview(ids.astype("<u4").tobytes())
    return pd.DataFrame(
        {
            "doc_id": np.array(doc_ids, np.int64)[doc],
            "start": starts - (ends - sizes)[doc],
            "length": stops - starts,
            "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())],
            "doc_tokens": sizes[doc],
            "sequence_id": first + window,
            "offset": starts - cuts[window],
        }
    ).astype("int64")


def pack(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all rows of ``documents`` (doc_id, text): ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A text's ids are followed by id 2, which a NULL or empty text (one token) has alone.
    Each id lies in exactly one piece.  Repeated rows are packed as often as they occur; a NULL ``doc_id``
    stays NULL.  ``tokenizer`` is the vocabulary file's path on every executor.  Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TextTokenizer(path)
        end = np.array([END_ID], np.uint32)
        first = TaskContext.get().partitionId() << 36
        doc_ids: list[int] = []
        parts: list[np.ndarray] = []
        tokens = 0
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"]):
                parts.append(np.concatenate([encoder.encode(text), end]))
                doc_ids.append(doc_id)
                tokens += len(parts[-1])
                if tokens >= RUN_TOKENS:
                    pieces = _packed(doc_ids, parts, encoder, first)
                    first = int(pieces["sequence_id"].iloc[-1]) + 1
                    doc_ids, parts, tokens = [], [], 0
                    yield pieces
        if parts:
            yield _packed(doc_ids, parts, encoder, first)

    rows = documents.select(safe_id("doc_id"), F.col("text").cast("string").alias("text"))
    columns = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    packed = rows.mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in columns))
    return packed.select(true_id("doc_id"), *columns)
