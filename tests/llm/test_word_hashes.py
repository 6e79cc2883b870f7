"""Hashes of words do not depend on how a text is cut, and long texts take bounded memory."""

import re
import tracemalloc

import numpy as np
import pytest

from retail_spark.llm import shingles
from retail_spark.llm.common import mix
from retail_spark.llm.shingles import word_hashes


def plain(text):
    out = []
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        total = 0
        for at, byte in enumerate(word.lower()):
            total += int(mix(np.array([byte + 1], np.uint64))[0]) * pow(shingles._BASE, at, 1 << 64)
        out.append(int(mix(np.array([total % (1 << 64)], np.uint64))[0]))
    return out


@pytest.mark.parametrize("piece", [4, 7, 64])
def test_pieces(monkeypatch, piece):
    texts = ["", "  ", "one", "Äpfel und  Birnen\n\tx", "a" * 50 + " b " + "c" * 9, "x y z " * 20, "abcd", "abcd efgh", "日本 " * 9]
    expected = [plain(t) for t in texts]
    monkeypatch.setattr(shingles, "PIECE", piece)
    assert [word_hashes(t).tolist() for t in texts] == expected


@pytest.mark.parametrize("text", ["some words of a very long text " * 700_000, "x" * 20_000_000])
def test_memory(text):
    tracemalloc.start()
    try:
        word_hashes(text)
        assert tracemalloc.get_traced_memory()[1] < 8 * len(text)
    finally:
        tracemalloc.stop()
