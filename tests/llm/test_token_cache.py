"""The cache of pieces bounds what a worker keeps, not what a text may hold."""

import numpy as np
from tokenizers import Tokenizer

from retail_spark.llm import tokens


def test_texts_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 20)
    path = tokens.tokenizer_path()
    exact, own = Tokenizer.from_file(path), tokens.TextTokenizer(path)
    texts = [" ".join(f"word{chr(97 + k)}x" for k in range(a, b)) for a, b in ((0, 5), (3, 15), (0, 26), (0, 26), (10, 24), (0, 2))]
    for text in [*texts, " ".join(f"a{k} b{k}" for k in range(400)), texts[2]]:
        assert np.array_equal(own.encode(text), exact.encode(text, add_special_tokens=False).ids)
        assert len(own.known) <= 20
