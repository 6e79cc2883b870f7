"""A word that is known is not split into pieces again, and long ones are not kept."""

from types import SimpleNamespace

import numpy as np
import pytest
from tokenizers import Tokenizer

from retail_spark.llm import tokens


@pytest.fixture
def own():
    return tokens.TextTokenizer(tokens.tokenizer_path())


def test_known_words_are_not_split_again(monkeypatch, own):
    text = "It's the 2nd word, isn't it?\nÀ la fin: don't... " * 20
    ids = own.encode(text)
    split, pieces = [], tokens._PIECES

    def findall(part):
        split.append(part)
        return pieces.findall(part)

    monkeypatch.setattr(tokens, "_PIECES", SimpleNamespace(findall=findall))
    assert np.array_equal(own.encode(text + "new1"), [*ids, *own.encode("new1")])
    assert split == ["new1"]


def test_long_words_are_not_kept(own):
    exact = Tokenizer.from_file(tokens.tokenizer_path())
    for text in ["x," * 5000 + " and y", "y and " + "x," * 5000, "ab1" * 100 + "\t" + "ab1" * 100]:
        assert own.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    assert set(own.known) == {"and", "y"}
