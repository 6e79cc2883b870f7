"""Tables that the operators of this subpackage have to take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, n int"


def line(k: int, words: int = 80) -> str:
    """Words that no other line has, in sentences of ten."""
    return " ".join(f"w{k}x{i}" + ("." if i % 10 == 9 else "") for i in range(words))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in every column, empty and long texts, exact and near copies, repeated rows, columns that clash."""
    base = line(1)
    near = base.replace("w1x40", "other")
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (3, near, "en", "b"), (4, None, "en", "a"),
        (5, "", None, None), (6, " \n\t ", "en", "a"), (7, "One two.", "en", "a"), (8, line(2, 20_000), "de", "c"),
        (None, base, "en", "a"), (None, None, None, None), (9, "idiot! " + line(3), "en", "a"),
        (10, "Licensed under the Apache License, Version 2.0.\n" + line(4), "en", None),
        (11, "ab ab ab ab " * 30, "en", "a"), (12, "naïve ΣΑΣ İ ﬁ 中文 <|endoftext|> é ½", "fr", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 7, 1) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
