"""Personal data against the plain patterns of each kind, and what context and checksums decide."""

import hashlib
import random
import re
import time

import pytest
from odd_rows import no_documents, odd_documents  # noqa: F401
from pyspark.sql import functions as F

from retail_spark.llm.personal_data import PLAIN, find_personal_data, mod97, span_digest, spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and plain_luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [
        (kind, *m.span()) for kind, pattern in PATTERNS.items() for m in re.finditer(pattern, text or "") if holds(kind, m[0])
    ]


def base(text):
    return [s[:3] for s in spans(text) if s.kind in PLAIN]


def test_plain_kinds_match_the_patterns_on_random_texts():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "_", "-", " ", "+", "12", "4111111111111111", "255", "256", "007", "(0", ")", "ü", "\n", "1.2.3.4", "x@y.z", "%"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert base(text) == plain(text), text


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("pay to DE89 3704 0044 0532 0130 00 now", ["iban"]),
        ("pay to DE88 3704 0044 0532 0130 00 now", []),
        ("IBAN GB82WEST12345698765432.", ["iban"]),
        ("her SSN is 123-45-6789", ["ssn"]),
        ("part number 123-45-6789", []),
        ("call (030) 1234 567 today", ["local_phone"]),
        ("room 030 1234 567 today", []),
        ("card 4111 1111 1111 1111, 4111 1111 1111 1112", ["card"]),
        ("ünï@x.com and 1.2.3.4.5.6.7.8 and 1.2.3.999", ["ip", "ip"]),
        ("", []),
        (None, []),
    ],
)
def test_checks_and_context(text, kinds):
    assert [s.kind for s in spans(text)] == kinds


def test_words_nearby_move_the_score():
    near, far, other = (spans(t)[0].score for t in ("card 4111111111111111", "4111111111111111", "order 4111111111111111"))
    assert near > far > other


def test_check_digits():
    assert mod97("FR1420041010050500013M02606") and not mod97("FR1420041010050500013M02607") and not mod97("ZZ1420041010")


@pytest.mark.parametrize("unit", ["1", "a", "a@", "1.", "+1", "1-", "AB12 ", "(", "1 "])
def test_time_is_in_proportion(unit):
    started = time.perf_counter()
    text = unit * (2_000_000 // len(unit))
    spans(text)
    assert time.perf_counter() - started < 10


def test_rows(spark, odd_documents, no_documents):
    more = "Mail a.b@c.de or +49 (30) 1234567, 10.0.0.1; IBAN DE89370400440532013000"
    docs = odd_documents.union(odd_documents.limit(1).select(F.lit(77), F.lit(more), "lang", "source", "n_chars", "score", "node", "n"))
    found = find_personal_data(docs)
    assert found.columns == [*docs.columns, "personal_data"]
    assert found.count() == docs.count()
    rows = span_digest(found).collect()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    expected = sorted({
        (str(d), *[sum(s[0] == k for s in plain(t)) for k in PLAIN],
         hashlib.sha256(",".join(":".join(map(str, s)) for s in plain(t)).encode()).hexdigest())
        for d, t in texts
    })
    assert sorted({(str(r["doc_id"]), *[r[f"n_{k}"] for k in PLAIN], r["base_sha256"]) for r in rows}) == expected
    assert next(r["spans"] for r in rows if r["doc_id"] == 77).split(",")[-1].startswith("iban:")
    assert span_digest(find_personal_data(no_documents)).collect() == []
    clash = find_personal_data(docs.withColumn("personal_data", F.lit(1)).withColumn("kind", F.lit("x")))
    assert clash.select("kind", "personal_data.value").count() == docs.count()
