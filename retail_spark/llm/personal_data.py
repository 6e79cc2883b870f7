"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move the score.

Two groups of kinds.  The plain ones (``email``, ``ip``, ``card``, ``phone``) are leftmost, non-overlapping
matches of one pattern each, kept if a check holds (parts at most 255, Luhn, number of digits); a match that
fails is dropped and not tried again from within.  They always stay.  The others (``iban``, ``ssn``, ``local_phone``)
are proposed more freely and stay only if their score reaches ``KEPT``: an IBAN has to pass mod 97,
the others need a word near them that says what they are, and must not lie on a span found already.

Every pattern is applied so that its time is in proportion to the text, also for megabytes of digits
or of letters without an ``@``.  A text is looked at whole, in one call; positions are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of results; the first ones are the plain ones.
PLAIN = ("email", "ip", "card", "phone")
FOUND = ("iban", "ssn", "local_phone")
KEPT = 0.5
#: Code points before and after a span in which words count for its score.
NEAR = 40

# What a span of a kind is worth by itself, and what a word of its kind nearby adds.
WORTH = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.2, "local_phone": 0.1}
HINT = 0.4
#: What a word nearby takes off that says a number is something else.
DOUBT = 0.3
HINTS = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
DOUBTS = ("version", "isbn", "issn", "order", "invoice", "ticket", "serial", "example", "test")
#: IBAN lengths by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,27}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){1,3}(?![0-9])")
_WORDS_NEAR = {kind: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)") for kind, words in HINTS.items()}
_DOUBTS_NEAR = re.compile(r"(?<!\w)(?:" + "|".join(DOUBTS) + r")(?!\w)")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether a number's last digit is right by Luhn's rule."""
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without blanks has its country's length and the right check digits."""
    if IBAN_LENGTHS.get(iban[:2]) != len(iban):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds one ``@``, so each ``@`` is asked for what lies left and right of it."""
    free, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL_PART.match(text[free:at][::-1]).end()
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of a run of numbers with dots between them."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        at, parts = run.start(), run[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() >= 13:
            digits = _NOT_DIGIT.sub("", run[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", run[0])) <= 15:
            yield run.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The country gives the length; what the pattern took beyond it is left off."""
    for run in _IBAN.finditer(text):
        length, end, seen = IBAN_LENGTHS.get(run[0][:2], 0), run.start(), 0
        while end < run.end() and seen < length:
            seen += text[end] != " "
            end += 1
        after = text[end : end + 1]
        if seen == length and length and not (after.isascii() and after.isalnum()) and mod97(text[run.start() : end].replace(" ", "")):
            yield run.start(), end


_PROPOSALS = {
    "email": emails,
    "ip": addresses,
    "card": cards,
    "phone": phones,
    "iban": ibans,
    "ssn": lambda text: (m.span() for m in _SSN.finditer(text)),
    "local_phone": lambda text: (m.span() for m in _LOCAL_PHONE.finditer(text) if 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 12),
}


def score(text: str, kind: str, start: int, end: int) -> float:
    """What a confirmed span is worth, given the words around it."""
    around = text[max(0, start - NEAR) : start].lower() + "\n" + text[end : end + NEAR].lower()
    worth = WORTH[kind] + HINT * bool(_WORDS_NEAR[kind].search(around)) - DOUBT * bool(_DOUBTS_NEAR.search(around))
    return round(min(1.0, max(0.0, worth)), 6)


def spans(text: str | None) -> list[Span]:
    """All spans of a text by kind, then start; none for NULL."""
    found: list[Span] = []
    if not text or not ("@" in text or _DIGIT.search(text)):
        return found
    for kind in PLAIN:
        found += [Span(kind, *at, score(text, kind, *at)) for at in _PROPOSALS[kind](text)]
    for kind in FOUND:
        starts, ends = _covered(found)
        for start, end in _PROPOSALS[kind](text):
            at = bisect_right(ends, start)
            worth = score(text, kind, start, end)
            if worth >= KEPT and not (at < len(starts) and starts[at] < end):
                found.append(Span(kind, start, end, worth))
    return found


def _covered(found: list[Span]) -> tuple[list[int], list[int]]:
    """What spans cover, as starts and ends of stretches that do not overlap."""
    starts, ends = [], []
    for start, end in sorted((s.start, s.end) for s in found):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())])
SPANS = "array<struct<kind: string, start: long, end: long, value: string, score: double>>"


def _spans_of(texts: pa.Array) -> pa.Array:
    out = []
    for item in texts:
        text = item.as_py()
        out.append([s._asdict() | {"value": text[s.start : s.end]} for s in spans(text)])
    return pa.array(out, pa.list_(SPAN_TYPE))


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "personal_data") -> DataFrame:
    """``docs`` with a column ``out``: the spans of personal data of each text, by kind, then start.

    A span has ``kind, start, end`` (code points, end exclusive), ``value`` and ``score`` (0 to 1).  A NULL or
    empty text has none; repeated rows are each answered; an existing column ``out`` is replaced, all
    others pass through untouched, NULLs included.  An empty table gives no rows.
    """
    return docs.withColumn(out, F.arrow_udf(_spans_of, SPANS)(F.col(text).cast("string")))


def span_digest(docs: DataFrame, column: str = "personal_data") -> DataFrame:
    """``doc_id``, spans per plain kind, the digest of the plain spans and all spans as text."""
    place = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    plain = F.filter(column, lambda s: s.kind.isin(*PLAIN))
    count = lambda kind: F.size(F.filter(column, lambda s: s.kind == kind)).cast("long")
    return docs.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in PLAIN],
        F.sha2(F.array_join(F.transform(plain, place), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(column, place), ",").alias("spans"),
    )
