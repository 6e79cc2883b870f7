"""Cleaners for messy text columns, as native column expressions.

None of them raises on bad input: text that cannot be read becomes NULL.  The
parsers work by rewriting text into a shape that ``try_cast`` reads, because a
failed ``try_cast`` costs nothing while a failed formatter throws per row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from retail_spark.functions.expressions import round_half_even
from retail_spark.schemas import MISSING_TOKENS

# Every character that counts as white space when text is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A private-use character, to mark places in text while it is rewritten.
MARK = "\ue000"
# Spellings of flags, ratings, statuses and payment methods.
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")
RATING_WORDS = {"one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0}
STATUS_SYNONYMS = {"complete": "completed", "canceled": "cancelled"}
PAYMENT_SYNONYMS = {"applepay": "apple_pay", "credit card": "credit_card"}
#: The shortest and longest name that may do without ``;``.
BARE_NAMES = range(2, 7)
#: Numbers 128 to 159 mean what they mean in Windows-1252, where that has a letter.
WINDOWS_1252 = {str(n): bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

# Patterns allow white space around the value.  Expressions below refer to their
# input once per branch wherever they can: a repeated one is computed repeatedly.
BLANK = f"[{WHITESPACE}]*"
DIGITS = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
NUMBER = f"^{BLANK}[+-]?{DIGITS}{BLANK}$"
NUMBER_OR_INFINITE = f"^{BLANK}[+-]?(?:{DIGITS}|(?i:inf(?:inity)?)){BLANK}$"
FRACTION = f"^{BLANK}[+-]?{DIGITS}{BLANK}/{BLANK}[+-]?{DIGITS}{BLANK}$"
ISO_DATE = r"\d{4}(?:-\d{1,2}){0,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?"
NUMERIC_DATE = f"^{BLANK}(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-](\\d{{4}}){BLANK}$"
ISO_ONLY = f"^{BLANK}{ISO_DATE}{BLANK}$"
# Year first with other separators than ISO has, or with none.
YEAR_FIRST = f"^{BLANK}(\\d{{4}})(?:[/.](\\d{{1,2}})[/.](\\d{{1,2}})|(\\d{{2}})(\\d{{2}})){BLANK}$"
# A year of two digits: 70 to 99 are of the last century.
SHORT_YEAR = f"^{BLANK}(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-](\\d{{2}}){BLANK}$"
LATE_YEAR = f"^{BLANK}(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-]([7-9]\\d){BLANK}$"
WEEKDAY = f"(?i)^{BLANK}(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\\.?,? +"
# A month by its first three letters, or those and the rest of its name.
MONTH = (
    r"([a-z]{3})(?:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|(?<=jun)e|(?<=jul)y|(?<=aug)ust"
    r"|(?<=sep)t(?:ember)?|(?<=oct)ober|(?<=nov)ember|(?<=dec)ember)?"
)
DAY_NUMBER = r"(\d{1,2})(?:st|nd|rd|th)?"
MONTH_FIRST_NAME = f"(?i)^{BLANK}{MONTH}\\.? +{DAY_NUMBER},? +(\\d{{4}}){BLANK}$"
DAY_FIRST_NAME = f"(?i)^{BLANK}{DAY_NUMBER}[ -]+{MONTH}\\.?,?[ -]+(\\d{{4}}){BLANK}$"
MONTH_AND_YEAR = f"(?i)^{BLANK}{MONTH}\\.?,?[ -]+(\\d{{4}}){BLANK}$"


def missing_to_null(c: Column) -> Column:
    """Text that stands for "no value" becomes NULL."""
    return F.when(~c.isin(*MISSING_TOKENS), c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lower_strip(c: Column) -> Column:
    return F.lower(strip(c))


def title_case(c: Column) -> Column:
    """Trim, then capitalise every run of letters and lower the rest.

    ``initcap`` starts a word only after a blank, so a marked blank is put
    behind each non-letter and taken out again afterwards.
    """
    marked = F.regexp_replace(strip(c), r"(\P{L})", "$1" + MARK + " ")
    return F.replace(F.initcap(marked), F.lit(MARK + " "), F.lit(""))


def replace_words(c: Column, synonyms: Mapping[str, str]) -> Column:
    """Trim and lower, then map known spellings; unknown ones pass through."""
    word = lower_strip(c)
    chain = reduce(
        lambda acc, pair: acc.when(word == pair[0], F.lit(pair[1])),
        synonyms.items(),
        F,
    )
    return chain.otherwise(word)


def clean_status(c: Column) -> Column:
    return replace_words(c, STATUS_SYNONYMS)


def clean_payment_method(c: Column) -> Column:
    return replace_words(c, PAYMENT_SYNONYMS)


def to_flag(c: Column, yes: Sequence[str] = TRUE_WORDS, no: Sequence[str] = FALSE_WORDS) -> Column:
    word = lower_strip(c)
    return F.when(word.isin(*yes), F.lit(True)).when(word.isin(*no), F.lit(False))


def to_verified(c: Column) -> Column:
    return to_flag(c, (*TRUE_WORDS, "y"), (*FALSE_WORDS, "n"))


def to_double(c: Column) -> Column:
    """Number text to double; the pattern keeps out forms only the JVM accepts."""
    return F.when(c.rlike(NUMBER_OR_INFINITE), strip(c).try_cast("double"))


def to_money(c: Column) -> Column:
    """Plain number text to money; currency text is not a number."""
    return F.when(c.rlike(NUMBER), strip(c).try_cast("decimal(18,2)"))


def clean_price(c: Column) -> Column:
    """Keep digits and dots only, so signs and currency text are dropped."""
    return F.regexp_replace(c, r"[^0-9.]", "").try_cast("decimal(18,2)")


def to_whole(c: Column, default: int | None = None) -> Column:
    """Number text to a whole number, cut towards zero."""
    number = to_double(c)
    if default is not None:
        number = F.coalesce(number, F.lit(float(default)))
    return number.try_cast("int")


def _rating(c: Column, finish: Callable[[Column], Column]) -> Column:
    """A rating by its spelling: number, fraction of five, or word."""

    def part(i: int) -> Column:
        return strip(F.split_part(c, F.lit("/"), F.lit(i))).try_cast("double")

    words = F.create_map(*[F.lit(x) for pair in RATING_WORDS.items() for x in pair])
    return (
        F.when(c.rlike(NUMBER_OR_INFINITE), finish(strip(c).try_cast("double")))
        .when(c.rlike(FRACTION), F.when(part(2) != 0, finish(part(1) / part(2) * 5)))
        .otherwise(F.element_at(words, lower_strip(c)))
    )


def rating_number(c: Column) -> Column:
    """The rating as written, not yet clamped."""
    return _rating(c, lambda number: number)


def to_rating(c: Column) -> Column:
    """A rating on the 1..5 scale; out of range is clamped, junk is NULL."""
    return _rating(c, lambda number: round_half_even(F.least(F.greatest(number, F.lit(1.0)), F.lit(5.0)), 2))


def parse_date(c: Column, day_first: bool = False) -> Column:
    """Mixed date text to a date.

    ISO text stands as it is, also as ``yyyy/m/d``, ``yyyy.m.d`` and ``yyyymmdd``; ``a/b/yyyy`` and ``a/b/yy`` are
    month first unless that is no date (or day first with ``day_first``); month names are read in
    either order, after a weekday or not, and without a day stand for the first of the month.
    One pattern decides how a text is read, and it is then read once.
    """
    orders = ("$3-$2-$1", "$3-$1-$2") if day_first else ("$3-$1-$2", "$3-$2-$1")

    def either_way(text: Column) -> Column:
        return F.coalesce(*[strip(F.regexp_replace(text, NUMERIC_DATE, order)).try_cast("date") for order in orders])

    full_year = F.regexp_replace(c, SHORT_YEAR, F.when(c.rlike(LATE_YEAR), F.lit("$1/$2/19$3")).otherwise(F.lit("$1/$2/20$3")))
    digits = (
        F.when(c.rlike(ISO_ONLY), strip(c).try_cast("date"))
        .when(c.rlike(NUMERIC_DATE), either_way(c))
        .when(c.rlike(YEAR_FIRST), F.regexp_replace(c, YEAR_FIRST, "$1-$2$4-$3$5").try_cast("date"))
        .when(c.rlike(SHORT_YEAR), either_way(full_year))
    )
    named = F.regexp_replace(c, WEEKDAY, "")
    for pattern, order in ((MONTH_FIRST_NAME, "$3-$1-$2"), (DAY_FIRST_NAME, "$3-$2-$1"), (MONTH_AND_YEAR, "$2-$1-1")):
        named = F.regexp_replace(named, pattern, order)
    return F.when(c.rlike("[A-Za-z]{3}"), F.try_to_timestamp(named, F.lit("yyyy-MMM-d")).cast("date")).otherwise(digits)


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# What may stand in a tag after its name: a quoted value may hold ``>``.
ATTRIBUTES = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
# Comments, declarations and blocks whose content is not text, then plain tags.
MARKUP = (
    r"(?is)<!--.*?-->"
    rf"|<script\b{ATTRIBUTES}>.*?</script\s*>"
    rf"|<style\b{ATTRIBUTES}>.*?</style\s*>"
    rf"|<template\b{ATTRIBUTES}>.*?</template\s*>"
    rf"|</?[a-z]{ATTRIBUTES}>"
    # A quote that is never closed does not hide the end of its tag.
    r"|</?[a-z][^>]*>"
    r"|<[!?][^>]*>"
)


def _as_map(values: dict[str, str]) -> Column:
    """A table as one literal, which the planner reads once."""
    return F.from_json(F.lit(json.dumps(values)), "map<string, string>")


def decode_entities(c: Column) -> Column:
    """Character references to characters, each reference read once.

    A name is looked up with its ``;``; without one, or if there is no such name, the longest beginning
    that may stand alone is taken.  Numbers do without ``;`` too; one that is no character becomes U+FFFD.
    What names nothing stays as it is.
    """
    names, old = _as_map(html5), _as_map(WINDOWS_1252)

    def decode(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^#([0-9]+;?|[xX][0-9a-fA-F]+;?)", 1)
        digits = F.rtrim(number, F.lit(";"))
        hexadecimal = F.when(F.length(digits) <= 9, F.conv(F.substring(digits, 2, 8), 16, 10).try_cast("int"))
        code = F.when(digits.rlike("^[0-9]"), digits.try_cast("int")).otherwise(hexadecimal)
        letter = F.when(
            code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF),
            F.coalesce(
                F.element_at(old, code.cast("string")), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
            ),
        )
        after = lambda n: F.substring(piece, n + F.lit(1), F.length(piece))
        name = F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]{0,31};", 0)
        whole = F.element_at(names, name)
        bare = [
            F.when(F.length(piece) >= n, F.concat(F.element_at(names, F.substring(piece, 1, n)), after(F.lit(n))))
            for n in reversed(BARE_NAMES)
        ]
        return F.when(number != "", F.concat(F.coalesce(letter, F.lit("\ufffd")), after(F.length(number) + 1))).otherwise(
            F.coalesce(F.concat(whole, after(F.length(name))), *bare, F.concat(F.lit("&"), piece))
        )

    pieces = F.split(c, "&")
    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decode)
    decoded = F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def strip_html(c: Column) -> Column:
    """Markup to its text content, trimmed; NULL stays NULL."""
    return strip(decode_entities(F.regexp_replace(c, MARKUP, "")))


def has_value(c: Column) -> Column:
    return c.isNotNull()


def has_text(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def clamp_min(c: Column, low: int = 0) -> Column:
    """Lift values below ``low``; NULL stays NULL."""
    return F.when(c < low, F.lit(low)).otherwise(c)


def flag_to_int(c: Column, null_as_zero: bool = True) -> Column:
    return (F.coalesce(c, F.lit(False)) if null_as_zero else c).cast("int")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def extract_statement(c: Column) -> Column:
    """The SQL in a chat reply: code fences and a leading ``SQL:`` are dropped."""
    bare = strip(F.regexp_replace(c, "(?i)```(?:sql)?", ""))
    return strip(F.regexp_replace(bare, r"(?i)^sql:", ""))


def clean_names(columns: Sequence[str]) -> list[str]:
    """Header text to column names."""
    return [name.strip().lower().replace(" ", "_") for name in columns]
