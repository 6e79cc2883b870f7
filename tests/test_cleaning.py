"""Column cleaners, one row per branch, and against plain Python on random text."""

import datetime
import html
import random
import re
from decimal import Decimal
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from retail_spark.functions import cleaning as clean
from retail_spark.functions import expressions as x

D = datetime.date


def apply(spark, values, cleaner):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", cleaner(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = {
    "parse_date": (
        clean.parse_date,
        {
            "2024-03-22": D(2024, 3, 22),
            " 2024-03-22\t": D(2024, 3, 22),
            "2024-03-22T10:11:12Z": D(2024, 3, 22),
            "2024-03-22 10:11": D(2024, 3, 22),
            "29/10/2024": D(2024, 10, 29),
            "07/01/2024": D(2024, 7, 1),
            "06-17-2021": D(2021, 6, 17),
            "17-06-2021": D(2021, 6, 17),
            "07-01-2021": D(2021, 7, 1),
            "17 May 2023": D(2023, 5, 17),
            "17 MAY 2023": D(2023, 5, 17),
            "Jul 26, 2024": D(2024, 7, 26),
            "January 18, 2024": D(2024, 1, 18),
            "September 28 2023": D(2023, 9, 28),
            "Sept 5, 2020": D(2020, 9, 5),
            "17 Mayo 2023": None,
            "Janember 1, 2024": None,
            "2024-02-30": None,
            "31/02/2024": None,
            "2024-03-22 garbage": None,
            "202403": None,
            "garbage": None,
            "": None,
            None: None,
        },
    ),
    "parse_date day first": (
        lambda c: clean.parse_date(c, day_first=True),
        {"07/01/2024": D(2024, 1, 7), "06-17-2021": D(2021, 6, 17), "2024-07-01": D(2024, 7, 1)},
    ),
    "price": (
        clean.clean_price,
        {
            "$202.12": Decimal("202.12"),
            "AED 58.37": Decimal("58.37"),
            "50.22 USD": Decimal("50.22"),
            "136": Decimal("136.00"),
            "-5": Decimal("5.00"),
            "1.2.3": None,
            "free": None,
            "": None,
            None: None,
        },
    ),
    "flag": (
        clean.to_flag,
        {"True": True, " yes ": True, "1": True, "FALSE": False, "no": False, "0": False, "y": None, "": None, None: None},
    ),
    "verified": (clean.to_verified, {"Y": True, "n": False, "Yes": True, "0": False, "?": None, None: None}),
    "rating": (
        clean.to_rating,
        {
            "4": 4.0,
            "4.0": 4.0,
            "4/5": 4.0,
            "2/3": 3.33,
            "four": 4.0,
            " Five ": 5.0,
            "5.3": 5.0,
            "0": 1.0,
            "-3": 1.0,
            "inf": 5.0,
            "1/0": None,
            "1/2/3": None,
            "/5": None,
            "4d": None,
            "0x1p3": None,
            "nan": None,
            "six": None,
            "": None,
            None: None,
        },
    ),
    "rating number": (clean.rating_number, {"5.3": 5.3, "0": 0.0, "three": 3.0, "9/5": 9.0, "junk": None}),
    "status": (
        clean.clean_status,
        {"COMPLETED": "completed", "complete": "completed", "Canceled ": "cancelled", "odd": "odd", None: None},
    ),
    "payment": (
        clean.clean_payment_method,
        {"ApplePay": "apple_pay", "Credit Card": "credit_card", "paypal": "paypal", "Cheque": "cheque", None: None},
    ),
    "title": (
        clean.title_case,
        {
            "USB-C Fast 20000mAh 5.5l RGB al-rashid o'neil 4k": "Usb-C Fast 20000Mah 5.5L Rgb Al-Rashid O'Neil 4K",
            "  KITCHEN  scale ": "Kitchen  Scale",
            "école ÉTÉ": "École Été",
            "a\tb": "A\tB",
            "": "",
            None: None,
        },
    ),
    "html": (
        clean.strip_html,
        {
            "<b>Mechanical Keyboard</b>": "Mechanical Keyboard",
            " <p class='x'>a&amp;b</p> ": "a&b",
            "a &amp;lt; b": "a &lt; b",
            "&#65;&#x42;&copy;": "AB©",
            "fish & chips; &bogus;": "fish & chips; &bogus;",
            "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
            "<a title='1 > 0' href=\"x>y\">link</a> end": "link end",
            "<b class=\"open>bold</b> rest": "bold rest",
            "<p title=it's>ok": "ok",
            "&notit; &copy2024 &ampamp; &amp;lt &eacute &Eacute;&NotEqualTilde;": "¬it; ©2024 &amp; &lt é É≂̸",
            "&#128; &#x80 &#233&#xe9; &#0; &#xD800; &#99999999999;": "€ € éé \ufffd \ufffd \ufffd",
            "<!-- no --><script>var t='</p>'</script>yes<br/>": "yes",
            "plain": "plain",
            None: None,
        },
    ),
    "statement": (
        clean.extract_statement,
        {
            "```sql\nSELECT 1\n```": "SELECT 1",
            "SQL: select 2": "select 2",
            "sql:```SELECT 3```": "SELECT 3",
            "select 4": "select 4",
            None: None,
        },
    ),
    "whole": (lambda c: clean.to_whole(c, default=0), {"3.7": 3, "-2.9": -2, "x": 0, None: 0}),
    "money": (
        clean.to_money,
        {"1.5": Decimal("1.50"), "1e2": Decimal("100.00"), "AED 3": None, "inf": None, " 7 ": Decimal("7.00")},
    ),
    "missing": (
        clean.missing_to_null,
        {"NA": None, "N/A": None, "": None, "nan": None, "none": "none", "Null": "Null", "x": "x", None: None},
    ),
    "has text": (clean.has_text, {"a": True, "  ": False, "\xa0": False, "": False, None: False}),
}


@pytest.mark.parametrize("name", CASES)
def test_branches(spark, name):
    cleaner, cases = CASES[name]
    assert apply(spark, list(cases), cleaner) == list(cases.values())


def _words(rng, alphabet, n):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def _python_number(text):
    try:
        number = float(text)
    except ValueError:
        return None
    return None if number != number or "_" in text else number


def test_title_case_is_pythons(spark):
    texts = _words(random.Random(1), "abzABZ019 '-._é", 500)
    assert apply(spark, texts, clean.title_case) == [t.strip().title() for t in texts]


def test_price_is_digits_and_dots(spark):
    texts = _words(random.Random(2), "0123.$ -AED,", 500)

    def price(t):
        number = _python_number(re.sub(r"[^0-9.]", "", t))
        return None if number is None else number

    got = apply(spark, texts, clean.clean_price)
    for text, value in zip(texts, got):
        expected = price(text)
        if expected is None:
            assert value is None, text
        else:
            assert float(value) == pytest.approx(expected, abs=0.0051), text


def test_double_is_pythons_float(spark):
    texts = _words(random.Random(3), "0123456789.eE+-xdf ", 2000) + ["inf", "-Infinity", "NaN", "1e5", " 2. ", ".5"]
    assert apply(spark, texts, clean.to_double) == [_python_number(t) for t in texts]


def test_cleaning_is_idempotent(spark):
    texts = _words(random.Random(4), "abC <>&;/ 12", 300)
    for cleaner in (clean.title_case, clean.clean_status, clean.lower_strip, clean.extract_statement):
        once = apply(spark, texts, cleaner)
        assert apply(spark, once, cleaner) == once


def test_shift_months_runs_over(spark):
    d = F.lit("2024-12-31").cast("date")
    row = spark.range(1).select(*[x.shift_months(d, -n).alias(f"m{n}") for n in (6, 1, 12)]).first()
    assert list(row) == [D(2024, 7, 1), D(2024, 12, 1), D(2023, 12, 31)]


def test_roundings(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,), (-0.125,)], "v double")
    assert [r[0] for r in df.select(x.round_half_away(F.col("v"))).collect()] == [0.13, 0.38, 2.5, -0.13]
    assert [r[0] for r in df.select(x.round_half_even(F.col("v"))).collect()] == [0.12, 0.38, 2.5, -0.12]


def test_bins_are_right_closed(spark):
    edges, labels = (-0.1, 0, 5, 10, 15, 100), ("none", "a", "b", "c", "d")
    values = [-1.0, -0.1, 0.0, 0.1, 5.0, 5.1, 10.0, 15.0, 15.5, 100.0, 100.1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(x.bin_right_closed(F.col("v"), edges, labels)).collect()]
    assert got == [None, None, "none", "a", "a", "b", "b", "c", "d", "d", None]


def test_nulls_of_division_and_concat(spark):
    row = spark.range(1).select(
        x.safe_divide(F.lit(1), F.lit(0)).alias("z"), x.full_name(F.lit("a"), F.lit(None).cast("string")).alias("n")
    ).first()
    assert row["z"] is None and row["n"] is None


def test_flags_to_ints(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in df.select(clean.flag_to_int(F.col("b"))).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(clean.flag_to_int(F.col("b"), null_as_zero=False)).collect()] == [1, 0, None]


def test_header_names():
    assert clean.clean_names([" Order ID", "Total", "unit price "]) == ["order_id", "total", "unit_price"]


def test_every_named_reference(spark):
    names = sorted(html5)
    df = spark.createDataFrame([(f"a&{n} b",) for n in names], "t string")
    got = [r[0] for r in df.select(clean.decode_entities(F.col("t"))).collect()]
    assert got == [html.unescape(f"a&{n} b") for n in names]
