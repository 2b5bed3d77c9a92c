"""Scalar functions on tables of inputs and outcomes."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lumenyard.functions import dates, numbers, text, urls
from pyspark.sql import functions as F


def over(spark, values, use):
    """use() of each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", use(F.col("v")).alias("x")).orderBy("i").collect()]


NUMBERS = [
    ("53.74", 53.74),
    ("1,234.56", 1234.56),
    ("1.234,56", 1234.56),
    ("INR 1,199.00", 1199.0),
    ("1.2.3", None),
    ("1.22.333", None),
    ("in stock", None),
    ("", None),
    (None, None),
    ("1,234,567", 1234567.0),
    ("1.234", 1234.0),
    ("1.99", 1.99),
    ("-5", -5.0),
    ("1,2,3.4,5", None),
    (".", None),
    ("5.", 5.0),
]


def test_loose_numbers(spark):
    assert over(spark, [a for a, _ in NUMBERS], numbers.loose_number) == [b for _, b in NUMBERS]


def plain_number(s):
    """The rules of loose_number, in plain Python."""
    kept = "".join(c for c in s if c in "0123456789.,-")
    if not any(c.isdigit() for c in kept):
        return None
    sign, body = -1.0 if kept.startswith("-") else 1.0, kept.replace("-", "")
    kinds = {c for c in body if c in ".,"}
    if len(kinds) == 2:
        last = max(kinds, key=body.rfind)
        if body.count(last) != 1:
            return None
        body = body.replace("." if last == "," else ",", "").replace(last, ".")
    elif kinds:
        sep = kinds.pop()
        head, *rest = body.split(sep)
        if len(rest) == 1 and len(rest[0]) != 3:
            body = f"{head}.{rest[0]}"
        elif len(rest) == 1 or all(len(r) == 3 for r in rest):
            body = head + "".join(rest)
        else:
            return None
    return sign * float(body)


def test_loose_numbers_against_plain_python(spark):
    found = []

    @settings(max_examples=300, database=None)
    @given(st.text(alphabet="0123456789.,-$ a", max_size=12))
    def collect(s):
        found.append(s)

    collect()
    assert over(spark, found, numbers.loose_number) == [plain_number(s) for s in found]


@pytest.mark.parametrize("raw, value, currency", [("£53.74", 53.74, "GBP"), ("₹1,199", 1199.0, "INR"), ("$249", 249.0, None), ("249 USD", 249.0, "USD"), ("none", None, None)])
def test_money(spark, raw, value, currency):
    m = over(spark, [raw], numbers.money)[0]
    assert (m and (m["value"], m["currency"])) == (None if value is None else (value, currency))


DEADLINES = [
    ("18 September 2026", (2026, 9, 18)),
    ("September 18, 2026", (2026, 9, 18)),
    ("2026-09-18", (2026, 9, 18)),
    ("9/18/2026", (2026, 9, 18)),
    ("18/09/2026", (2026, 9, 18)),
    ("01/07/2027", (2027, 1, 7)),
    ("1 - 15 October 2026", (2026, 10, 15)),
    ("October 1–15, 2026", (2026, 10, 15)),
    ("opens 1 May 2026, closes 3rd Jun. 2026", (2026, 6, 3)),
    ("31 February 2026", None),
    ("2026", None),
    ("order 2026-09-1899", None),
    ("12 Blah 2026", None),
    ("", None),
    (None, None),
]


def test_deadlines(spark):
    assert over(spark, [a for a, _ in DEADLINES], dates.parse_deadline) == [b and datetime.date(*b) for _, b in DEADLINES]
    assert over(spark, ["01/07/2027"], lambda c: dates.parse_deadline(c, "day_first")) == [datetime.date(2027, 7, 1)]


def test_passed_has_a_day_of_grace(spark):
    now = F.lit("2026-08-22 12:00:00").cast("timestamp")
    raw = ["7 Nov 2025", "22 August 2026", "21 August 2026", "20 August 2026", "unreadable", None]
    assert over(spark, raw, lambda c: dates.has_passed(dates.parse_deadline(c), now)) == [True, False, True, True, False, False]


def test_text_keys(spark):
    assert over(spark, ["  Crème  Brûlée!​ ", "ÅNGSTRÖM 2", "日本", None], text.comparison_key) == ["creme brulee", "angstrom 2", "", None]
    assert over(spark, ["In stock (20) In stock", "one two", "ha ha ha", "a"], text.without_echo) == ["In stock (20)", "one two", "ha ha", "a"]
    assert over(spark, ["Ab-1 é\t9", "x" * 60], text.character_shape) == ["Aa-a_é_a", "a" * 40]
    assert over(spark, ["# **Price:** `9`", "- item", "snake_case"], text.strip_markdown) == ["Price: 9", "item", "snake_case"]
    assert "Bearer" not in over(spark, ["Authorization: Bearer abcdefghij123"], text.redact)[0]


AGREE = [
    ("249", "$249.00", "agree"),
    ("£10", "€10", "disagree"),
    ("100", "100.4", "agree"),
    ("100", "101", "disagree"),
    ("In stock", "in stock (20) In stock", "agree"),
    ("red", "blue", "disagree"),
    ("!!!", "red", "incomparable"),
    (None, "red", "incomparable"),
    ("red", None, "incomparable"),
    ("12", "twelve", "disagree"),
]


def test_agreement(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(AGREE)], "i int, a string, b string")
    assert [r["x"] for r in df.select("i", text.agreement(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()] == [k for _, _, k in AGREE]


def test_addresses(spark):
    assert over(spark, ["http://www.Example.com/a/", "https://u@Host.org:8080/x?y#z", "ftp://x", None], urls.canonical) == ["https://example.com/a", "https://u@host.org:8080/x?y", "ftp://x", None]
    assert over(spark, ["http://www.Example.com/a/", "https://u@Host.org:8080/x", "mailto:a@b", None], urls.host) == ["example.com", "host.org", None, None]
    assert over(spark, ["https://a.test/x?utm_source=news&id=7", "https://a.test/?ref=1#t", "https://a.test/?a=1&fbclid=2&b=3"], urls.without_tracking) == ["https://a.test/x?id=7", "https://a.test/#t", "https://a.test/?a=1&b=3"]
    assert over(spark, ["http://localhost/x", "http://10.0.0.1/", "https://a.test/", "no"], urls.is_public) == [False, False, True, False]
    assert over(spark, ["mit.edu", "sub.x.ac.uk", "shop.com", None], urls.looks_official) == [True, True, False, False]


def test_let_finds_no_type_a_row_and_computes_its_value_once(spark):
    """An item of a transformed array asks for the type of all within it at every row."""
    rows = spark.range(3).select(text.let(F.col("id") * 2, lambda v: F.when(v > 0, v * v)).alias("x"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "transform(" not in plan and plan.count("* cast(2") + plan.count("* 2") <= 1
    assert [r["x"] for r in rows.collect()] == [None, 4, 16]
