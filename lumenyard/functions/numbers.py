"""Numbers and money read from loosely written text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs that stand for one currency only; the dollar sign stands for many.
SYMBOLS = [
    ("£", "GBP"),
    ("€", "EUR"),
    ("¥", "JPY"),
    ("₹", "INR"),
    ("₽", "RUB"),
    ("₩", "KRW"),
    ("₪", "ILS"),
    ("₦", "NGN"),
    ("₫", "VND"),
    ("฿", "THB"),
    ("₴", "UAH"),
    ("₺", "TRY"),
]
TOLERANCE = 0.005


def loose_number(text: Column) -> Column:
    """A double from text with any of the usual separators, else null.

    The last of two kinds of separator is the decimal one; a single one before three digits parts
    thousands, before any other number of digits it is decimal; a repeated one parts thousands if all
    groups after it have three digits.
    """
    kept = F.regexp_replace(text, "[^0-9.,-]", "")
    body = F.replace(kept, F.lit("-"), F.lit(""))
    count = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    drop = lambda c: F.replace(body, F.lit(c), F.lit(""))
    last = F.regexp_extract(body, "([.,])[^.,]*$", 1)
    mixed = (
        F.when((last == ",") & (count(",") == 1), F.replace(drop("."), F.lit(","), F.lit(".")))
        .when((last == ".") & (count(".") == 1), drop(","))
    )

    def single(c: str, escaped: str) -> Column:
        one = F.when(F.length(F.substring_index(body, c, -1)) == 3, drop(c)).otherwise(F.replace(body, F.lit(c), F.lit(".")))
        return F.when(count(c) == 1, one).when(F.rlike(body, F.lit(f"^[0-9]*(?:{escaped}[0-9]{{3}})+$")), drop(c))

    plain = (
        F.when((count(",") > 0) & (count(".") > 0), mixed)
        .when(count(",") > 0, single(",", ","))
        .when(count(".") > 0, single(".", "[.]"))
        .otherwise(body)
    )
    sign = F.when(F.startswith(kept, F.lit("-")), -1.0).otherwise(1.0)
    return F.when(F.rlike(kept, F.lit("[0-9]")), sign * plain.try_cast("double"))


def money(text: Column, hint: str | None = None) -> Column:
    """struct<value, currency> of a text, or null if it holds no number. The hint is for texts without a currency."""
    value = loose_number(text)
    currency = F.coalesce(
        *(F.when(F.contains(text, F.lit(s)), F.lit(code)) for s, code in SYMBOLS),
        F.nullif(F.regexp_extract(F.upper(text), "\\b([A-Z]{3})\\b", 1), F.lit("")),
        F.lit(hint.upper() if hint else None).cast("string"),
    )
    return F.when(value.isNotNull(), F.struct(value.alias("value"), currency.alias("currency")))


def near(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two numbers differ by at most a share of the larger one (or of 1)."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= tolerance


def ratio(a: Column, b: Column) -> Column:
    """The smaller over the larger; null if both are 0."""
    return F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    unit = 10.0**digits
    return F.floor(x * unit + 0.5) / unit


def funding_amount(text: Column) -> Column:
    """struct<value, currency> of the first amount in prose: rupees with lakh or crore, dollars with k; else null."""
    rupee = "(?i)(?:₹|\\brs\\.?|\\binr)\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*(lakhs?|crores?)?"
    dollar = "(?i)(?:\\$|\\busd)\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*(k\\b)?"

    def amount(pattern: str, code: str, scale) -> Column:
        digits = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(""))
        unit = F.lower(F.regexp_extract(text, pattern, 2))
        value = digits.try_cast("double") * scale(unit)
        return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(code).alias("currency")))

    lakh = lambda u: F.when(F.startswith(u, F.lit("lakh")), 1e5).when(F.startswith(u, F.lit("crore")), 1e7).otherwise(1.0)
    return F.coalesce(amount(rupee, "INR", lakh), amount(dollar, "USD", lambda u: F.when(u == "k", 1e3).otherwise(1.0)))
