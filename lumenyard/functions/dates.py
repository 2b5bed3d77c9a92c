"""Deadlines read from text, as Column expressions; every clock is an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Months by the first letters of their names, the endings of ordinals, and the years that count.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
ORDINALS = ["st", "nd", "rd", "th"]
YEARS = (1990, 2100)
LONGEST_MONTH = 9  # letters

#: Digits, letters or one other sign, with the blanks before it.
TOKEN = "\\s*(?:[0-9]+|[A-Za-z]+|[^0-9A-Za-z\\s])"
#: A text that is an ISO date and nothing else is read without cutting it into tokens.
ISO = "^(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\\z"
#: Token sequences up to a year, and where they hold month and last day: small numbers n, month names m, dashes -.
NAMED = [("m n - n y", -4, -1), ("n - n m y", -1, -2), ("n m y", -1, -2), ("m n y", -2, -1)]


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date of the years that count, or null; no day rolls over."""
    real = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(year.between(*YEARS) & month.between(1, 12) & day.between(1, 31), real)


def _token(text: Column, before: Column) -> Column:
    """struct<kind, value, glued> of a token and the one before it; kind is empty for what a date may leave out."""
    bare = lambda t: F.ltrim(t, F.lit(" \t\r\n\f\x0b"))
    first = lambda t: F.substring(F.lower(t), 1, 1)
    side = lambda p: F.struct(p["plain"].alias("plain"), p["glued"].alias("glued"), first(p["plain"]).alias("own"), first(p["last"]).alias("last"))
    parts = F.struct(bare(text).alias("plain"), F.coalesce(bare(before), F.lit("")).alias("last"), (before.isNotNull() & (bare(text) == text)).alias("glued"))
    return let(let(parts, side), lambda p: _typed(p["plain"], p["own"], p["last"], p["glued"]))


def _typed(plain: Column, own: Column, last: Column, glued: Column) -> Column:
    """The same of a token without blanks, its first letter, that of the one before ("": none), and whether nothing stands between."""
    is_word = lambda c: c.between("a", "z")
    is_number = lambda c: c.between("0", "9")
    size, number = F.length(plain), plain.try_cast("int")
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    month = F.when(size.between(3, LONGEST_MONTH), F.try_element_at(table, F.lower(F.substring(plain, 1, 3))))
    digits = F.when(glued & is_word(last), "other").when(size <= 2, "n").when((size == 4) & number.between(1900, 2099), "y").otherwise("other")
    letters = F.when(glued & is_number(last), F.when(F.lower(plain).isin(ORDINALS), "").otherwise("other")).when(month.isNotNull(), "m").otherwise("other")
    sign = F.when(plain.isin("-", "\u2013", "\u2014"), "-").when(plain == "/", "/").when(plain == ",", "").when(plain == ".", F.when(is_word(last), "").otherwise(".")).otherwise("other")
    kind = F.when(is_number(own), digits).when(is_word(own), letters).otherwise(sign)
    return F.struct(kind.alias("kind"), F.when(is_word(own), month).otherwise(number).alias("value"), glued.alias("glued"), (plain == "-").alias("hyphen"))


def _dates(tokens: Column, day_first: bool) -> Column:
    """The dates that stand around the years among the tokens."""

    def at(i: Column) -> Column:
        token = lambda k: F.get(tokens, i + k)
        value = lambda k: token(k)["value"]
        reads = lambda kinds, first: reduce(Column.__and__, (token(first + k)["kind"] == kind for k, kind in enumerate(kinds) if kind != "y"))
        tight = lambda *ks: reduce(Column.__and__, (token(k)["glued"] for k in ks))
        found = F.lit(None).cast("date")
        for line, m, d in NAMED:
            kinds = line.split()
            found = F.coalesce(found, F.when(reads(kinds, 1 - len(kinds)), _day(value(0), value(m), value(d))))
        more = F.coalesce(token(5)["hyphen"] & token(5)["glued"], F.lit(False))
        iso = reads(["y", "-", "n", "-", "n"], 0) & token(1)["hyphen"] & token(3)["hyphen"] & tight(1, 2, 3, 4) & ~more
        stroke = lambda k: token(k)["kind"].isin("/", ".") | token(k)["hyphen"]
        numeric = (token(-4)["kind"] == "n") & stroke(-3) & (token(-2)["kind"] == "n") & stroke(-1) & tight(-3, -2, -1, 0)
        swapped = F.lit(day_first) | (value(-4) > 12)
        read = F.when(swapped, _day(value(0), value(-2), value(-4))).otherwise(_day(value(0), value(-4), value(-2)))
        return F.array(found, F.when(iso, _day(value(0), value(2), value(4))), F.when(numeric, read))

    years = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i)["kind"] == "y")
    return F.flatten(F.transform(years, at))


def parse_deadline(raw: Column, slash_order: str = "month_first") -> Column:
    """The latest date that a text names, or null.

    The text is cut into tokens, and dates are runs of them: a day, a month's name and a year in the usual
    orders, a range of days (its end counts), or numbers. In numbers with strokes the first is the month unless
    it exceeds 12; slash_order="day_first" reads it as the day.
    """
    return let(raw, lambda text: _parsed(text, slash_order == "day_first"))


def _parsed(text: Column, day_first: bool) -> Column:
    dated = F.when(F.rlike(text, F.lit("(?:19|20)[0-9]{2}")), text)  # no year, no date
    parts = F.regexp_extract_all(dated, F.lit(TOKEN), F.lit(0))
    typed = let(parts, lambda own: F.transform(own, lambda t, i: _token(t, F.get(own, i - 1))))
    tokens = F.filter(typed, lambda t: t["kind"] != "")
    read = let(tokens, lambda own: F.array_max(F.when(F.size(own) > 0, _dates(own, day_first))))
    day = let(text.try_cast("date"), lambda d: F.when(F.year(d).between(*YEARS), d))
    return F.when(F.rlike(text, F.lit(ISO)), day).when(F.rlike(text, F.lit("(?:19|20)[0-9]{2}")), read)


def has_passed(deadline: Column, now: Column) -> Column:
    """Whether a date lies more than a day before now; an unknown one does not."""
    return F.coalesce(F.to_timestamp(deadline) < now - F.expr("interval 1 day"), F.lit(False))


def days_until(deadline: Column, now: Column) -> Column:
    """Whole days from now, rounded down."""
    return F.floor((F.unix_timestamp(F.to_timestamp(deadline)) - F.unix_timestamp(now)) / 86400).cast("bigint")


def date_agreement(a: Column, b: Column) -> Column:
    """agree or disagree where both texts name a date, else null (compare them as values then)."""
    days = F.struct(parse_deadline(a).alias("x"), parse_deadline(b).alias("y"))
    return let(days, lambda d: F.when(d["x"].isNotNull() & d["y"].isNotNull(), F.when(d["x"] == d["y"], "agree").otherwise("disagree")))
