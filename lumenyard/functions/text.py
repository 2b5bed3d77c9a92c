"""Text keys, shapes and comparisons, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import TOLERANCE, money, near

BLANK = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row.

    It is what an aggregate over nothing starts with. An item taken from a transformed array would have Spark
    find the type of all that is within use again for each row.
    """
    return F.aggregate(F.array(), value, lambda own, _: own, use)


def normal_text(text: Column) -> Column:
    """Without zero-width characters; runs of any blanks become a space; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\\x{200B}-\\x{200D}\\x{FEFF}]", ""), BLANK, " "))


def _unaccented() -> tuple[str, str]:
    """Lower-case letters that decompose to an ASCII letter and marks, and those letters."""
    pairs = []
    for code in range(0xC0, 0x3000):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if c.lower() == c and base != c and "a" <= base <= "z":
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def comparison_key(text: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces; accents go, other characters too."""
    plain = F.translate(F.lower(normal_text(text)), *_unaccented())
    return F.trim(F.regexp_replace(plain, "[^a-z0-9 ]", ""))


def alnum_key(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def without_echo(text: Column) -> Column:
    """Text whose end repeats its beginning (by comparison key) without that end: 'In stock (20) In stock'."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        part = lambda at, k: comparison_key(F.array_join(F.slice(words, at, k), " "))
        same = F.filter(F.sequence(F.floor(n / 2).cast("int"), F.lit(1), F.lit(-1)), lambda k: (part(F.lit(1), k) == part(n - k + 1, k)) & (part(F.lit(1), k) != ""))
        return F.when((n >= 2) & (F.size(same) > 0), F.trim(F.array_join(F.slice(words, F.lit(1), n - F.get(same, F.lit(0))), " "))).otherwise(F.array_join(words, " "))

    return let(F.split(normal_text(text), " "), lambda w: F.when(F.size(w) < 2, F.array_join(w, " ")).otherwise(cut(w)))


def character_shape(text: Column) -> Column:
    """Small letters and digits as a, capitals as A, blanks as _, at most 40 characters.

    Digits share the letter's sign on purpose: a shape tells formats apart by length and punctuation.
    """
    out = F.regexp_replace(F.regexp_replace(text, "[a-z0-9]", "a"), "[A-Z]", "A")
    return F.substring(F.regexp_replace(out, "\\s", "_"), 1, 40)


def strip_markdown(line: Column) -> Column:
    """A line without its block marker and emphasis marks."""
    out = F.regexp_replace(line, "^\\s*(?:#{1,6}\\s+|>\\s*|[-*+]\\s+|\\d+[.)]\\s+)", "")
    out = F.regexp_replace(F.regexp_replace(out, "\\*\\*|__|`", ""), "(?<![A-Za-z0-9])[*_]|[*_](?![A-Za-z0-9])", "")
    return F.trim(out)


def agreement(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """How two readings (strings) of one value compare: agree, disagree or incomparable; never null.

    Both hold a number: as money, where currencies count only if both are known. Else as text, by key,
    equal or one within the other. A missing reading, or one with an empty key, compares with nothing.
    """

    def judge(pair: Column) -> Column:
        m, n = pair["m"], pair["n"]
        other = (m["currency"] != n["currency"]) & m["currency"].isNotNull() & n["currency"].isNotNull()
        numeric = F.when(F.coalesce(other, F.lit(False)), "disagree").when(near(m["value"], n["value"], tolerance), "agree").otherwise("disagree")
        keys = F.struct(comparison_key(without_echo(a)).alias("x"), comparison_key(without_echo(b)).alias("y"))
        within = lambda k: F.contains(k["x"], k["y"]) | F.contains(k["y"], k["x"])
        text = let(keys, lambda k: F.when((k["x"] == "") | (k["y"] == ""), "incomparable").when(within(k), "agree").otherwise("disagree"))
        return F.when(m.isNotNull() & n.isNotNull(), numeric).otherwise(text)  # keys are found only where they are needed

    both = let(F.struct(money(a).alias("m"), money(b).alias("n")), judge)
    return F.when(a.isNull() | b.isNull(), "incomparable").otherwise(both)


def page_key(text: Column, n: int = 18) -> Column:
    """The first hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


# Secrets that are masked wherever they stand in a text.
SECRETS = [
    "(?i)bearer\\s+[A-Za-z0-9._~+/=-]{8,}",
    "\\b[0-9a-fA-F]{32,}\\b",
    "\\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{8,}",
    "(?i)(?:api[_-]?key|token|secret|password)\\s*[=:]\\s*\"?[^\\s\"']{6,}\"?",
]


def redact(text: Column, mask: str = "[redacted]") -> Column:
    """Text with everything that looks like a secret masked."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    return text
