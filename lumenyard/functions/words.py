"""Word lists as conditions on text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of(*phrases: str) -> str:
    """A pattern for any of the phrases. A space stands for blanks or hyphens, (x) for an x that may be missing."""

    def part(phrase: str) -> str:
        pieces = re.split(r"(\([^)]*\))", phrase)
        return "".join(f"(?:{part(p[1:-1])})?" if p.startswith("(") else re.escape(p).replace("\\ ", "[\\s-]+").replace("\\-", "[\\s-]?") for p in pieces if p)

    return "(?:" + "|".join(part(p) for p in sorted(phrases, key=len, reverse=True)) + ")"


def whole(*phrases: str) -> str:
    """The same between word boundaries, in letters of either case."""
    return f"(?i)\\b{one_of(*phrases)}\\b"


def says(text: Column, *phrases: str) -> Column:
    """Whether a text has one of the phrases as whole words; null if the text is null."""
    return F.rlike(text, F.lit(whole(*phrases)))


def is_just(text: Column, *phrases: str) -> Column:
    """Whether a text is one of the phrases and nothing else."""
    return F.rlike(text, F.lit(f"(?i)^\\s*{one_of(*phrases)}\\s*$"))


def begins(text: Column, *phrases: str) -> Column:
    return F.rlike(text, F.lit(f"(?i)^\\s*{one_of(*phrases)}\\b"))
