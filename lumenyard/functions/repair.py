"""Repairs and tidying of scraped text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal_text

#: What Windows-1252 writes at the bytes 0x80 to 0x9F, and those bytes as Latin-1 characters; by rule.
_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_CP1252 = bytes(_BYTES).decode("cp1252")
_LATIN1 = bytes(_BYTES).decode("latin-1")
MARKS = "Ã|Â|â€|â‚|Å|Ð|ð"


def unscrambled(text: Column) -> Column:
    """UTF-8 text that was read as Windows-1252, read rightly; any other text, and what cannot be undone, stays."""
    raw = F.translate(text, _CP1252, _LATIN1)
    data = F.encode(raw, "ISO-8859-1")
    suspect = F.rlike(text, F.lit(MARKS)) & F.rlike(raw, F.lit("^[\\x00-\\xFF]*$"))
    read = F.when(suspect & F.is_valid_utf8(data.cast("string")), data.cast("string"))
    return F.coalesce(read, text)


def clean_title(title: Column) -> Column:
    """A title without what follows a bar or a dash with spaces, without a closing mark, at most 160 characters."""
    head = F.regexp_replace(normal_text(title), "\\s+[|\\x{2013}\\x{2014}-]\\s+[^|\\x{2013}\\x{2014}-]*$", "")
    return F.substring(F.regexp_replace(head, "[\\s.:;,|-]+$", ""), 1, 160)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def as_flag(text: Column) -> Column:
    """true, yes and remote; false, no and onsite; else null."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "remote"), True).when(low.isin("false", "no", "onsite"), False)


def as_list(text: Column) -> Column:
    """Distinct trimmed parts between semicolons, commas and bars."""
    parts = F.transform(F.split(text, "[;,|]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def shortened(text: Column, most: int = 48) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)
