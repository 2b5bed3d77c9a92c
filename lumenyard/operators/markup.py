"""What a page declares about itself: its JSON-LD blocks, walked object by object, and its meta tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenyard.functions.text import let
from lumenyard.operators import verdict

DEPTH = 8  # levels of objects and arrays below a block
# Fields that may hold the closing date, best first; kinds of currency code; the confidence of a declared fact.
DEADLINE_FIELDS = ["registrationDeadline", "applicationDeadline", "applicationDeadlineDate", "deadline", "validThrough", "expires", "endDate"]
PROVIDER_FIELDS = ["provider", "organizer", "hiringOrganization"]
DECLARED = 0.95
BLOCK = "(?is)<script[^>]*type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"
ENTRY = "array<struct<v:variant,raw:string>>"


def _entry(value: Column, raw: Column) -> Column:
    return F.struct(value.alias("v"), raw.alias("raw"))


def _open(raw: Column) -> Column:
    """Whether a JSON text may be an object or an array; what a string holds may look so too."""
    return F.startswith(raw, F.lit("{")) | F.startswith(raw, F.lit("["))


def _opened(entry: Column) -> Column:
    """An object and the objects and arrays among its members, in the order of its text, or those among an array's items.

    What has been opened has no text any more and stays as it is.
    """
    value, raw = entry["v"], entry["raw"]
    members, items = F.try_variant_get(value, "$", "map<string,variant>"), F.try_variant_get(value, "$", "array<variant>")
    none = F.array().cast(ENTRY)
    # a map of strings keeps the order of the text, which a variant does not
    texts = F.filter(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: _open(e["value"]))
    own = F.transform(texts, lambda e: _entry(F.try_element_at(members, e["key"]), e["value"]))
    many = F.zip_with(items, F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>")), _entry)
    deeper = (F.locate("{", raw, 2) > 0) | (F.locate("[", raw, 2) > 0)
    this = F.array(_entry(value, F.lit(None).cast("string")))
    below = F.coalesce(F.filter(many, lambda e: e["v"].isNotNull() & F.coalesce(_open(e["raw"]), F.lit(True))), none)
    whole = F.when(deeper, F.concat(this, F.coalesce(own, none))).otherwise(this)
    return F.when(raw.isNull(), F.array(entry)).when(F.startswith(raw, F.lit("{")), F.when(members.isNotNull(), whole).otherwise(none)).otherwise(below)


def objects(html: Column, depth: int = DEPTH) -> Column:
    """array<variant>: every object in the page's JSON-LD blocks, each before those within it, in the order of the text.

    Blocks that are no JSON are passed over; what lies deeper than depth levels too.
    """
    blocks = F.transform(F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1)), lambda b: _entry(F.try_parse_json(F.trim(b)), F.btrim(b, F.lit(" \t\r\n"))))
    found = F.filter(blocks, lambda e: e["v"].isNotNull())
    for _ in range(depth):
        found = F.flatten(F.transform(found, _opened))
    is_object = lambda e: F.try_variant_get(e["v"], "$", "map<string,variant>").isNotNull()
    return F.transform(F.filter(found, is_object), lambda e: e["v"])


def _string(value: Column) -> Column:
    """A JSON string without needless blanks; null for anything else and for an empty one."""
    plain = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return let(F.trim(F.regexp_replace(plain, "\\s+", " ")), lambda t: F.when(t != "", t))


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _named(value: Column) -> Column:
    """A text, or the name of an object, or that of the first of several."""

    def read(v: Column) -> Column:
        several = let(_at(v, "$[0]"), lambda first: F.coalesce(_string(first), _string(_at(first, "$.name"))))
        return F.when(v.isNotNull(), F.coalesce(_string(v), _string(_at(v, "$.name")), several, _string(_at(v, "$.name.name"))))

    return let(value, read)


def _day(value: Column) -> Column:
    """The day that an ISO date begins with, of the years 1990 to 2100; null if there is no such day."""
    day = F.when(value.isNotNull(), F.regexp_extract(_string(value), "^(\\d{4}-\\d{2}-\\d{2})", 1).try_cast("date"))
    return let(day, lambda d: F.when(F.year(d).between(1990, 2100), d))


def _first(found: Column, of: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(F.transform(found, of), lambda v: v.isNotNull()), F.lit(0))


def _meta(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, f"(?is)<meta[^>]*(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']+)[\"']", 1), F.lit(""))


def structured_facts(html: Column) -> Column:
    """struct<types, title, provider, start, deadline, deadline_field, amount, currency>; nulls where a page declares none.

    Each fact is the first that an object declares; of an object's dates the one that most likely closes it.
    Money stands in an object's offers or in itself. A title may come from a meta tag instead.
    """

    def facts(found: Column) -> Column:
        dated = lambda o, f: let(_day(_at(o, f"$.{f}")), lambda d: F.when(d.isNotNull(), F.struct(d.alias("day"), F.lit(f).alias("field"))))
        offer = lambda o: let(_at(o, "$.offers"), lambda x: F.when(F.try_variant_get(x, "$", "map<string,variant>").isNotNull(), x).otherwise(o))

        def amount(place: Column) -> Column:
            raw = F.coalesce(*(_at(place, f"$.{n}") for n in ("amount", "value", "price")))
            plain = lambda v: F.when(F.rlike(F.schema_of_variant(v), F.lit("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)")), F.try_variant_get(v, "$", "double"))
            number = let(raw, lambda v: F.coalesce(plain(v), _string(v).try_cast("double")))
            return let(number, lambda n: F.when(n > 0, n))

        def code(place: Column) -> Column:
            name = _named(F.coalesce(_at(place, "$.currency"), _at(place, "$.priceCurrency")))
            return let(name, lambda n: F.when(F.rlike(n, F.lit("^[A-Z]{3}$")), n))

        kinds = lambda o: F.coalesce(F.array_compact(F.array(_string(_at(o, "$['@type']")))), F.array().cast("array<string>"))
        many = lambda o: F.array_compact(F.transform(F.coalesce(F.try_variant_get(o, "$['@type']", "array<variant>"), F.array().cast("array<variant>")), _string))
        of_places = lambda places, closing: F.struct(
            F.array_distinct(F.flatten(F.transform(found, lambda o: F.concat(kinds(o), many(o))))).alias("types"),
            F.coalesce(_first(found, lambda o: F.coalesce(_named(_at(o, "$.name")), _named(_at(o, "$.headline")))), _meta(html, "og:title"), _meta(html, "twitter:title")).alias("title"),
            _first(found, lambda o: F.coalesce(*(_named(_at(o, f"$.{f}")) for f in PROVIDER_FIELDS))).alias("provider"),
            _first(found, lambda o: _day(_at(o, "$.startDate"))).alias("start"),
            closing["day"].alias("deadline"),
            closing["field"].alias("deadline_field"),
            _first(places, amount).alias("amount"),
            _first(places, code).alias("currency"),
        )
        closing = _first(found, lambda o: F.coalesce(*(dated(o, f) for f in DEADLINE_FIELDS)))
        return let(F.transform(found, offer), lambda places: let(closing, lambda c: of_places(places, c)))

    return let(F.coalesce(objects(html), F.array().cast("array<variant>")), facts)


def adjudicated(pages: DataFrame, visible: str, facts: str) -> DataFrame:
    """pages with ruling: struct<verdict, confidence, corroborated>, of a date read in the text against the declared one.

    The declared date is the second reading; there are no checks, since a page just found has no history. Null
    where the page declares no date: silence is no conflict.
    """
    declared = F.col(f"{facts}.deadline").cast("string")
    kind, sure = verdict.judged_reading(F.col(visible), declared, F.lit("date"), F.lit(False), F.lit(DECLARED))
    nothing = F.array().cast("array<string>")
    field = lambda k: F.when(kind == k, F.array(F.lit("deadline"))).otherwise(nothing)
    rows = pages.select(F.struct(*pages.columns).alias("__page"), declared.isNotNull().alias("__declared"), kind.alias("__kind"), sure.alias("__sure"))
    kind = F.col("__kind")
    rows = rows.withColumns({
        **{flag: F.lit(False) for flag in ("explicit", "failed", "warned", "departs")},
        "failing": nothing, "check_coverage": F.lit(0.0), "aligned": F.lit(None).cast("boolean"),
        "agreed": field("agree"), "disagreed": field("disagree"), "incomparable": field("incomparable"),
        "agreement_rate": (kind == "agree").cast("double"), "coverage": (kind != "incomparable").cast("double"),
        "weakest": F.when(kind == "disagree", F.col("__sure")).otherwise(1.0),
    })
    ruling = F.struct("verdict", F.col("verdict_confidence").alias("confidence"), (kind == "agree").alias("corroborated"))
    return verdict.classify(rows).select("__page.*", F.when(F.col("__declared"), ruling).alias("ruling"))
