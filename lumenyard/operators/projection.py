"""Opportunities in one shape, from rows that collectors read and from drafts found while crawling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenyard.functions import numbers
from lumenyard.functions.dates import parse_deadline
from lumenyard.functions.repair import as_flag, as_list, clean_title, unscrambled
from lumenyard.functions.text import let
from lumenyard.operators import opportunity
from lumenyard.operators.drafts import is_furniture, is_index, scan_for_deadline
from lumenyard.operators.firsts import first_open

# The types of opportunities, and how long a reading is fresh where its collector says nothing.
TYPES = ("scholarship", "fellowship", "internship", "grant", "hackathon", "research-program")
FRESH_MINUTES = 24 * 60
# The names that collectors give a field, the preferred one first.
NAMES = {
    "title": ("title", "opportunity_title", "name"),
    "provider": ("provider", "organization", "organisation", "host"),
    "apply": ("application_url", "apply_url", "url"),
    "type": ("opportunity_type", "type", "category"),
    "amount": ("funding_amount", "amount"),
    "currency": ("funding_currency", "currency"),
    "coverage": ("funding_coverage", "coverage"),
    "deadline_raw": ("deadline_raw", "application_deadline", "deadline"),
    "deadline": ("deadline", "application_deadline"),
    "state": ("application_status", "registration_status", "status"),
    "summary": ("summary", "description"),
    "eligibility": ("eligibility", "eligibility_rules", "requirements"),
    "interests": ("interests", "fields", "subjects", "categories"),
    "locations": ("locations", "location", "countries"),
    "remote": ("remote", "is_remote"),
    "documents": ("required_documents", "documents"),
}
INNER = ("amount", "currency", "coverage")  # what stands in a funding object


def _none() -> Column:
    return F.lit(None).cast("string")


def _empty() -> Column:
    return F.array().cast("array<string>")


def members(row: Column, *names: str) -> Column:
    """struct of a variant's members, each a variant or null, all found in one pass; null if it is no object."""
    return F.try_variant_get(row, "$", f"struct<{', '.join(f'`{n}`: variant' for n in dict.fromkeys(names))}>")


def _string(member: Column) -> Column:
    """A member that is a string and not blank, trimmed."""
    return F.when(F.schema_of_variant(member) == "STRING", F.nullif(F.trim(F.try_variant_get(member, "$", "string")), F.lit("")))


def text_of(row: Column, *names: str) -> Column:
    """The first of a row's members (see members) that is a text and not blank, as it was read."""
    return F.coalesce(*(_string(row[n]) for n in names))


def number_of(row: Column, *names: str) -> Column:
    """The first member that is a number, or a text that is one but for other signs around it."""
    number = lambda m: F.when(~F.schema_of_variant(m).isin("STRING", "BOOLEAN"), F.try_variant_get(m, "$", "double"))
    read = lambda m: F.regexp_replace(_string(m), "[^0-9.-]", "").try_cast("double")
    return F.coalesce(*(c for n in names for c in (number(row[n]), read(row[n]))))


def flag_of(row: Column, *names: str) -> Column:
    """The first member that is true or false, or a word for it."""
    plain = lambda m: F.when(F.schema_of_variant(m) == "BOOLEAN", F.try_variant_get(m, "$", "boolean"))
    return F.coalesce(*(c for n in names for c in (plain(row[n]), as_flag(_string(row[n])))))


def list_of(row: Column, *names: str) -> Column:
    """Distinct trimmed texts of the first member that is an array (other items are left out) or a listing text; else empty."""

    def items(m: Column) -> Column:
        own = F.try_variant_get(m, "$", "array<variant>")
        texts = F.transform(F.filter(own, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
        return F.array_distinct(F.filter(texts, lambda t: t != ""))

    return F.coalesce(*(c for n in names for c in (items(row[n]), as_list(_string(row[n])))), _empty())


def address(text: Column) -> Column:
    """A text that is an absolute address, else null."""
    return F.when(F.rlike(text, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#\\s]+|[^/\\s])\\S*$")), text)


def is_fixture(collector_id: Column, name: Column, domain: Column, lab: str | None = None) -> Column:
    """Whether a collector reads a page of our own that is there to be broken, and not somebody's offer."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    named = F.contains(low(name), F.lit("controlled fixture")) | F.startswith(low(name), F.lit("doorway lab"))
    at = (low(domain) == "localhost") | F.startswith(low(domain), F.lit("localhost:"))
    own = low(domain) == lab.strip().lower() if lab and lab.strip() else F.lit(False)
    return F.coalesce(F.startswith(collector_id.cast("string"), F.lit("demo-doorway-")), F.lit(False)) | named | at | own


def trust_of(held: Column, verified_at: Column, fresh_minutes: Column, confirmed_by: Column, now: Column) -> Column:
    """quarantined while an incident is open, then stale by age, then verified if two sensors agreed, else partially_verified.

    A reading without a time is not stale: its age is not known.
    """
    age = F.unix_millis(now) - F.unix_millis(F.to_timestamp(verified_at))
    old = age > F.coalesce(fresh_minutes.cast("bigint"), F.lit(FRESH_MINUTES)) * 60_000
    return F.when(held, "quarantined").when(old, "stale").when(confirmed_by == "two_sensors", "verified").otherwise("partially_verified")


def type_of(given: Column, title: Column) -> Column:
    """The type that is given if it is one, else what the title and it speak of; null if that is none."""
    low = F.lower(F.coalesce(given, F.lit("")))
    return F.when(low.isin(*TYPES), low).otherwise(opportunity.kind_of(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), low)))


def from_snapshots(snapshots: DataFrame, collectors: DataFrame, incidents: DataFrame, now: Column, lab: str | None = None, include_fixtures: bool = False) -> DataFrame:
    """Opportunities of the rows that collectors last verified.

    snapshots: collector_id, url, data (array<variant>, its items rows; sources.tables.variants reads it), verified_at,
    confirmed_by (null: contract_only). collectors: collector_id, name, domain, fresh_minutes; one row each.
    incidents: as in firsts.first_open, with verdict and fields. Rows that are no object, lack a title or
    provider, or are of no known type are left out, and so are snapshots of unknown collectors and of fixtures.
    Collectors and open incidents are joined by key, one row at most each, so rows never multiply.
    """
    owners = collectors.select("collector_id", F.col("fresh_minutes"), is_fixture(F.col("collector_id"), F.col("name"), F.col("domain"), lab).alias("fixture"))
    rows = snapshots.select("collector_id", "url", "data", "verified_at", F.coalesce("confirmed_by", F.lit("contract_only")).alias("confirmed_by")).join(owners, "collector_id")
    if not include_fixtures:
        rows = rows.filter(~F.col("fixture"))
    # a row is taken apart before it is exploded: filters that Spark moves down then read its members and not the whole of it again
    own = F.transform("data", lambda x: members(x, "funding", "funding_level", *(n for names in NAMES.values() for n in names)))
    rows = first_open(rows, incidents, ["verdict", "fields"]).withColumn("row", F.explode(own))
    get = lambda read, name: read(F.col("row"), *NAMES[name])
    texts = {n: get(text_of, n) for n in ("title", "provider", "apply", "type", "currency", "deadline", "deadline_raw", "state", "summary")}
    texts["level"] = text_of(F.col("row"), "funding_level")
    rows = rows.withColumns(texts | {"inner": members(F.col("row.funding"), *INNER)}).filter("title is not null and provider is not null")
    rows = rows.withColumns({n: unscrambled(F.col(n)) for n in texts})  # wrongly decoded text is mended
    rows = rows.withColumn("type", type_of(F.col("type"), F.col("title"))).filter("type is not null")
    nested = lambda read, name: read(F.col("inner"), name)
    rows = rows.withColumns({"summary": F.coalesce("summary", F.lit("")), "coverage": F.array_union(get(list_of, "coverage"), nested(list_of, "coverage")), "dates": F.transform(F.array("deadline", F.coalesce("deadline_raw", "deadline")), parse_deadline)})
    held = F.col("incident_id").isNotNull()
    prose = F.concat_ws(" ", "level", F.array_join("coverage", " "), "summary")
    return rows.select(
        F.left(F.sha2(F.concat_ws(":", "collector_id", "url", "title", "provider"), 256), F.lit(18)).alias("id"),
        F.col("collector_id").cast("string").alias("source_id"),
        F.col("url").alias("source_url"),
        "title",
        "provider",
        "type",
        "summary",
        get(list_of, "eligibility").alias("eligibility"),
        get(list_of, "interests").alias("interests"),
        F.coalesce(get(number_of, "amount"), nested(number_of, "amount")).alias("amount"),
        F.upper(F.coalesce("currency", unscrambled(nested(text_of, "currency")))).alias("currency"),
        "coverage",
        opportunity.funding_level(prose, F.col("coverage")).alias("funding"),
        F.col("dates")[0].alias("deadline"),
        "deadline_raw",
        opportunity.lifecycle(F.col("state"), _none(), F.coalesce("deadline_raw", "deadline"), _none(), now, F.col("dates")[1]).alias("status"),
        get(list_of, "locations").alias("locations"),
        get(flag_of, "remote").alias("remote"),
        get(list_of, "documents").alias("documents"),
        F.coalesce(address(F.col("apply")), F.col("url")).alias("application_url"),
        trust_of(held, F.col("verified_at"), F.col("fresh_minutes"), F.col("confirmed_by"), now).alias("trust"),
        "confirmed_by",
        F.to_timestamp("verified_at").alias("verified_at"),
        F.col("incident_id").cast("string").alias("incident_id"),
        F.coalesce("fields", _empty()).alias("disputed"),
        "verdict",
    )


def publishable(title: Column, url: Column) -> Column:
    """Whether a draft is one offer: its page is no list of them, and its title names more than a part of a page."""
    return let(clean_title(title), lambda t: ~is_index(t, F.lit(""), url) & ~is_furniture(t))


def from_drafts(drafts: DataFrame, now: Column) -> DataFrame:
    """The same columns, of publishable drafts: source_url, host, title, provider, type, summary, deadline_raw, funding
    (text), status (as read), eligibility (text), missing (array), corroboration and read_at.

    A draft is discovered, whoever read it; one that its page's own data confirms was read by two sensors, and of
    one that they contradict the deadline is disputed. A type that is none counts as a scholarship.
    """
    rows = drafts.filter(publishable(F.col("title"), F.col("source_url"))).withColumn("deadline_raw", F.coalesce("deadline_raw", scan_for_deadline(F.col("summary"))))
    rows = rows.withColumn("due", parse_deadline(F.col("deadline_raw")))
    money = numbers.funding_amount(F.col("funding"))
    missing = F.coalesce("missing", _empty())
    return rows.select(
        F.left(F.sha2(F.concat(F.lit("discovered:"), "source_url"), 256), F.lit(18)).alias("id"),
        F.concat(F.lit("discovered:"), "host").alias("source_id"),
        "source_url",
        clean_title(F.col("title")).alias("title"),
        "provider",
        F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("scholarship").alias("type"),
        "summary",
        F.when(F.col("eligibility").isNull(), _empty()).otherwise(F.array("eligibility")).alias("eligibility"),
        _empty().alias("interests"),
        money["value"].alias("amount"),
        money["currency"].alias("currency"),
        _empty().alias("coverage"),
        opportunity.funding_level(F.col("funding"), _empty()).alias("funding"),
        F.col("due").alias("deadline"),
        "deadline_raw",
        opportunity.lifecycle(_none(), F.col("summary"), F.col("deadline_raw"), F.col("status"), now, F.col("due")).alias("status"),
        _empty().alias("locations"),
        F.lit(None).cast("boolean").alias("remote"),
        _empty().alias("documents"),
        F.col("source_url").alias("application_url"),
        F.lit("discovered").alias("trust"),
        F.when(F.col("corroboration") == "confirmed", "two_sensors").otherwise("single_sensor").alias("confirmed_by"),
        F.to_timestamp("read_at").alias("verified_at"),
        _none().alias("incident_id"),
        F.when(F.col("corroboration") == "conflicting", F.array_union(missing, F.array(F.lit("deadline_raw")))).otherwise(missing).alias("disputed"),
        _none().alias("verdict"),
    )


def combined(*parts: DataFrame) -> DataFrame:
    """All parts' opportunities, each once (opportunity.deduplicate; the least id among equals)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return opportunity.deduplicate(rows.withColumn("ord", F.col("id"))).drop("ord")
