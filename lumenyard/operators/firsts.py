"""The first row that meets a condition which is more than one equality, without rows multiplied and without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3  # characters by which terms and names meet

# What fields are called that hold a closing date, and a way to apply.
ALIKE = {
    "deadline_raw": "(?i)deadline|closing|close|apply_by|last_date",
    "application_url": "(?i)(?:apply|application).*(?:url|link)|^(?:apply_url|application_url)$",
}


def first_open(rows: DataFrame, incidents: DataFrame, take: list[str], order: Column | None = None) -> DataFrame:
    """rows (collector_id, url) with incident_id and the columns named in take, of the first open incident about the row.

    incidents: incident_id, collector_id, url (null: all of the collector's), created_at, resolved_at,
    quarantined. Open: quarantined and not resolved. First is the least by order, the newest if none is given
    (undated ones last), then the least id. The condition "this url or none" is two joins by key, each
    with one incident a key at most; the earlier of both is taken.
    """
    order = F.struct(F.col("created_at").isNull(), -F.unix_micros(F.to_timestamp("created_at"))) if order is None else order
    open_ = incidents.filter("quarantined and resolved_at is null").withColumn("__place", F.struct(order.alias("o"), F.col("incident_id").alias("i")))
    first = lambda name: F.min_by(F.struct("__place", "incident_id", *take), "__place").alias(name)
    own = open_.filter("url is not null").groupBy("collector_id", "url").agg(first("__own"))
    whole = open_.filter("url is null").groupBy("collector_id").agg(first("__whole"))
    found = rows.join(own, ["collector_id", "url"], "left").join(whole, "collector_id", "left")
    own_first = F.col("__own").isNotNull() & F.coalesce(F.col("__own.__place") <= F.col("__whole.__place"), F.lit(True))
    found = found.withColumn("__found", F.when(own_first, F.col("__own")).otherwise(F.col("__whole")))
    return found.select(*rows.columns, *(F.col(f"__found.{c}").alias(c) for c in ("incident_id", *take)))


def aligned(wanted: str, fields: Column) -> Column:
    """The field that a spec speaks of: the one of its name, else the first that is called alike (never input); else null."""
    alike = F.filter(fields, lambda f: F.rlike(f, F.lit(ALIKE[wanted])) & (f != "input")) if wanted in ALIKE else F.array().cast("array<string>")
    return F.when(F.array_contains(fields, wanted), F.lit(wanted)).otherwise(F.get(alike, F.lit(0)))


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.array_distinct(F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def find_named(terms: DataFrame, term: str, items: DataFrame, name: str, code: str, order: str) -> DataFrame:
    """terms with found: order of the first item (least order) whose name contains the term or whose code equals it; else null.

    Case and blanks around a term do not count; an empty or null term finds nothing. Each different term is looked
    for once, among different names. Terms of up to GRAM characters are looked up among all runs of their length in
    names, of each of which only the first item is kept, so they meet one row at most. Longer ones meet the
    names that hold the rarest of their runs of GRAM characters.
    """
    key = F.lower(F.trim(F.coalesce(F.col(term), F.lit(""))))
    wanted = terms.select(key.alias("t")).filter("t <> ''").distinct()
    names = items.groupBy(F.lower(name).alias("n")).agg(F.min(order).alias("at")).filter("n is not null")
    codes = items.groupBy(F.lower(code).alias("t")).agg(F.min(order).alias("at"))
    by_code = wanted.join(codes, "t").select("t", "at")
    runs = names.select(F.explode(F.concat(*(_grams(F.col("n"), k) for k in range(1, GRAM + 1)))).alias("t"), "at").groupBy("t").agg(F.min("at").alias("at"))
    short = wanted.filter(F.length("t") <= GRAM).join(runs, "t").select("t", "at")
    blocks = names.select("n", "at", F.explode(_grams(F.col("n"), GRAM)).alias("g"))
    sizes = blocks.groupBy("g").agg(F.count("*").alias("c"))
    long_ = wanted.filter(F.length("t") > GRAM).select("t", F.explode(_grams(F.col("t"), GRAM)).alias("g"))
    # a run that no name holds is the rarest: its term is found nowhere
    rarest = long_.join(sizes, "g", "left").groupBy("t").agg(F.min_by("g", F.struct(F.coalesce("c", F.lit(0)), F.col("g"))).alias("g"))
    long_ = rarest.join(blocks, "g").filter(F.contains("n", F.col("t"))).select("t", "at")
    found = by_code.unionAll(short).unionAll(long_).groupBy("t").agg(F.min("at").alias("found"))
    return terms.withColumn("__t", key).join(found.withColumnRenamed("t", "__t"), "__t", "left").drop("__t")
