"""Queries of opportunities projected from collected rows, of first matches, and of the best deal taken twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenyard.operators import deals, firsts, projection
from lumenyard.plans.registry import register
from lumenyard.sources.tables import table, variants

NOW = "1998-08-02 00:00:00"


def _snapshots(spark, sf) -> DataFrame:
    """Orders as verified readings of their customers' pages, with data in the forms that collectors give."""
    k = F.col("o_orderkey")
    form = lambda text: F.format_string(text, *[k.cast("string")] * text.count("%s"))
    due = F.date_format(F.date_add(F.lit("1998-01-01").cast("date"), (k % 400).cast("int")), "yyyy-MM-dd")
    data = (
        F.when(k % 6 == 0, F.concat(form('{"title": "Grant %s", "provider": "P", "funding_amount": %s, "currency": "usd", "coverage": ["tuition", " travel", "tuition", 7], "deadline": "'), due, F.lit('"}')))
        .when(k % 6 == 1, form('[{"name": " Fellow %s ", "organization": "Org", "amount": "$%s", "location": "x; y, x", "remote": "yes"}, {"name": "Fellow %s", "organization": "Org"}]'))
        .when(k % 6 == 2, form('{"title": "Grant %s", "provider": " "}'))
        .when(k % 6 == 3, form('{"title": "Call %s", "host": "H", "type": "Internship", "funding": {"amount": 5, "currency": "eur", "coverage": "travel"}, "apply_url": "https://x.test/%s", "status": "closed"}'))
        .when(k % 6 == 4, form('["text", {"title": "Scholarship %s", "provider": "P", "apply_url": "none", "summary": "fully funded", "deadline": "1990-01-01", "remote": false}]'))
        .otherwise(form('{"title": "Walk %s", "provider": "P"}'))
    )
    sensors = F.when(F.col("o_orderstatus") == "F", "two_sensors").when(F.col("o_orderstatus") == "O", "contract_only")
    return table(spark, sf, "orders").select(
        k,
        F.col("o_custkey").alias("collector_id"),
        F.format_string("https://a%d.test/p/%d", F.col("o_custkey"), k % 4).alias("url"),
        variants(data).alias("data"),
        F.col("o_orderdate").alias("verified_at"),
        sensors.alias("confirmed_by"),
    )


def _collectors(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("collector_id"),
        F.when(k % 50 == 7, "A Controlled Fixture").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 50 == 8, "localhost:80").otherwise(F.format_string("a%d.test", k)).alias("domain"),
        F.when(k % 2 == 1, 60 * 24 * 365 * 30).alias("fresh_minutes"),
    )


def _incidents(spark, sf) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        k.alias("incident_id"),
        F.col("user_id").alias("collector_id"),
        F.when(k % 3 > 0, F.format_string("https://a%d.test/p/%d", F.col("user_id"), k % 4)).alias("url"),
        F.col("ts").alias("created_at"),
        F.when(k % 2 == 1, F.col("ts")).alias("resolved_at"),
        (F.col("event_type") == "error").alias("quarantined"),
        F.concat(F.lit("on_"), F.col("event_type")).alias("verdict"),
        F.array(F.lit("price")).alias("fields"),
    )


_OPEN = "SELECT event_id, user_id, ts, CASE WHEN event_id % 3 > 0 THEN 'https://a' || user_id || '.test/p/' || event_id % 4 END AS url FROM events WHERE event_type = 'error' AND event_id % 2 = 0"
_FIRST = f"""SELECT o_orderkey, arg_min(i.event_id, (-epoch_us(i.ts), i.event_id)) AS incident_id
    FROM (SELECT *, 'https://a' || o_custkey || '.test/p/' || o_orderkey % 4 AS url FROM orders) o LEFT JOIN ({_OPEN}) i ON i.user_id = o.o_custkey AND (i.url IS NULL OR i.url = o.url) GROUP BY 1"""


@register("j06_first_open_incident", _FIRST)
def j06(spark, sf):
    """Of every reading the first open incident about its page or its whole collector."""
    rows = _snapshots(spark, sf).select("o_orderkey", "collector_id", "url")
    return firsts.first_open(rows, _incidents(spark, sf), []).select("o_orderkey", "incident_id")


_KIND = "o_orderkey % 6"


@register(
    "o01_opportunities",
    f"""SELECT o_custkey::VARCHAR AS source_id, 'https://a' || o_custkey || '.test/p/' || o_orderkey % 4 AS source_url,
    CASE {_KIND} WHEN 0 THEN 'Grant ' WHEN 1 THEN 'Fellow ' WHEN 3 THEN 'Call ' ELSE 'Scholarship ' END || o_orderkey AS title,
    CASE {_KIND} WHEN 1 THEN 'Org' WHEN 3 THEN 'H' ELSE 'P' END AS provider,
    CASE {_KIND} WHEN 0 THEN 'grant' WHEN 1 THEN 'fellowship' WHEN 3 THEN 'internship' ELSE 'scholarship' END AS type,
    CASE {_KIND} WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey WHEN 3 THEN 5 END::DOUBLE AS amount, CASE {_KIND} WHEN 0 THEN 'USD' WHEN 3 THEN 'EUR' END AS currency,
    CASE {_KIND} WHEN 0 THEN 'tuition,travel' WHEN 3 THEN 'travel' ELSE '' END AS coverage, CASE {_KIND} WHEN 1 THEN 'unspecified' WHEN 3 THEN 'partial' ELSE 'full' END AS funding,
    CASE {_KIND} WHEN 0 THEN DATE '1998-01-01' + (o_orderkey % 400)::INT WHEN 4 THEN DATE '1990-01-01' END AS deadline,
    CASE {_KIND} WHEN 0 THEN CASE WHEN DATE '1998-01-01' + (o_orderkey % 400)::INT < DATE '1998-08-01' THEN 'closed' ELSE 'open' END WHEN 1 THEN 'unknown' ELSE 'closed' END AS status,
    CASE {_KIND} WHEN 1 THEN 'x,y' ELSE '' END AS locations, CASE {_KIND} WHEN 1 THEN true WHEN 4 THEN false END AS remote,
    CASE {_KIND} WHEN 3 THEN 'https://x.test/' || o_orderkey ELSE 'https://a' || o_custkey || '.test/p/' || o_orderkey % 4 END AS application_url,
    CASE WHEN f.incident_id IS NOT NULL THEN 'quarantined' WHEN o_orderdate < TIMESTAMP '{NOW}' - to_days(CASE WHEN o_custkey % 2 = 1 THEN 365 * 30 ELSE 1 END) THEN 'stale' WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'partially_verified' END AS trust,
    f.incident_id::VARCHAR AS incident_id, CASE WHEN f.incident_id IS NULL THEN '' ELSE 'price' END AS disputed, CASE WHEN f.incident_id IS NOT NULL THEN 'on_error' END AS verdict
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN ({_FIRST}) f USING (o_orderkey) WHERE {_KIND} NOT IN (2, 5) AND c_custkey % 50 NOT IN (7, 8)""",
)
def o01(spark, sf):
    """Every reading's rows as opportunities, each once, with how far they are to be trusted."""
    rows = projection.from_snapshots(_snapshots(spark, sf), _collectors(spark, sf), _incidents(spark, sf), F.lit(NOW).cast("timestamp"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return projection.combined(rows).select(
        "source_id", "source_url", "title", "provider", "type", "amount", "currency", joined("coverage"), "funding", "deadline", "status", joined("locations"), "remote", "application_url", "trust", "incident_id", joined("disputed"), "verdict"
    )


_FIELDS = "CASE p_size % 5 WHEN 0 THEN ['input', 'closing', 'deadline_raw', 'apply_link'] WHEN 1 THEN ['input', 'note', 'Last_Date', 'closing', 'application_link'] WHEN 2 THEN ['title', 'apply_url', 'application_url', p_brand || '_deadline'] WHEN 3 THEN ['input', 'url', 'apply'] ELSE ['input_deadline', 'input', 'apply_by_url'] END"
_ALIGNED = lambda wanted, pattern: f"CASE WHEN list_contains(f, '{wanted}') THEN '{wanted}' ELSE [x FOR x IN f IF x <> 'input' AND regexp_matches(x, '{pattern}')][1] END"


@register("j22_aligned_fields", f"SELECT p_partkey, {_ALIGNED('deadline_raw', firsts.ALIKE['deadline_raw'])} AS deadline_raw, {_ALIGNED('application_url', firsts.ALIKE['application_url'])} AS application_url, CASE WHEN list_contains(f, 'title') THEN 'title' END AS title FROM (SELECT p_partkey, {_FIELDS} AS f FROM part)")
def j22(spark, sf):
    """The fields that three specs speak of, among those a schema has."""
    names = lambda *xs: F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    k = F.col("p_size") % 5
    fields = (
        F.when(k == 0, names("input", "closing", "deadline_raw", "apply_link"))
        .when(k == 1, names("input", "note", "Last_Date", "closing", "application_link"))
        .when(k == 2, names("title", "apply_url", "application_url", F.concat("p_brand", F.lit("_deadline"))))
        .when(k == 3, names("input", "url", "apply"))
        .otherwise(names("input_deadline", "input", "apply_by_url"))
    )
    return table(spark, sf, "part").withColumn("f", fields).select("p_partkey", *(firsts.aligned(w, F.col("f")).alias(w) for w in ("deadline_raw", "application_url", "title")))


_TERM = "CASE WHEN p_partkey % 10 = 3 THEN ' ' || upper(p_brand) WHEN p_partkey % 11 = 0 THEN 'no such part' ELSE substring(p_name, (p_partkey % 4)::INT + 1, (p_partkey % 9)::INT) END"


@register(
    "j23_first_named",
    f"SELECT p_partkey, CASE WHEN t <> '' THEN (SELECT min(q.p_partkey) FROM part q WHERE contains(lower(q.p_name), t) OR lower(q.p_brand) = t) END AS found FROM (SELECT p_partkey, lower(trim({_TERM})) AS t FROM part)",
)
def j23(spark, sf):
    """For a term made of every part the first part that it names."""
    parts, k = table(spark, sf, "part"), F.col("p_partkey")
    term = F.when(k % 10 == 3, F.concat(F.lit(" "), F.upper("p_brand"))).when(k % 11 == 0, "no such part").otherwise(F.substring("p_name", k.cast("int") % 4 + 1, k.cast("int") % 9))
    return firsts.find_named(parts.select("p_partkey", term.alias("term")), "term", parts, "p_name", "p_brand", "p_partkey").select("p_partkey", "found")


_OFFERS = """SELECT o_orderkey, o_custkey // 4 AS market, o_orderstatus, (o_orderkey % 97 - 3)::DOUBLE AS price,
    CASE o_custkey // 6 % 3 WHEN 0 THEN 'B ' || o_orderkey WHEN 1 THEN 'T ' || o_orderkey END AS title, CASE o_custkey // 6 % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN CASE WHEN o_custkey // 24 % 2 = 0 THEN 'GBP' END ELSE 'EUR' END AS currency FROM orders"""


@register(
    "v15_best_deal",
    f"""WITH o AS ({_OFFERS}), g AS (SELECT market, arg_min(o_orderkey, (price, o_orderkey)) FILTER (price > 0) AS naive, arg_min(o_orderkey, (price, o_orderkey)) FILTER (price > 0 AND o_orderstatus <> 'O') AS safe,
    count(DISTINCT coalesce(currency, 'unknown')) FILTER (price > 0 AND o_orderstatus <> 'O') AS n, string_agg(DISTINCT coalesce(currency, 'unknown'), ',' ORDER BY coalesce(currency, 'unknown')) FILTER (price > 0 AND o_orderstatus <> 'O') AS currencies FROM o GROUP BY 1)
    SELECT g.market, naive AS naive_order, a.title AS naive_title, a.price AS naive_price, CASE WHEN n <= 1 THEN safe END AS verified_order, CASE WHEN n <= 1 THEN b.price END AS verified_price, coalesce(currencies, '') AS currencies,
    naive IS DISTINCT FROM (CASE WHEN n <= 1 THEN safe END) AS diverged, CASE WHEN naive IS NOT DISTINCT FROM (CASE WHEN n <= 1 THEN safe END) THEN NULL WHEN n > 1 THEN 'no rate between currencies' WHEN safe IS NULL THEN 'nothing is stood behind' ELSE 'another value is stood behind' END AS reason
    FROM g LEFT JOIN o a ON a.o_orderkey = naive LEFT JOIN o b ON b.o_orderkey = safe""",
)
def v15(spark, sf):
    """The cheapest order of each market, by all readings and by those that are stood behind; fields are found by specs."""
    c, k = F.col("c_custkey"), F.col("o_orderkey").cast("string")
    kind = F.floor(c / 6) % 3
    customers = table(spark, sf, "customer").select(c.alias("collector_id"), kind.alias("kind"), F.when((kind == 1) & (F.floor(c / 24) % 2 == 0), "gbp").alias("hint"))
    spec = lambda o, path, of: F.struct(F.lit(o).alias("ord"), F.lit(path).alias("path"), F.lit(of).alias("kind"))
    specs = F.when(kind == 0, F.array(spec(0, "book_title", "text"), spec(1, "item.cost_excl_tax", "text"))).when(kind == 1, F.array(spec(0, "price_note", "text"), spec(1, "due", "money")))
    specs = table(spark, sf, "customer").select(c.alias("collector_id"), F.explode(specs).alias("s")).select("collector_id", "s.*")
    price = (F.col("o_orderkey") % 97 - 3).cast("string")
    own = F.col("kind")
    text = (
        F.when(own == 0, F.concat(F.lit('{"price": 1, "book_title": "B '), k, F.lit('", "item": {"cost_excl_tax": "£'), price, F.lit('"}}')))
        .when(own == 1, F.concat(F.lit('{"price_note": "9", "title": "T '), k, F.lit('", "due": '), price, F.lit("}")))
        .otherwise(F.concat(F.lit('{"title": 5, "price": "'), price, F.lit(' EUR"}')))
    )
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("collector_id"), "o_orderstatus")
    rows = orders.join(deals.deal_fields(customers, specs), "collector_id").withColumn("row", F.try_parse_json(text)).withColumn("market", F.floor(F.col("collector_id") / 4))
    offers = deals.candidates(rows).select("market", "o_orderkey", "o_orderstatus", "title", "price", "currency")
    found = deals.compare_deals(offers, offers.filter("o_orderstatus <> 'O'"), "market", "o_orderkey")
    return found.select(
        "market",
        F.col("naive.o_orderkey").alias("naive_order"),
        F.col("naive.title").alias("naive_title"),
        F.col("naive.price").alias("naive_price"),
        F.col("verified.o_orderkey").alias("verified_order"),
        F.col("verified.price").alias("verified_price"),
        F.array_join("currencies", ",").alias("currencies"),
        "diverged",
        "reason",
    )
