"""Queries of contracts, readings, verdicts, feeds and gates over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenyard.operators import contract, drafts, gate, markup, pages, serving, verdict
from lumenyard.operators.contract import Invariant
from lumenyard.plans.registry import register
from lumenyard.sources.tables import table

INVARIANTS = [
    Invariant("required", "o_orderpriority"),
    Invariant("range", "o_totalprice", low=1000, high=300000),
    Invariant("compare", "o_totalprice", op=">", other="o_custkey"),
    Invariant("enum", "o_orderstatus", allowed=("F", "O")),
    Invariant("unique", "o_orderkey"),
]
_STATUS = {
    "invariant:required:o_orderpriority": "CASE WHEN o_orderpriority IS NULL OR o_orderpriority = '' THEN 'fail' ELSE 'pass' END",
    "invariant:range:o_totalprice": "CASE WHEN o_totalprice IS NULL THEN 'unknown' WHEN o_totalprice BETWEEN 1000 AND 300000 THEN 'pass' ELSE 'fail' END",
    "invariant:compare:o_totalprice": "CASE WHEN o_totalprice IS NULL OR o_custkey IS NULL THEN 'unknown' WHEN o_totalprice > o_custkey THEN 'pass' ELSE 'fail' END",
    "invariant:enum:o_orderstatus": "CASE WHEN o_orderstatus IS NULL THEN 'unknown' WHEN o_orderstatus IN ('F', 'O') THEN 'pass' ELSE 'fail' END",
}
_CHECKS = " UNION ALL ".join(f"SELECT '{k}' AS check_id, {v} AS status, count(*) AS n FROM orders GROUP BY 2" for k, v in _STATUS.items())


@register("p16_invariants", _CHECKS + " UNION ALL SELECT 'invariant:unique:o_orderkey', CASE WHEN count(DISTINCT o_orderkey) / count(o_orderkey) >= 0.9 THEN 'pass' ELSE 'fail' END, count(*) FROM orders")
def p16(spark, sf):
    return contract.check_invariants(table(spark, sf, "orders"), INVARIANTS)


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@register("p19_host_invariant", f"SELECT CASE WHEN {_HOST} LIKE '%.example.net' THEN 'net' ELSE 'other' END AS zone, CASE WHEN {_HOST} = 'tionsh.example.net' THEN 'pass' ELSE 'fail' END AS status, count(*) AS n FROM pages GROUP BY 1, 2")
def p19(spark, sf):
    rows = table(spark, sf, "pages")
    status = contract.invariant_status(rows, Invariant("host", "url", host="tionsh.example.net"))
    zone = F.when(F.rlike(F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.lit("\\.example\\.net$")), "net").otherwise("other")
    return rows.groupBy(zone.alias("zone"), status.alias("status")).agg(F.count("*").alias("n"))


@register(
    "v01_validate",
    """WITH b AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus <> 'F'),
    h AS (SELECT count(*) runs, median(c) med FROM (SELECT count(*) c FROM b GROUP BY o_orderpriority)),
    q AS (SELECT least(0.95::DOUBLE, 1 - 5.0::DOUBLE / (runs + 4)) conf, med FROM h)
    SELECT 'structure:required:o_totalprice' AS check_id, 'o_totalprice' AS field, 'pass' AS status, 0.9::DOUBLE AS severity, conf AS confidence FROM q
    UNION ALL SELECT 'invariant:range:o_totalprice', 'o_totalprice', 'fail', 1.0, 1.0 FROM r WHERE o_totalprice NOT BETWEEN 1000 AND 300000 HAVING count(*) > 0
    UNION ALL SELECT 'learned:numeric:o_totalprice', 'o_totalprice', 'warn', 0.5, (SELECT conf FROM q) FROM r WHERE abs(o_totalprice - (SELECT median(o_totalprice) FROM b)) / (SELECT mad(o_totalprice) * 1.4826 FROM b) > 6 HAVING count(*) > 0
    UNION ALL SELECT 'learned:row_count', NULL, CASE WHEN 1 - (SELECT count(*) FROM r) / med > 0.5 THEN 'warn' ELSE 'pass' END, 0.6, conf FROM q""",
)
def v01(spark, sf):
    """Half of the orders teach a contract (priorities as runs); the open ones of the other half are checked."""
    orders = table(spark, sf, "orders")
    header, fields = contract.learn(orders.filter("o_orderkey % 2 = 0").select("o_orderpriority", "o_totalprice"), "o_orderpriority")
    run = orders.filter("o_orderkey % 2 = 1 and o_orderstatus <> 'F'").select("o_totalprice")
    return contract.validate(run, header, fields, [Invariant("range", "o_totalprice", low=1000, high=300000)])


@register("v02_learned_words", "SELECT 'learned:enum:p_type' AS check_id, 'p_type' AS path, count(*) AS offenders FROM part WHERE p_partkey % 2 = 1 AND p_type LIKE 'E%' HAVING count(*) > 0")
def v02(spark, sf):
    """Types of even parts, without one kind, are learned; odd parts show it."""
    rows = table(spark, sf, "part").select("p_partkey", "p_type")
    words = contract.vocabularies(rows.filter("p_partkey % 2 = 0 and p_type not like 'E%'").select("p_type"))
    run = rows.filter("p_partkey % 2 = 1").select("p_type")
    return contract.check_learned(run, contract.profile(run.limit(0)), words).filter("check_id like 'learned:enum:%'").select("check_id", "path", "offenders")


def _readings(spark, sf):
    """Orders as runs with two readings of price and status: the second is off for some, missing for others."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), "o_totalprice", "o_orderstatus")
    k = F.col("run_id") % 7
    price = F.round("o_totalprice").cast("bigint").cast("string")
    status = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "open").otherwise("partly")
    field = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("value"))
    collected = rows.select("run_id", F.explode(F.array(field("price", price), field("status", status))).alias("f")).select("run_id", "f.*")
    seen = F.when(k == 1, F.concat(price, F.lit("9"))).when(k == 2, None).otherwise(price)
    state = F.when(k == 3, "gone").when(k == 2, None).otherwise(F.upper(status))
    witnessed = rows.select("run_id", F.explode(F.array(field("price", seen), field("status", state))).alias("f")).select("run_id", "f.*", F.lit(0.85).alias("confidence")).filter("value is not null")
    specs = spark.createDataFrame([("price", None, False), ("status", None, False)], "path string, shape string, required_on_page boolean")
    return specs, collected, witnessed


@register(
    "v07_reconcile",
    """SELECT o_orderkey AS run_id, CASE o_orderkey % 7 WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 2 END::INT AS agreed, CASE WHEN o_orderkey % 7 IN (1, 3) THEN 1 ELSE 0 END::INT AS disagreed,
    CASE o_orderkey % 7 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS coverage, CASE WHEN o_orderkey % 7 IN (1, 3) THEN 0.85 ELSE 1.0 END::DOUBLE AS weakest FROM orders""",
)
def v07(spark, sf):
    found = verdict.summary(verdict.compare_fields(*_readings(spark, sf)))
    return found.select("run_id", F.size("agreed").alias("agreed"), F.size("disagreed").alias("disagreed"), "coverage", "weakest")


@register(
    "v09_classify",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 11 = 0 THEN 'explicit_failure' WHEN k IN (1, 3) AND (NOT warn OR (k = 1)) THEN 'extractor_drift' WHEN k = 3 THEN 'extractor_drift' WHEN NOT warn THEN 'healthy' WHEN k = 2 THEN 'inconclusive' ELSE 'genuine_source_change' END AS verdict
    FROM (SELECT o_orderkey, o_orderkey % 7 k, o_totalprice > 200000 warn FROM orders)""",
)
def v09(spark, sf):
    """Dear orders count as suspicious prices; every eleventh run failed outright."""
    found = verdict.summary(verdict.compare_fields(*_readings(spark, sf)))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 11 == 0).alias("explicit"), F.lit(False).alias("failed"), (F.col("o_totalprice") > 200000).alias("warned"))
    failing = F.when(F.col("warned"), F.array(F.lit("price"))).otherwise(F.array().cast("array<string>"))
    runs = runs.withColumns({"failing": failing, "check_coverage": F.lit(1.0), "departs": F.col("warned"), "aligned": F.lit(None).cast("boolean")})
    return verdict.classify(runs.join(found, "run_id")).select("run_id", "verdict")


@register("v08_captured_instead", "SELECT o_orderkey AS run_id, 'price' AS path, 'deposit' AS other FROM orders WHERE o_orderkey % 5 = 0")
def v08(spark, sf):
    """Every fifth run reports the deposit where the price should be: a selector that moved."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.round(F.col("o_totalprice") + 1000).cast("bigint").cast("string").alias("price"))
    field = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("value"))
    read = lambda price: rows.select("run_id", F.explode(F.array(field("price", price), field("deposit", F.lit("25")))).alias("f")).select("run_id", "f.*")
    collected = read(F.when(F.col("run_id") % 5 == 0, "25").otherwise(F.col("price")))
    witnessed = read(F.col("price")).withColumn("confidence", F.lit(0.85))
    specs = spark.createDataFrame([("price", None, False), ("deposit", None, False)], "path string, shape string, required_on_page boolean")
    return verdict.captured_instead(verdict.compare_fields(specs, collected, witnessed))


@register(
    "v13_feed",
    """WITH s AS (SELECT user_id, max(ts) verified_at, arg_max(value, (ts, event_id)) d FROM events WHERE event_type = 'purchase' GROUP BY 1),
    i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events WHERE event_type = 'error' AND event_id % 2 = 0)
    SELECT s.user_id AS user_id, CASE WHEN i.event_id IS NOT NULL THEN 'quarantined' WHEN verified_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR THEN 'stale' ELSE 'verified' END AS status,
    CASE WHEN i.event_id IS NOT NULL THEN 0.25 WHEN verified_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR THEN CASE WHEN s.user_id % 2 = 0 THEN 0.475 ELSE 0.3 END ELSE CASE WHEN s.user_id % 2 = 0 THEN 0.95 ELSE 0.6 END END::DOUBLE AS confidence,
    i.event_id AS incident_id, d AS data FROM s LEFT JOIN i ON i.user_id = s.user_id AND r = 1""",
)
def v13(spark, sf):
    """Purchases as verified values of users, every second error as an open incident."""
    events = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    bought = serving.latest(events.filter("event_type = 'purchase'").select("user_id", "at", "event_id", "value"), ["user_id"], F.col("at"), F.col("event_id"))
    by = F.when(F.col("user_id") % 2 == 0, "two_sensors").otherwise("contract_only")
    snapshots = bought.select(F.col("user_id").alias("collector_id"), F.lit("u").alias("url"), F.col("value").alias("data"), F.col("at").alias("verified_at"), by.alias("confirmed_by"))
    incidents = events.filter("event_type = 'error' and event_id % 2 = 0").select(F.col("event_id").alias("incident_id"), F.col("user_id").alias("collector_id"), F.lit(None).cast("string").alias("url"), F.lit("extractor_drift").alias("verdict"), F.lit(0.75).alias("confidence"), F.col("at").alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(True).alias("quarantined"))
    found = serving.feed(snapshots, incidents, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return found.select(F.col("collector_id").alias("user_id"), "status", "confidence", "incident_id", "data")


@register("s14_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def s14(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("v"))
    new = old.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("status"), F.lit(2).alias("v"))
    return serving.upsert(old, new, ["o_orderkey"], "v").select("o_orderkey", "status")


@register(
    "v11_gate",
    """SELECT s_suppkey AS "case", s_suppkey % 4 = 0 AS missing, s_suppkey % 4 NOT IN (0, 1) AS passed FROM supplier""",
)
def v11(spark, sf):
    """Suppliers as golden pages: a quarter was never run, a quarter reads a wrong balance."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case"), F.col("s_suppkey").cast("string").alias("url"), F.lit("balance").alias("path"), F.round(F.abs("s_acctbal") + 10).cast("bigint").cast("string").alias("value"))
    expected = rows.withColumn("shape", F.lit(None).cast("string"))
    got = rows.filter("case % 4 <> 0").select("url", "path", F.when(F.col("case") % 4 == 1, F.concat("value", F.lit("77"))).otherwise(F.col("value")).alias("value"))
    return gate.evaluate(expected, got).select("case", "missing", "passed")


@register(
    "a19_drift_score",
    """WITH m AS (SELECT 'quality' AS method, toxic = 1 fault, quality = 0 notice FROM labels UNION ALL SELECT 'silent', toxic = 1, false FROM labels)
    SELECT method, count(*) FILTER (fault AND notice) AS detected, count(*) FILTER (fault) AS faults, count(*) FILTER (NOT fault AND NOT notice) AS restrained, count(*) FILTER (NOT fault) AS calm, floor(100.0 * count(*) FILTER (fault = notice) / count(*) + 0.5)::BIGINT AS score FROM m GROUP BY 1""",
)
def a19(spark, sf):
    rows = table(spark, sf, "labels")
    a = rows.select(F.lit("quality").alias("method"), (F.col("toxic") == 1).alias("fault"), (F.col("quality") == 0).alias("notice"))
    b = rows.select(F.lit("silent").alias("method"), (F.col("toxic") == 1).alias("fault"), F.lit(False).alias("notice"))
    return gate.drift_score(a.unionByName(b))


@register("v03_extract", "SELECT o_orderkey, round(o_totalprice)::BIGINT::VARCHAR AS price, CASE o_orderkey % 3 WHEN 0 THEN 'labelled-line' WHEN 1 THEN 'table-row' ELSE 'heading-adjacent' END AS strategy FROM orders")
def v03(spark, sf):
    """Order prices written into small pages in three ways, and read back."""
    price = F.round("o_totalprice").cast("bigint").cast("string")
    k = F.col("o_orderkey") % 3
    body = F.when(k == 0, F.concat(F.lit("# Order\n\nDeposit: 5\n**Total price:** "), price)).when(k == 1, F.concat(F.lit("| Item | Value |\n| Deposit | 5 |\n| Total price | "), price, F.lit(" |"))).otherwise(F.concat(F.lit("# Deposit\n5\n## Total price\n\n"), price, F.lit("\n")))
    spec = pages.Field("price", ("Total price",), "number", exclude=("deposit",))
    read = pages.extract(body, F.lit("https://a.test/"), spec)
    return table(spark, sf, "orders").select("o_orderkey", read.alias("r")).select("o_orderkey", F.col("r.value").alias("price"), F.col("r.strategy").alias("strategy"))


@register("sc32_structured", "SELECT o_orderkey, o_orderdate::DATE AS deadline, 'USD' AS currency FROM orders")
def sc32(spark, sf):
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@type":"Event","registrationDeadline":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","offers":{"price":"9","priceCurrency":"USD"}}</script></html>'))
    return table(spark, sf, "orders").select("o_orderkey", markup.structured_facts(html).alias("f")).select("o_orderkey", "f.deadline", "f.currency")


@register("sc47_robots", "SELECT url, NOT regexp_matches(path, '^/(en|fr)/.*[05]') OR regexp_matches(path, '^/en/.*5\\.html') AS allowed FROM (SELECT DISTINCT url, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) path FROM pages WHERE url IS NOT NULL)")
def sc47(spark, sf):
    """One robots file for every origin: two folders barred for numbers with 0 or 5, one ending let through."""
    urls = table(spark, sf, "pages").filter("url is not null").select("url").distinct()
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/*0\nDisallow: /en/*5\nDisallow: /fr/*0 # zero\nDisallow: /fr/*5\nAllow: /en/*5.html\n"
    files = urls.select(F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("origin")).distinct().withColumn("text", F.lit(text))
    return pages.robots_allowed(urls, pages.robots_rules(files)).select("url", "allowed")


@register(
    "st08_recovered",
    """SELECT e.event_id AS incident_id, min(p.ts) AS resolved_at FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts WHERE e.event_type = 'error' GROUP BY 1""",
)
def st08(spark, sf):
    """Errors as incidents of users, closed by the user's next purchase."""
    events = table(spark, sf, "events")
    incidents = events.filter("event_type = 'error'").select(F.col("event_id").alias("incident_id"), F.col("user_id").alias("url"), F.col("ts").alias("created_at"))
    runs = events.select(F.col("user_id").alias("url"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("publishable"))
    return verdict.recovered(incidents, runs).select("incident_id", "resolved_at")


@register("v21_corroborated", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'text_only' WHEN 1 THEN 'confirmed' ELSE 'conflicting' END AS kind FROM orders")
def v21(spark, sf):
    k, price = F.col("o_orderkey") % 3, F.round(F.col("o_totalprice") + 1000).cast("bigint")
    fact = F.when(k == 1, F.concat(F.lit("$"), price)).when(k == 2, F.concat(F.lit("$"), price * 2))
    return table(spark, sf, "orders").select("o_orderkey", verdict.corroborated(price.cast("string"), fact).alias("kind"))


@register("sc38_alignment", "SELECT event_id, (event_id % 3 = 1)::INT + (event_id % 5 = 0)::INT AS differences FROM events")
def sc38(spark, sf):
    """Two contexts of each event: one in three seen from another country, one in five ten minutes later."""
    at = F.col("ts").cast("timestamp")
    side = lambda country, t: F.struct(F.lit("u").alias("url"), country.alias("country"), F.lit(None).cast("string").alias("locale"), F.lit("USD").alias("currency"), F.lit("desktop").alias("device"), F.array(F.lit("a")).alias("markers"), t.alias("observed_at"))
    other = F.when(F.col("event_id") % 3 == 1, "DE").otherwise("US")
    late = F.when(F.col("event_id") % 5 == 0, at + F.expr("interval 10 minutes")).otherwise(at)
    rows = table(spark, sf, "events").select("event_id", side(F.lit("US"), at).alias("a"), side(other, late).alias("b"))
    return rows.select("event_id", F.size(verdict.mismatches("a", "b")).alias("differences"))


@register("t11_due", "SELECT c_custkey AS collector_id FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey >= 12 ORDER BY c_nationkey DESC, c_custkey LIMIT 20")
def t11(spark, sf):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("collector_id"), F.timestamp_seconds(F.unix_timestamp(now) - F.col("c_nationkey") * 3600).alias("last_at"), F.lit(12 * 3600).alias("min_interval_s"), (F.col("c_custkey") % 2 == 0).alias("active"))
    return serving.due(rows, now, remaining=90, most=20).select("collector_id")


@register("v22_deadline_scan", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Deadline: ' || d WHEN 1 THEN d WHEN 2 THEN d || ' Applications close' END AS found FROM (SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') d FROM orders)")
def v22(spark, sf):
    """Closing dates written into pages in line, below, above, or as the date of something else."""
    d, k = F.date_format("o_orderdate", "d MMMM yyyy"), F.col("o_orderkey") % 4
    page = F.when(k == 0, F.concat(F.lit("# Call\n- **Deadline:** "), d)).when(k == 1, F.concat(F.lit("Closing date\n\n"), d)).when(k == 2, F.concat(d, F.lit("\nApplications close\n"))).otherwise(F.concat(F.lit("Results announced before "), d))
    return table(spark, sf, "orders").select("o_orderkey", drafts.scan_for_deadline(page).alias("found"))
