"""Queries of whole observations: many runs in one plan, from untyped rows to verdicts and a feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenyard.operators import gate, markup, observe, paths
from lumenyard.operators.stats import merged
from lumenyard.plans.registry import register
from lumenyard.sources.tables import table


def _observed(spark, sf):
    """Even orders teach what their priority's orders look like; odd ones are runs, most with a fault by their number.

    0 nothing came back, 1 an error, 2 a word for the price, 3 no price on either side, 4-9 a hundredfold price
    (4 on the page too, 5 not on the page, 6 seen from elsewhere, 7 not looked at, 8 hardly read, 9 another
    page), 10 a new status, 11 no fault.
    """
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("collector_id"),
        F.concat(F.lit("u"), F.col("o_custkey")).alias("url"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).alias("observed_at"),
        F.round("o_totalprice").cast("bigint").alias("p"),
        F.col("o_orderstatus").alias("s"),
        F.floor((F.col("o_orderkey") / 2) % 12).alias("k"),
    )
    k, runs = F.col("k"), ["run_id", "collector_id", "url", "observed_at"]
    price = F.when(k == 2, F.lit('"n/a"')).when(k == 3, "null").when(k.between(4, 9), (F.col("p") * 100).cast("string")).otherwise(F.col("p").cast("string"))
    status = F.when(k == 10, "X").otherwise(F.col("s"))
    body = F.when(k == 1, F.lit('{"error":"timeout"}')).otherwise(F.format_string('{"price":%s,"status":"%s"}', price, status))
    odd, even = orders.filter("run_id % 2 = 1"), orders.filter("run_id % 2 = 0").withColumn("k", F.lit(11))
    row = lambda df: df.filter("k <> 0").select("run_id", F.lit(0).alias("row_no"), F.parse_json(body).alias("row"))
    contracts = observe.learn(even.select(*runs), row(even))
    collectors = orders.select("collector_id").distinct().select(
        "collector_id",
        F.from_json(F.lit('[{"path":"price","required_on_page":true},{"path":"status","required_on_page":false}]'), observe.SPECS).alias("specs"),
        F.array(F.lit("price")).alias("protected"),
        F.from_json(F.lit('[{"kind":"range","field":"price","low":0}]'), observe.INVARIANTS).alias("invariants"),
        F.lit("US").alias("country"),
        F.lit("desktop").alias("device"),
    )
    sightings = odd.select("run_id", (k != 7).alias("fetched"), (k != 9).alias("same_page"), F.when(k == 6, "DE").otherwise("US").alias("country"), F.lit("unknown").alias("device"), F.col("observed_at").alias("fetched_at"))
    seen = F.when(k == 3, None).when(k == 4, (F.col("p") * 100).cast("string")).otherwise(F.col("p").cast("string"))
    sure = F.when(k == 8, 0.35).otherwise(0.85)
    field = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("value"), sure.alias("confidence"))
    readings = odd.select("run_id", F.explode(F.array(field("price", seen), field("status", status))).alias("r")).select("run_id", "r.*").filter("value is not null")
    rows = row(odd)
    return observe.observe(collectors, odd.select(*runs), rows, sightings, readings, contracts)


_OBSERVED = """base AS (SELECT o_orderpriority AS c, round(o_totalprice)::BIGINT AS p FROM orders WHERE o_orderkey % 2 = 0),
    learned AS (SELECT c, median(p) AS med, mad(p) * 1.4826 AS spread, least(0.95::DOUBLE, 1 - 5.0::DOUBLE / (count(*) + 4)) AS conf FROM base GROUP BY 1),
    runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS c, 'u' || o_custkey AS url, o_orderdate + to_seconds(o_orderkey % 86400) AS seen_at, (o_orderkey // 2) % 12 AS k,
    round(o_totalprice)::BIGINT * CASE WHEN (o_orderkey // 2) % 12 BETWEEN 4 AND 9 THEN 100 ELSE 1 END AS x FROM orders WHERE o_orderkey % 2 = 1),
    judged AS (SELECT runs.*, conf, k > 3 AND abs(x - med) / spread > 6 AS far FROM runs JOIN learned USING (c)),
    ruled AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'explicit_failure' WHEN k = 2 THEN 'extractor_drift' WHEN k IN (3, 10) THEN 'genuine_source_change' WHEN NOT far THEN 'healthy'
    WHEN k = 5 THEN 'extractor_drift' WHEN k = 6 THEN 'access_anomaly' WHEN k IN (7, 8, 9) THEN 'inconclusive' ELSE 'genuine_source_change' END AS verdict FROM judged),
    observed AS (SELECT *, verdict IN ('healthy', 'genuine_source_change') AND k <> 3 AS publishable FROM ruled)"""


@register(
    "v16_observe",
    f"""WITH {_OBSERVED}
    SELECT run_id, verdict, CASE verdict WHEN 'explicit_failure' THEN 1.0 WHEN 'healthy' THEN 1.0 WHEN 'genuine_source_change' THEN 0.8 WHEN 'extractor_drift' THEN 0.925 WHEN 'access_anomaly' THEN 0.7
    ELSE CASE WHEN k = 8 THEN 0.4 ELSE 0.0 END END::DOUBLE AS confidence, publishable,
    CASE WHEN verdict IN ('healthy', 'explicit_failure') THEN '' WHEN k = 10 THEN 'status' WHEN k = 6 THEN 'price' WHEN k = 9 OR k = 7 THEN 'price' ELSE 'price' END AS affected,
    CASE WHEN k = 0 THEN 'structure:empty_result' WHEN k = 1 THEN 'structure:collector_error' WHEN k = 2 THEN 'learned:type:price' WHEN k = 3 THEN 'structure:required:price' WHEN k = 10 THEN 'learned:enum:status' WHEN far THEN 'learned:numeric:price' END AS gravest
    FROM observed""",
)
def v16_observe(spark, sf):
    """Every odd order as a run: its verdict, what it is about, and the gravest of its failed checks."""
    found = _observed(spark, sf)
    return found.select("run_id", "verdict", F.col("verdict_confidence").alias("confidence"), "publishable", F.array_join("affected", ",").alias("affected"), F.get("worst.check_id", F.lit(0)).alias("gravest"))


@register(
    "p01_leaf_paths",
    """WITH r AS (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k, event_id % 3 AS n FROM events)
    SELECT event_type, path, kinds, sum(c)::BIGINT AS n FROM (
    SELECT event_type, 'own.k' AS path, CASE WHEN count(*) FILTER (k IS NULL) > 0 THEN 'null=' || count(*) FILTER (k IS NULL) || ',' ELSE '' END || 'number=' || count(k) AS kinds, count(*) AS c FROM r GROUP BY 1
    UNION ALL SELECT event_type, 'tags.[]', CASE WHEN count(*) FILTER (n = 0) > 0 THEN 'null=' || count(*) FILTER (n = 0) || ',' ELSE '' END || 'string=' || sum(n)::BIGINT, (sum(n) + count(*) FILTER (n = 0))::BIGINT FROM r GROUP BY 1
    UNION ALL SELECT event_type, 'value', 'number=' || count(*) FILTER (n <> 2) || ',string=' || count(*) FILTER (n = 2), count(*) FROM r GROUP BY 1)
    GROUP BY 1, 2, 3""",
)
def p01_leaf_paths(spark, sf):
    """Leaf paths of events written as nested rows: a number that is null at times, a list of tags, a value of two kinds."""
    n = F.col("event_id") % 3
    number = F.when(F.col("event_id") % 5 == 0, "null").otherwise(F.get_json_object("props", "$.k"))
    tags = F.when(n == 0, "").when(n == 1, '"a"').otherwise('"a","b"')
    value = F.when(n == 2, F.lit('"none"')).otherwise(F.lit("1.5"))
    rows = table(spark, sf, "events").select("event_type", F.parse_json(F.format_string('{"own":{"k":%s},"tags":[%s],"value":%s,"empty":{}}', number, tags, value)).alias("row"))
    found = paths.leaf_paths(rows, "row", ["event_type"])
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("event_type", "path", kinds.alias("kinds"), "n")


@register(
    "v02_learned_types",
    """SELECT o_orderpriority AS collector_id, 'learned:type:price' AS check_id, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 10 = 5 GROUP BY 1
    UNION ALL SELECT o_orderpriority, 'learned:type:status', count(*) FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 10 = 7 GROUP BY 1""",
)
def v02_learned_types(spark, sf):
    """Prices are numbers or null and statuses words in the even orders; some odd ones have it the other way round.

    A null is of no kind, so it is never new.
    """
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("collector_id"), F.lit("u").alias("url"), F.col("o_orderdate").alias("observed_at"))
    k = F.col("run_id") % 10
    body = F.format_string('{"price":%s,"status":%s}', F.when(k == 5, F.lit('"12 or so"')).when(k.isin(4, 9), "null").otherwise("12"), F.when(k == 7, "true").otherwise(F.lit('"open"')))
    rows = lambda df: df.select("run_id", F.lit(0).alias("row_no"), F.parse_json(body).alias("row"))
    even, odd = orders.filter("run_id % 2 = 0"), orders.filter("run_id % 2 = 1")
    collectors = orders.select("collector_id").distinct().withColumn("invariants", F.array().cast(observe.INVARIANTS))
    found = observe.checks(collectors, odd, rows(odd), observe.learn(even, rows(even))).filter("check_id like 'learned:type:%'")
    return merged(found, odd, "run_id").groupBy("collector_id", "check_id").agg(F.sum("n").alias("n"))


@register(
    "v11_repairs",
    """SELECT o_orderkey AS repair_id, k = 0 AS approved, CASE k WHEN 0 THEN '' WHEN 1 THEN 'incident: wrong price' WHEN 2 THEN 'anchor: followed the decoy: reads a position' WHEN 3 THEN 'anchor: was never run'
    WHEN 4 THEN 'regression: fails structure:required:status|regression: wrong status' WHEN 5 THEN 'incident: fails structure:required:price|incident: protected price is missing|incident: wrong price'
    WHEN 6 THEN 'incident: fails structure:collector_error|incident: fails structure:required:day|incident: fails structure:required:price|incident: fails structure:required:status|incident: protected price is missing|incident: timeout'
    WHEN 7 THEN 'anchor: did not give the token: not shown to read the label' END AS reasons FROM (SELECT o_orderkey, (o_orderkey // 2) % 8 AS k FROM orders WHERE o_orderkey % 2 = 1)""",
)
def v11_repairs(spark, sf):
    """Every odd order as a repair of its priority's collector, tried on the incident, an anchor and a regression page.

    Day and status are pinned; by its number a candidate gives a wrong price, follows the anchor's decoy, never
    ran there, drops a field on the regression page, drops the protected one, fails, or reads another thing.
    """
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("collector_id"), F.lit("u").alias("url"), F.col("o_orderdate").alias("observed_at"), F.floor((F.col("o_orderkey") / 2) % 8).alias("k"), F.round(F.col("o_totalprice") + 1000).cast("bigint").alias("p"), F.date_format("o_orderdate", "d MMMM yyyy").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    even, odd, k = orders.filter("run_id % 2 = 0"), orders.filter("run_id % 2 = 1").withColumnRenamed("run_id", "repair_id"), F.col("k")
    row = lambda price, status, day: F.parse_json(F.format_string('{"price":%s,"status":%s,"day":"%s"}', price, status, day))
    word = F.lit('"open"')
    contracts = observe.learn(even.select("run_id", "collector_id", "url", "observed_at"), even.select("run_id", F.lit(0).alias("row_no"), row(F.col("p").cast("string"), word, F.col("iso")).alias("row")))
    collectors = orders.select("collector_id").distinct().select("collector_id", F.from_json(F.lit('[{"path":"day","shape":"date"}]'), observe.SPECS).alias("specs"), F.array(F.lit("price")).alias("protected"), F.array().cast(observe.INVARIANTS).alias("invariants"))
    case = lambda label, url: F.struct(F.lit(label).alias("label"), F.lit(label).alias("kind"), F.lit(url).alias("url"))
    cases = odd.select("repair_id", F.explode(F.array(case("incident", "i"), case("anchor", "a"), case("regression", "r"))).alias("c")).select("repair_id", "c.*")
    pin = lambda label, path, value, decoy: F.struct(F.lit(label).alias("label"), F.lit(path).alias("path"), value.cast("string").alias("value"), decoy.cast("string").alias("decoy"))
    none = F.lit(None)
    expected = odd.select("repair_id", F.explode(F.array(pin("incident", "price", F.col("p"), none), pin("incident", "day", F.col("iso"), none), pin("anchor", "price", F.lit(777), F.col("p")), pin("regression", "status", F.lit("open"), none), pin("regression", "day", F.col("iso"), none))).alias("e")).select("repair_id", "e.*")
    page = lambda url, body: F.struct(F.lit(url).alias("url"), F.lit(0).alias("row_no"), body.alias("row"))
    price = F.when(k == 1, (F.col("p") * 3).cast("string")).when(k == 5, "null").otherwise(F.col("p").cast("string"))
    incident = F.when(k == 6, F.parse_json(F.lit('{"error":"timeout"}'))).otherwise(row(price, word, F.col("day")))
    anchor = row(F.when(k == 2, F.col("p").cast("string")).when(k == 7, "5").otherwise("777"), word, F.col("day"))
    regression = row(F.col("p").cast("string"), F.when(k == 4, "null").otherwise(word), F.col("day"))
    rows = odd.select("repair_id", "k", F.explode(F.array(page("i", incident), page("a", anchor), page("r", regression))).alias("r")).select("repair_id", "k", "r.*").filter("not (k = 3 and url = 'a')").drop("k")
    given = gate.Repairs(odd.select("repair_id", "collector_id"), cases, expected, rows.select("repair_id", "url"), rows)
    return gate.judge_repairs(given, collectors, contracts).select("repair_id", "approved", F.array_join("reasons", "|").alias("reasons"))


@register(
    "v24_notices",
    """WITH c AS (SELECT o_orderkey % 6 AS k, round(o_totalprice + 1000)::BIGINT AS p FROM orders),
    m AS (SELECT 'conventional' AS method, k IN (2, 3, 4, 5) AS fault, k IN (3, 5) AS notice FROM c UNION ALL SELECT 'monitor', k IN (2, 3, 4, 5), k <> 0 FROM c UNION ALL SELECT 'two_sensors', k IN (2, 3, 4, 5), k IN (2, 3, 4, 5) FROM c)
    SELECT method, count(*) FILTER (fault AND notice) AS detected, count(*) FILTER (fault) AS faults, count(*) FILTER (NOT fault AND NOT notice) AS restrained, count(*) FILTER (NOT fault) AS calm, floor(100.0 * count(*) FILTER (fault = notice) / count(*) + 0.5)::BIGINT AS score FROM m GROUP BY 1""",
)
def v24_notices(spark, sf):
    """Order prices as pages: as known, really changed, a wrong element, a zero, a foreign price, and gone; who notices what."""
    k, p = F.col("o_orderkey") % 6, F.round(F.col("o_totalprice") + 1000).cast("bigint")
    text = lambda v: F.concat(F.lit("$"), v.cast("string"))
    shown = F.when(k == 1, text(p * 2)).otherwise(text(p))
    read = F.when(k == 2, text(F.lit(25))).when(k == 3, "0").when(k == 4, text(p * 3)).when(k == 5, None).otherwise(shown)
    rows = table(spark, sf, "orders").select(F.lit(True).alias("number"), p.cast("string").alias("known"), read.alias("collector"), shown.alias("witness"), k.between(2, 5).alias("fault"))
    return gate.drift_score(gate.notices(rows))


@register(
    "h06_markup",
    """SELECT o_orderkey, CASE WHEN k = 3 THEN NULL ELSE o_orderdate::DATE END AS deadline, CASE k WHEN 0 THEN 'registrationDeadline' WHEN 1 THEN 'validThrough' WHEN 2 THEN 'endDate' END AS field, CASE WHEN k IN (0, 1) THEN round(o_totalprice + 1000)::DOUBLE END AS amount,
    CASE WHEN k = 1 THEN 'INR' WHEN k = 0 THEN 'USD' END AS currency, CASE k WHEN 0 THEN 'An event' WHEN 1 THEN 'A course' WHEN 2 THEN 'A job' ELSE 'By a meta tag' END AS title, CASE WHEN k = 0 THEN 'A body' WHEN k = 2 THEN 'A firm' END AS provider,
    CASE k WHEN 0 THEN 'Event,Organization,Offer' WHEN 1 THEN 'WebPage,Course,Offer' WHEN 2 THEN 'JobPosting,Thing,Organization' ELSE '' END AS types, CASE WHEN k = 3 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'extractor_drift' ELSE 'healthy' END AS verdict
    FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""",
)
def h06_markup(spark, sf):
    """Orders as pages that declare an event, a course deep in a graph, a job beside a broken block, or only a meta tag.

    The text gives the same day in other words, or for every third order another one.
    """
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.round(F.col("o_totalprice") + 1000).cast("bigint").cast("string")
    block = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    event = F.format_string('{"@type":"Event","name":" An \\n event","organizer":{"@type":"Organization","name":"A body"},"startDate":"1990-01-01","endDate":"1991-01-01","registrationDeadline":"%s","offers":{"@type":"Offer","price":"%s","priceCurrency":"USD"}}', day, price)
    course = F.format_string('{"@graph":[{"@type":"WebPage","mainEntity":{"@type":"Course","headline":"A course","offers":{"@type":"Offer","price":%s,"priceCurrency":"INR"},"validThrough":"%sT10:00:00Z"}}]}', price, day)
    job = F.format_string('[{"@type":["JobPosting","Thing"],"name":"A job","validThrough":"soon","hiringOrganization":{"@type":"Organization","name":"A firm"},"endDate":"%s"}]', day)
    meta = F.lit('<html><head><meta property="og:title" content="By a meta tag"></head><body>no block at all</body></html>')
    html = F.when(k == 0, block(event)).when(k == 1, block(course)).when(k == 2, F.concat(block(F.lit("{ not json }")), block(job))).otherwise(meta)
    said = F.when(F.col("o_orderkey") % 3 == 0, F.lit("3 March 2003")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    rows = table(spark, sf, "orders").select("o_orderkey", said.alias("said"), markup.structured_facts(html).alias("f"))
    found = markup.adjudicated(rows, "said", "f")
    return found.select("o_orderkey", "f.deadline", F.col("f.deadline_field").alias("field"), "f.amount", "f.currency", "f.title", "f.provider", F.array_join("f.types", ",").alias("types"), F.col("ruling.verdict").alias("verdict"))
