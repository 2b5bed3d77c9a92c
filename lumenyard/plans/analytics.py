"""Queries of statistics, joins, windows, sorts and sets over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenyard.functions.numbers import near
from lumenyard.functions.text import alnum_key, character_shape
from lumenyard.functions.urls import host
from lumenyard.operators import contract, ranking, serving, stats
from lumenyard.plans.registry import register
from lumenyard.sources.tables import table

Z = 1.25


@register("a01_median", "SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1")
def a01(spark, sf):
    counts = stats.counted(table(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"))
    return stats.quantiles(counts, ["l_returnflag"], {"med": 0.5}, few=True).select("l_returnflag", "med")


@register("a02_mad", "SELECT l_returnflag, count(*) AS n, median(l_extendedprice) AS med, mad(l_extendedprice) * 1.4826 AS mad FROM lineitem GROUP BY 1")
def a02(spark, sf):
    return stats.centre_and_spread(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", few=True)


@register("a03_quantiles", "SELECT l_shipmode_key, quantile_cont(l_quantity, 0.05) AS p05, quantile_cont(l_quantity, 0.95) AS p95 FROM (SELECT l_linenumber AS l_shipmode_key, l_quantity FROM lineitem) GROUP BY 1")
def a03(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "l_shipmode_key")
    return stats.quantiles(stats.counted(rows, ["l_shipmode_key"], F.col("l_quantity")), ["l_shipmode_key"], {"p05": 0.05, "p95": 0.95}, few=True).drop("n")


@register(
    "a04_robust_z",
    f"""WITH m AS (SELECT l_returnflag f, median(l_extendedprice) med, mad(l_extendedprice) * 1.4826 mad FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_returnflag, floor(abs(l_extendedprice - med) / mad * 1000 + 0.5) / 1000 AS z
    FROM lineitem JOIN m ON f = l_returnflag WHERE abs(l_extendedprice - med) / mad > {Z}""",
)
def a04(spark, sf):
    """Lines whose price departs from what their return flag's lines have learned."""
    found = stats.departures(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", Z)
    return found.select("l_orderkey", "l_linenumber", "l_returnflag", (F.floor(F.col("z") * 1000 + 0.5) / 1000).alias("z"))


@register("a05_sample_confidence", "SELECT c_nationkey, CASE WHEN count(*) <= 1 THEN 0.0::DOUBLE ELSE least(0.95::DOUBLE, 1 - 5.0::DOUBLE / (count(*) + 4)) END AS confidence FROM customer GROUP BY 1")
def a05(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(stats.sample_confidence(F.count("*")).alias("confidence"))


_COLUMNS = [("o_orderkey", 1), ("o_custkey", 1), ("o_orderstatus", 0), ("o_totalprice", 1), ("o_orderpriority", 0)]
_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS path, count(*) AS n, count({c}) AS present, count(DISTINCT {c}) AS \"distinct\", "
    + (f"median({c})::DOUBLE AS med, mad({c}::DOUBLE) * 1.4826 AS mad, quantile_cont({c}::DOUBLE, 0.05) AS p05, quantile_cont({c}::DOUBLE, 0.95) AS p95, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high" if num else "NULL::DOUBLE AS med, NULL::DOUBLE AS mad, NULL::DOUBLE AS p05, NULL::DOUBLE AS p95, NULL::DOUBLE AS low, NULL::DOUBLE AS high")
    + " FROM orders"
    for c, num in _COLUMNS
    if c != "o_orderpriority"
)


@register("a06_profile", _PROFILE)
def a06(spark, sf):
    rows = table(spark, sf, "orders").select(*(c for c, _ in _COLUMNS if c != "o_orderpriority"))
    return contract.profile(rows).select("path", "n", "present", "distinct", "med", "mad", "p05", "p95", "low", "high")


@register("a07_contract_header", "WITH s AS (SELECT o_orderpriority, count(*) c FROM orders GROUP BY 1) SELECT count(*) AS runs, median(c) AS rows_med, min(c) AS rows_min, least(0.95::DOUBLE, 1 - 5.0::DOUBLE / (count(*) + 4)) AS confidence FROM s")
def a07(spark, sf):
    return contract.learn(table(spark, sf, "orders"), "o_orderpriority", ["o_totalprice"])[0]


@register("a09_unique_ratio", "SELECT count(DISTINCT o_custkey) / count(o_custkey)::DOUBLE AS ratio FROM orders")
def a09(spark, sf):
    return table(spark, sf, "orders").agg(stats.unique_ratio(F.col("o_custkey")).alias("ratio"))


@register("a10_presence", "SELECT event_type, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate FROM events GROUP BY 1")
def a10(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.avg(F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0)).alias("rate"))


@register(
    "a11_weighted_checks",
    """WITH c AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'warn' WHEN 'view' THEN 'pass' ELSE 'unknown' END status FROM events)
    SELECT user_id, coalesce(sum(CASE WHEN status IN ('fail', 'warn') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) FILTER (status <> 'unknown') / nullif(count(*) FILTER (status <> 'unknown'), 0), 0.0::DOUBLE) AS failure,
    (count(*) FILTER (status <> 'unknown')) / count(*)::DOUBLE AS coverage FROM c GROUP BY 1""",
)
def a11(spark, sf):
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "warn").when(F.col("event_type") == "view", "pass").otherwise("unknown")
    checks = table(spark, sf, "events").select("user_id", status.alias("status"), F.lit(0.5).alias("severity"), F.lit(0.5).alias("confidence"))
    return contract.weighted(checks, ["user_id"])


@register(
    "a13_impact",
    """WITH r AS (SELECT event_id run_id, coalesce(value > 50, false) caught FROM events),
    i AS (SELECT event_id run_id, CASE event_type WHEN 'error' THEN 'extractor_drift' WHEN 'click' THEN 'genuine_source_change' WHEN 'view' THEN 'healthy' ELSE 'inconclusive' END verdict, 1 + event_id % 2 n FROM events WHERE event_id % 3 = 0)
    SELECT (SELECT count(*) FROM i WHERE verdict <> 'healthy') AS incidents, (SELECT coalesce(sum(n), 0)::BIGINT FROM i WHERE verdict = 'extractor_drift') AS withheld,
    (SELECT coalesce(sum(n), 0)::BIGINT FROM i JOIN r USING (run_id) WHERE verdict = 'extractor_drift' AND NOT caught) AS silent,
    (SELECT count(*) FROM i WHERE verdict = 'genuine_source_change') AS restrained, (SELECT count(*) FROM i WHERE verdict = 'inconclusive') AS quarantined,
    (SELECT count(*) FROM r) AS runs, (SELECT count(*) FROM r WHERE run_id NOT IN (SELECT run_id FROM i WHERE verdict <> 'healthy')) AS published""",
)
def a13(spark, sf):
    events = table(spark, sf, "events")
    runs = events.select(F.col("event_id").alias("run_id"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("caught"))
    verdict = F.when(F.col("event_type") == "error", "extractor_drift").when(F.col("event_type") == "click", "genuine_source_change").when(F.col("event_type") == "view", "healthy").otherwise("inconclusive")
    fields = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    found = serving.impact(runs, events.filter("event_id % 3 = 0").select(F.col("event_id").alias("run_id"), verdict.alias("verdict"), fields.alias("fields")))
    return found.select("incidents", F.col("withheld").cast("bigint").alias("withheld"), F.col("silent").cast("bigint").alias("silent"), "restrained", "quarantined", "runs", "published")


@register("a14_month_spend", "SELECT date_trunc('month', o_orderdate)::DATE AS month, 2 * count(*) AS spent, greatest(0, 4000 - 2 * count(*)) AS remaining, 2 * count(*) >= 4000 AS exhausted FROM orders GROUP BY 1")
def a14(spark, sf):
    return serving.month_spend(table(spark, sf, "orders"), "o_orderdate")


@register("a16_index_stats", "SELECT count(*) AS total, count(DISTINCT source) AS hosts, count(*) FILTER (text LIKE '%license%') AS with_license, max(n_chars) AS longest FROM documents")
def a16(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("total"), F.count_distinct("source").alias("hosts"), F.count_if(F.contains("text", F.lit("license"))).alias("with_license"), F.max("n_chars").alias("longest"))


_SHAPE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[0-9]', 'd', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '\\s', '_', 'g')"


@register("a17_shape_histogram", f"SELECT substring({_SHAPE.format('p_type')}, 1, 40) AS shape, count(*) AS n FROM part GROUP BY 1")
def a17(spark, sf):
    return table(spark, sf, "part").groupBy(character_shape(F.col("p_type")).alias("shape")).agg(F.count("*").alias("n"))


@register("a18_outcome_counts", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in ("signup", "error", "click", "view", "purchase")) + " FROM events GROUP BY 1")
def a18(spark, sf):
    kinds = ("signup", "error", "click", "view", "purchase")
    return table(spark, sf, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == e).alias(e) for e in kinds))


_OFFER = "SELECT p_brand, p_partkey, p_retailprice, p_size % 2 AS cur FROM part WHERE p_retailprice > 0"


@register("a20_argmin", f"SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) r FROM ({_OFFER})) WHERE r = 1")
def a20(spark, sf):
    rows = table(spark, sf, "part").withColumn("cur", F.lit("USD"))
    return serving.best_offer(rows, ["p_brand"], "p_retailprice", "cur", "p_partkey").select("p_brand", "best.p_partkey", "best.p_retailprice")


@register(
    "a21_guarded_argmin",
    f"""WITH o AS ({_OFFER}), b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) r FROM o)
    SELECT p_brand, CASE WHEN k <= 1 THEN p_partkey END AS p_partkey, k AS currencies FROM b JOIN (SELECT p_brand, count(DISTINCT cur) k FROM o GROUP BY 1) USING (p_brand) WHERE r = 1""",
)
def a21(spark, sf):
    rows = table(spark, sf, "part").withColumn("cur", F.col("p_size") % 2)
    return serving.best_offer(rows, ["p_brand"], "p_retailprice", "cur", "p_partkey").select("p_brand", "best.p_partkey", "currencies")


_WORDS = "list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))"


@register(
    "a28_jaccard",
    f"""WITH d AS (SELECT turn, conv_id, {_WORDS} w FROM conversations WHERE text IS NOT NULL)
    SELECT a.conv_id AS conv_id, a.turn AS turn, floor(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE * 10000 + 0.5) / 10000 AS overlap
    FROM d a JOIN d b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def a28(spark, sf):
    """How far each turn of a conversation shares its words with the next."""
    rows = table(spark, sf, "conversations").filter("text is not null").select("conv_id", "turn", F.array_distinct(F.split(alnum_key(F.col("text")), " ")).alias("w"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    overlap = stats.jaccard(F.col("w"), F.col("v"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", (F.floor(overlap * 10000 + 0.5) / 10000).alias("overlap"))


@register("a29_row_drop", "WITH s AS (SELECT o_orderpriority, count(*) c FROM orders GROUP BY 1), m AS (SELECT median(c) med FROM s) SELECT o_orderpriority, floor((1 - c / med) * 10000 + 0.5) / 10000 AS fell FROM s, m")
def a29(spark, sf):
    sizes = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("c"))
    med = sizes.agg(F.median("c").alias("med"))  # one row
    return sizes.join(F.broadcast(med)).select("o_orderpriority", (F.floor((1 - F.col("c") / F.col("med")) * 10000 + 0.5) / 10000).alias("fell"))


@register("j01_inner", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j01(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@register("j02_left", "SELECT c_custkey, count(o_orderkey) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j02(spark, sf):
    """Sums before the join: one row a customer is shuffled, not all orders."""
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    return table(spark, sf, "customer").select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.col("spent").cast("double").alias("spent"))


@register(
    "j05_theta_self",
    "SELECT a.l_orderkey AS l_orderkey, a.l_linenumber AS one, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE abs(a.l_extendedprice - b.l_extendedprice) / greatest(abs(a.l_extendedprice), abs(b.l_extendedprice), 1) <= 0.005",
)
def j05(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    other = rows.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("l_extendedprice").alias("p"))
    both = rows.join(other, "l_orderkey").filter((F.col("l_linenumber") < F.col("other")) & near(F.col("l_extendedprice"), F.col("p")))
    return both.select("l_orderkey", F.col("l_linenumber").alias("one"), "other")


@register(
    "j08_asof",
    """WITH o AS (SELECT o_custkey user_id, o_orderdate ts, o_orderkey FROM orders), l AS (SELECT e.event_id, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY o.ts DESC, o.o_orderkey DESC) r FROM events e JOIN o ON o.user_id = e.user_id AND o.ts <= e.ts)
    SELECT e.event_id AS event_id, l.o_orderkey AS o_orderkey FROM events e LEFT JOIN l ON l.event_id = e.event_id AND r = 1""",
)
def j08(spark, sf):
    """Of every event the user's last order until then: one sorted union, a running last value, no join of all pairs."""
    events = table(spark, sf, "events").select("user_id", "ts", F.col("event_id"), F.lit(None).cast("bigint").alias("o_orderkey"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.lit(None).cast("bigint").alias("event_id"), "o_orderkey")
    window = Window.partitionBy("user_id").orderBy("ts", F.col("o_orderkey").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = orders.unionByName(events).withColumn("last", F.last("o_orderkey", ignorenulls=True).over(window))
    return seen.filter("event_id is not null").select("event_id", F.col("last").alias("o_orderkey"))


@register(
    "j13_contains",
    "SELECT d.doc_id AS doc_id, w.p AS phrase FROM documents d, (VALUES ('mit license'), ('apache license'), ('token'), ('public')) w(p) WHERE contains(lower(d.text), w.p)",
)
def j13(spark, sf):
    """A few phrases against all texts, as an expression over the texts and not as a join."""
    phrases = ["mit license", "apache license", "token", "public"]
    low = F.lower("text")
    hits = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p)), p) for p in phrases)))
    return table(spark, sf, "documents").select("doc_id", F.explode(hits).alias("phrase"))


@register("j14_full", "SELECT coalesce(c_nationkey, s_nationkey)::INT AS nationkey, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey")
def j14(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nationkey", "full")


@register("j15_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 350000)")
def j15(spark, sf):
    dear = table(spark, sf, "orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(dear, "c_custkey", "left_anti")


@register("j18_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j18(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_semi")


@register(
    "j19_interval",
    "SELECT a.event_id AS clicked, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch(a.ts) - epoch(b.ts)) <= 300",
)
def j19(spark, sf):
    """Pairs within 300 s: rows meet in buckets of that length and their neighbours, not all of a user's rows with each other."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    bucket = F.floor(F.col("at") / 300)
    a = rows.filter("event_type = 'click'").select(F.col("event_id").alias("clicked"), "user_id", F.col("at").alias("x"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    b = rows.filter("event_type = 'purchase'").select(F.col("event_id").alias("bought"), "user_id", F.col("at").alias("y"), bucket.alias("b"))
    return a.join(b, ["user_id", "b"]).filter(F.abs(F.col("x") - F.col("y")) <= 300).select("clicked", "bought")


@register(
    "w01_dedup",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(substring(text, 1, 40)), '[^a-z0-9]+', ' ', 'g')), lang ORDER BY n_chars DESC, doc_id) r FROM documents) WHERE r = 1",
)
def w01(spark, sf):
    key = alnum_key(F.substring("text", 1, 40))
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", key.alias("key"), "lang")
    return ranking.keep_first(rows, [F.col("key"), F.col("lang")], -F.col("n_chars"), F.col("doc_id")).select("doc_id")


_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '')"


@register(
    "w02_round_robin",
    f"WITH h AS (SELECT page_id, {_HOST} host FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) turn FROM h) SELECT page_id, host, turn FROM (SELECT *, row_number() OVER (ORDER BY turn, host, page_id) k FROM r WHERE turn <= 5) WHERE k <= 60",
)
def w02(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", host(F.col("url")).alias("host"))
    return ranking.round_robin(rows, "host", 5, 60, F.col("page_id")).select("page_id", "host", F.col("turn").cast("bigint").alias("turn"))


@register(
    "w04_merge_results",
    f"""WITH b AS (SELECT page_id % 4 batch, (page_id / 4)::BIGINT pos, url, {_HOST} host, {_HOST} LIKE '%.example.org' official FROM (SELECT * FROM pages WHERE url IS NOT NULL)),
    p AS (SELECT batch, page_id_pos pos, url, host, official FROM (SELECT *, pos page_id_pos FROM b)),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos, batch) k FROM p) WHERE k = 1),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY pos, batch) oh FROM u) WHERE oh <= CASE WHEN official THEN 5 ELSE 2 END),
    n AS (SELECT *, row_number() OVER (PARTITION BY official ORDER BY pos, batch) nth FROM h),
    t AS (SELECT *, CASE WHEN official AND nth <= 8 THEN 0 WHEN NOT official THEN 1 ELSE 2 END turn FROM n WHERE nth <= 12)
    SELECT url, host, official FROM (SELECT *, row_number() OVER (ORDER BY turn, pos, batch) z FROM t) WHERE z <= 12""",
)
def w04(spark, sf):
    """Positions are rounded half to even, as DuckDB casts, so two of a batch may share one; the smaller page_id goes first."""
    own = F.coalesce(host(F.col("url")), F.lit(""))
    rows = table(spark, sf, "pages").filter("url is not null").select("page_id", (F.col("page_id") % 4).alias("batch"), F.bround(F.col("page_id") / 4).cast("bigint").alias("pos"), "url", own.alias("host"), F.endswith(own, F.lit(".example.org")).alias("official"))
    return ranking.merge_results(rows, ties=("page_id",)).select("url", "host", "official")


@register("w05_last_n", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r <= 5")
def w05(spark, sf):
    return ranking.last_n(table(spark, sf, "events"), "user_id", 5, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


_EDGES = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view")]


@register(
    "w07_transitions",
    "WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) was FROM events) SELECT user_id, count(*) AS illegal FROM l WHERE was IS NOT NULL AND (was, event_type) NOT IN ("
    + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES)
    + ") GROUP BY 1",
)
def w07(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return serving.illegal_transitions(rows, "user_id", "event_type", ["ts", "event_id"], _EDGES).groupBy("user_id").agg(F.count("*").alias("illegal"))


@register("w09_previous_verified", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reference FROM events")
def w09(spark, sf):
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(before).alias("reference"))


@register("w12_first_seen", "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_seen FROM events GROUP BY 1, 2")
def w12(spark, sf):
    """An index built in two batches, merged: first sight kept, last raised, counts added."""
    rows = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").alias("seen_at"), "value", (F.col("event_id") % 2).alias("half"))
    first, second = rows.filter("half = 0").drop("half"), rows.filter("half = 1").drop("half")
    empty = first.limit(0).withColumns({"first_seen": F.col("seen_at"), "last_seen": F.col("seen_at"), "times_seen": F.lit(1).cast("bigint")}).drop("seen_at")
    merged = serving.merge_seen(serving.merge_seen(empty, first, ["user_id", "event_type"]), second, ["user_id", "event_type"])
    return merged.select("user_id", "event_type", "first_seen", "last_seen", "times_seen")


@register("t01_by_deadline", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate NULLS LAST, o_orderkey LIMIT 50")
def t01(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").asc_nulls_last(), "o_orderkey").limit(50)


@register("t05_newest", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 6")
def t05(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'error'").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(6)


@register("u01_union_dedup", "SELECT k, max(src) AS src FROM (SELECT c_nationkey k, 'customer' src FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY 1")
def u01(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("src"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("src"))
    return a.unionByName(b).groupBy("k").agg(F.max("src").alias("src"))


@register("u03_except", "SELECT p_brand, p_type FROM part WHERE p_size > 25 EXCEPT SELECT p_brand, p_type FROM part WHERE p_size < 3")
def u03(spark, sf):
    rows = table(spark, sf, "part")
    return rows.filter("p_size > 25").select("p_brand", "p_type").distinct().join(rows.filter("p_size < 3").select("p_brand", "p_type"), ["p_brand", "p_type"], "left_anti")


@register("u04_intersect", "SELECT o_custkey AS user_id FROM orders INTERSECT SELECT user_id FROM events")
def u04(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).intersect(table(spark, sf, "events").select("user_id"))


@register("u05_first_of_each", "SELECT text_key, min(doc_id) AS doc_id FROM (SELECT md5(text) text_key, doc_id FROM documents) GROUP BY 1")
def u05(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("text_key")).agg(F.min("doc_id").alias("doc_id"))


@register("st11_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st11(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))
