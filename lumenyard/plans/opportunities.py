"""Queries of opportunity records, which are made from the documents table by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenyard.functions import numbers
from lumenyard.operators import opportunity, pages, ranking, serving
from lumenyard.operators.opportunity import Profile
from lumenyard.plans.registry import register
from lumenyard.sources.tables import shared_folder, table

PERSON = Profile("en", types=("scholarship", "grant"), interests=("onesnt", "machine learning"), locations=("fr",), needs_full_funding=True)
NOW = "2026-01-15 00:00:00"


def _pick(by: int, *names: str):
    out = F.lit(names[-1])
    for k, n in enumerate(names[:-1]):
        out = F.when(F.col("doc_id") % by == k, n).otherwise(out)
    return out


def records(spark, sf) -> DataFrame:
    some = lambda cond, value: F.when(cond, F.array().cast("array<string>")).otherwise(F.array(value))
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        k.alias("ord"),
        k.alias("doc_id"),
        F.substring("text", 1, 12).alias("title"),
        F.col("text").alias("summary"),
        F.col("source").alias("provider"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".test/"), k).alias("source_url"),
        F.col("source").alias("source_id"),
        _pick(3, "scholarship", "grant", "internship").alias("type"),
        some(k % 5 == 0, F.lit("open to all")).alias("eligibility"),
        some(k % 4 == 0, F.col("lang")).alias("locations"),
        (k % 6 == 0).alias("remote"),
        _pick(3, "full", "partial", "unspecified").alias("funding"),
        _pick(4, "verified", "quarantined", "stale", "discovered").alias("trust"),
        _pick(3, "two_sensors", "contract_only", "single_sensor").alias("confirmed_by"),
        _pick(4, "open", "rolling", "closed", "unknown").alias("status"),
        F.when(k % 7 > 0, F.date_add(F.lit("2026-01-01").cast("date"), (k % 60).cast("int"))).alias("deadline"),
        F.when(k % 7 > 0, F.lit("given")).alias("deadline_raw"),
        F.when(k % 2 == 0, 100.0).alias("amount"),
        F.timestamp_seconds(F.lit(1_700_000_000) + k % 1000).alias("verified_at"),
    )


def _case(by: int, *names: str) -> str:
    return "CASE doc_id % " + str(by) + "".join(f" WHEN {k} THEN '{n}'" for k, n in enumerate(names[:-1])) + f" ELSE '{names[-1]}' END"


_TYPE, _FUND = _case(3, "scholarship", "grant", "internship"), _case(3, "full", "partial", "unspecified")
_TRUST, _STATUS = _case(4, "verified", "quarantined", "stale", "discovered"), _case(4, "open", "rolling", "closed", "unknown")
_HITS = "(CASE WHEN contains(t, 'onesnt') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'machine learning') OR regexp_matches(t, '\\b(ml|ai|artificial intelligence)\\b') THEN 1 ELSE 0 END)"
_NEAR = "(doc_id % 6 = 0 OR doc_id % 4 = 0 OR lang IN ('en', 'fr'))"
_MATCH = f"""SELECT doc_id, greatest(0, least(100, 35 + CASE WHEN doc_id % 3 < 2 THEN 20 ELSE -20 END + least(25, {_HITS} * 10) + CASE WHEN {_NEAR} THEN 10 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END
    + CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN -25 ELSE 0 END + CASE doc_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 6 WHEN 2 THEN -45 ELSE 0 END))::INT AS score,
    CASE WHEN doc_id % 3 = 1 THEN false WHEN NOT {_NEAR} OR doc_id % 5 = 0 OR doc_id % 4 = 3 OR {_HITS} = 0 OR doc_id % 3 = 2 THEN NULL ELSE true END AS eligible
    FROM (SELECT doc_id, lang, lower(concat_ws(' ', substring(text, 1, 12), text, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'open to all' END)) t FROM documents)"""


@register("o05_match", _MATCH)
def o05(spark, sf):
    return opportunity.match(records(spark, sf), PERSON).select("doc_id", "score", "eligible")


_SAYS = "CASE WHEN doc_id % 7 > 0 THEN 7 ELSE 0 END + CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 2 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END"
_DEDUP = f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(substring(text, 1, 12)), '[^a-z0-9]+', ' ', 'g')), source
    ORDER BY doc_id % 3, CASE doc_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END DESC, {_SAYS} DESC, doc_id % 1000 DESC, doc_id) r FROM documents) WHERE r = 1"""


@register("o03_dedup", _DEDUP)
def o03(spark, sf):
    return opportunity.deduplicate(records(spark, sf)).select("doc_id")


@register("o06_world_stats", f"WITH d AS ({_DEDUP}), m AS (SELECT doc_id, source FROM documents SEMI JOIN d USING (doc_id) WHERE doc_id % 3 = 0) SELECT count(DISTINCT source) AS sources, count(*) AS opportunities, count(*) FILTER (doc_id % 4 = 0) AS verified, count(*) FILTER (doc_id % 4 <> 2 AND doc_id % 7 > 0 AND doc_id % 60 BETWEEN 14 AND 44) AS closing_soon FROM m")
def o06(spark, sf):
    """Grants are ruled out by partial funding here, so scholarships are left."""
    found = opportunity.world(records(spark, sf), PERSON)
    return opportunity.world_stats(found, F.lit(NOW).cast("timestamp"))


@register(
    "o07_search",
    "SELECT doc_id, score FROM (SELECT doc_id, 1 + CASE WHEN contains(lower(text), 'token') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'token license') OR regexp_matches(lower(text), 'robotics|\\brobot\\b') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'robotics') THEN 1 ELSE 0 END + 0.5::DOUBLE * (CASE WHEN doc_id % 7 > 0 THEN 1 ELSE 0 END) AS score FROM documents) ORDER BY score DESC, doc_id LIMIT 60",
)
def o07(spark, sf):
    rows = records(spark, sf)
    bonus = F.when(F.col("deadline").isNotNull(), 0.5).otherwise(0.0)
    return ranking.search(rows, F.col("summary"), ["token license", "robotics"], bonus, "doc_id").select("doc_id", "score")


def _plans(spark, sf, shift: int) -> DataFrame:
    k = F.col("doc_id") + shift
    rows = table(spark, sf, "documents").select("doc_id")
    return opportunity.mission(
        rows.select(
            "doc_id",
            F.when(k % 3 == 0, F.array(F.lit("Transcript"), F.lit("CV"))).when(k % 3 == 1, F.array(F.lit("CV"))).otherwise(F.array().cast("array<string>")).alias("documents"),
            F.array(F.lit(" cv ")).alias("held"),
            F.when(k % 10 == 0, F.array(F.lit("required_documents"))).otherwise(F.array().cast("array<string>")).alias("disputed"),
            F.when(k % 4 > 0, F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 40).cast("int")), "d MMMM yyyy")).alias("deadline_raw"),
            F.when(k % 9 == 0, "closed").otherwise("open").alias("status"),
            F.when(k % 11 == 0, "").otherwise("https://a.test/apply").alias("application_url"),
            F.when(k % 5 == 0, "stale").otherwise("verified").alias("trust"),
            F.when(k % 7 == 0, "single_sensor").otherwise("two_sensors").alias("confirmed_by"),
            (k % 13 == 0).alias("submitted"),
        ),
        F.lit(NOW).cast("timestamp"),
    )


_LATE = "(doc_id % 4 > 0 AND doc_id % 40 < 14)"


@register(
    "o08_mission",
    f"""SELECT doc_id, (CASE doc_id % 3 WHEN 2 THEN 0 ELSE CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 50 ELSE 100 END END)::BIGINT AS percent,
    CASE WHEN doc_id % 4 > 0 THEN (doc_id % 40 - 14)::BIGINT END AS days_remaining, CASE WHEN doc_id % 4 > 0 THEN DATE '2026-01-01' + (doc_id % 40)::INT - 3 END AS safety_date,
    CASE WHEN doc_id % 13 = 0 THEN 'submitted' WHEN doc_id % 9 = 0 OR doc_id % 11 = 0 OR {_LATE} THEN 'blocked' WHEN doc_id % 7 = 0 THEN 'discovered' WHEN doc_id % 10 = 0 OR doc_id % 5 = 0 THEN 'verified' WHEN doc_id % 3 = 1 THEN 'application_ready' ELSE 'eligible' END AS state FROM documents""",
)
def o08(spark, sf):
    return _plans(spark, sf, 0).select("doc_id", F.col("percent").cast("bigint").alias("percent"), "days_remaining", "safety_date", "state")


@register("o09_mission_changes", "SELECT doc_id, 'document' AS field, CASE doc_id % 3 WHEN 0 THEN 'Transcript' WHEN 1 THEN 'CV' END AS was, 'no longer required' AS now, false AS harder FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, 'document', 'not required', d, true FROM documents, (VALUES ('Transcript'), ('CV')) v(d) WHERE doc_id % 3 = 2")
def o09(spark, sf):
    """What changes when every plan becomes its neighbour's; here the documents only."""
    found = opportunity.mission_changes(_plans(spark, sf, 0), _plans(spark, sf, 1), "doc_id")
    return found.filter("field = 'document'")


@register("o04_lifecycle", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'closed' WHEN doc_id % 5 = 1 THEN 'rolling' WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 60 < 13 THEN 'closed' ELSE 'open' END WHEN doc_id % 5 = 2 THEN 'open' WHEN doc_id % 5 = 3 THEN 'rolling' ELSE 'unknown' END AS status FROM documents")
def o04(spark, sf):
    k = F.col("doc_id")
    status = F.when(k % 5 == 0, "Applications closed").when(k % 5 == 1, "year-round").when(k % 5 == 2, "apply today")
    raw = F.when(k % 4 == 0, F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 60).cast("int")), "yyyy-MM-dd"))
    declared = F.when(k % 5 == 3, "rolling").otherwise("unknown")
    found = opportunity.lifecycle(status, F.lit("about the programme"), raw, declared, F.lit(NOW).cast("timestamp"))
    return table(spark, sf, "documents").select("doc_id", found.alias("status"))


@register("sc42_funding", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'full' WHEN 3 THEN 'partial' ELSE 'unspecified' END AS level FROM documents")
def sc42(spark, sf):
    k = F.col("doc_id") % 5
    text = F.when(k == 0, "A Fully funded place").when(k == 1, "partial support").otherwise("support")
    covered = F.when(k == 2, F.array(F.lit("Tuition fees"), F.lit("Travel"))).when(k == 3, F.array(F.lit("tuition")))
    return table(spark, sf, "documents").select("doc_id", opportunity.funding_level(text, covered).alias("level"))


@register("sc03_funding_amount", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (doc_id + 1) * 100000.0 WHEN 1 THEN (doc_id + 1) * 1000.0 END::DOUBLE AS value, CASE doc_id % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' END AS currency FROM documents")
def sc03(spark, sf):
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.concat(F.lit("a grant of ₹"), k + 1, F.lit(" lakh"))).when(k % 3 == 1, F.concat(F.lit("up to $"), k + 1, F.lit("k a year"))).otherwise("paid")
    return table(spark, sf, "documents").select("doc_id", numbers.funding_amount(text).alias("m")).select("doc_id", "m.value", "m.currency")


@register("st13_crawl", "SELECT 'https://a.test/' || p_size AS url, min(CASE WHEN p_size <= 5 THEN 0 WHEN p_size <= 15 THEN 1 ELSE 2 END)::INT AS depth FROM part WHERE p_size <= 25 GROUP BY 1")
def st13(spark, sf):
    """A link graph over part sizes: five seeds, each page links ten further; two rounds."""
    shared_folder(spark)
    sizes = table(spark, sf, "part").select("p_size").distinct()
    page = lambda c: F.concat(F.lit("https://a.test/"), c)
    links = sizes.select(page(F.col("p_size")).alias("src"), F.explode(F.sequence(F.col("p_size") + 1, F.col("p_size") + 10)).alias("to"))
    links = links.join(sizes.withColumnRenamed("p_size", "to"), "to").select("src", page(F.col("to")).alias("dst"))
    seeds = sizes.filter("p_size <= 5").select(page(F.col("p_size")).alias("url"))
    return pages.crawl(seeds, links, depth=2, per_host=1000)


@register("s15_keep_latest", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 2000")
def s15(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(2000).select("o_orderkey")


@register("j07_newest_of_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def j07(spark, sf):
    return serving.latest(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id")
