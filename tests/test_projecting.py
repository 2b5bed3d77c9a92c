"""Opportunities from rows and drafts, first matches and deals, on small tables."""

import random

from lumenyard.operators import deals, firsts, projection
from lumenyard.sources.tables import variants
from pyspark.sql import functions as F


def now():
    return F.lit("2026-01-15 00:00:00").cast("timestamp")


def test_rows_and_drafts_as_opportunities(spark):
    rows = [
        ("c1", "https://a.test/1", '[{"title": "Grant one", "provider": "P", "amount": "", "funding": {"amount": 7.5, "currency": "usd"}, "deadline_raw": "closes 3 March 2026", "is_remote": "onsite", "fields": "ai | ml, ai"}, 5, null]', "2026-01-14 12:00:00", "two_sensors"),
        ("c1", "https://a.test/2", '{"title": "Grant two", "provider": "P", "deadline": "1 January 2026", "currency": 5, "documents": [" CV ", "CV", "", null]}', "2026-01-13 00:00:00", "two_sensors"),
        ("c1", "https://a.test/3", '{"title": "Grant three", "provider": "cafÃ©"}', None, None),
        ("c2", "https://b.test/1", '{"title": "Grant four", "provider": "P"}', "2026-01-14 12:00:00", "two_sensors"),
        ("c3", "https://c.test/1", '{"title": "Grant five", "provider": "P"}', "2026-01-14 12:00:00", None),
        ("none", "https://d.test/1", '{"title": "Grant six", "provider": "P"}', "2026-01-14 12:00:00", None),
        ("c1", "https://a.test/4", "not json", "2026-01-14 12:00:00", None),
        ("c1", "https://a.test/5", None, None, None),
    ]
    snapshots = spark.createDataFrame(rows, "collector_id string, url string, json string, verified_at string, confirmed_by string").withColumn("data", variants(F.col("json")))
    collectors = spark.createDataFrame([("c1", "one", "a.test", None), ("c2", "Doorway Lab x", "b.test", None), ("c3", None, " Lab.test ", 10**6)], "collector_id string, name string, domain string, fresh_minutes int")
    incidents = spark.createDataFrame([("i1", "c1", "https://a.test/1", "2026-01-01", None, True, "v", ["title"]), ("i2", "c1", None, "2025-01-01", "2026-01-01", True, "v", []), ("i3", "c3", None, "2026-01-01", None, False, "v", [])], "incident_id string, collector_id string, url string, created_at string, resolved_at string, quarantined boolean, verdict string, fields array<string>")
    found = {r["title"]: r for r in projection.from_snapshots(snapshots, collectors, incidents, now(), lab="lab.test").collect()}
    assert sorted(found) == ["Grant one", "Grant three", "Grant two"]
    one, two, three = found["Grant one"], found["Grant two"], found["Grant three"]
    assert (one["trust"], one["incident_id"], one["disputed"], one["amount"], one["currency"], one["remote"], one["interests"], str(one["deadline"]), one["status"]) == ("quarantined", "i1", ["title"], 7.5, "USD", False, ["ai", "ml"], "None", "open")
    assert (two["trust"], two["currency"], two["documents"], str(two["deadline"]), two["status"], two["application_url"]) == ("stale", None, ["CV"], "2026-01-01", "closed", "https://a.test/2")
    assert (three["provider"], three["trust"], three["status"], three["incident_id"], three["coverage"]) == ("café", "partially_verified", "unknown", None, [])
    everything = projection.from_snapshots(snapshots, collectors, incidents, now(), include_fixtures=True)
    assert everything.count() == 5
    drafts = spark.createDataFrame(
        [
            ("https://x.test/a", "x.test", "Sea Research Grant | Host", "X", "grant", "About it", "31 March 2026", "$2k", "unknown", "all", ["amount"], "conflicting", "2026-01-14"),
            ("https://x.test/b", "x.test", "Hill Fellowship Award", "X", "other", "Deadline: 2 February 2026\nmore", None, None, None, None, None, "confirmed", None),
            ("https://x.test/c", "x.test", "Cookie policy settings", "X", "grant", "", None, None, None, None, None, None, None),
        ],
        "source_url string, host string, title string, provider string, type string, summary string, deadline_raw string, funding string, status string, eligibility string, missing array<string>, corroboration string, read_at string",
    )
    made = projection.from_drafts(drafts, now())
    got = {r["source_url"][-1]: r for r in made.collect()}
    assert sorted(got) == ["a", "b"]
    assert (got["a"]["title"], got["a"]["amount"], str(got["a"]["deadline"]), got["a"]["status"], got["a"]["confirmed_by"], got["a"]["disputed"]) == ("Sea Research Grant", 2000.0, "2026-03-31", "open", "single_sensor", ["amount", "deadline_raw"])
    assert (got["b"]["type"], str(got["b"]["deadline"]), got["b"]["confirmed_by"], got["b"]["trust"]) == ("scholarship", "2026-02-02", "two_sensors", "discovered")
    assert projection.combined(everything, made, made).count() == 7


def test_a_row_is_parsed_and_taken_apart_once(spark):
    """Filters that Spark moves down must not read the whole of a row again."""
    rows = spark.createDataFrame([("c1", "https://a.test/1", '{"title": "Grant one", "provider": "P"}', None, None)], "collector_id string, url string, json string, verified_at string, confirmed_by string")
    snapshots = rows.withColumn("data", variants(F.col("json")))
    collectors = spark.createDataFrame([("c1", "one", "a.test", None)], "collector_id string, name string, domain string, fresh_minutes int")
    incidents = spark.createDataFrame([], "incident_id string, collector_id string, url string, created_at string, resolved_at string, quarantined boolean, verdict string, fields array<string>")
    found = projection.combined(projection.from_snapshots(snapshots, collectors, incidents, now()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1
    assert plan.count("StructField(opportunity_title,") == 1 and "$.title" not in plan
    assert [(r["title"], r["type"], r["trust"]) for r in found.collect()] == [("Grant one", "grant", "partially_verified")]


def test_members_of_what_is_no_object_or_holds_nulls(spark):
    texts = ['{"amount": null, "title": null, "name": "N"}', '{"title": {"title": "x"}, "amount": "about 5"}', '["title"]', '"title"', "7", "null"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("own", projection.members(F.try_parse_json("t"), "title", "name", "amount", "title"))
    found = rows.select("i", projection.text_of(F.col("own"), "title", "name").alias("text"), projection.number_of(F.col("own"), "amount").alias("n"), F.col("own").isNull().alias("none"), projection.list_of(F.col("own"), "name").alias("list")).orderBy("i").collect()
    assert [(r["text"], r["n"], r["none"], r["list"]) for r in found] == [("N", None, False, ["N"]), (None, 5.0, False, []), *[(None, None, True, [])] * 4]


def test_first_named_item(spark):
    draw = random.Random(7)
    word = lambda n: "".join(draw.choice("abC ") for _ in range(n))
    items = [(draw.choice([None, word(draw.randint(0, 12))]), draw.choice([None, word(3)]), i) for i in range(120)]
    terms = [(i, draw.choice([None, "", " ", word(draw.randint(1, 7))])) for i in range(150)]
    found = firsts.find_named(spark.createDataFrame(terms, "i int, term string"), "term", spark.createDataFrame(items, "name string, code string, at int"), "name", "code", "at").collect()
    for r in found:
        t = (r["term"] or "").strip().lower()
        hits = [at for n, c, at in items if t and (t in (n or "").lower() or t == (c or "").lower())]
        assert r["found"] == min(hits, default=None)
    assert len(found) == 150 and any(r["found"] is None for r in found) and any(r["found"] for r in found)


def test_deals_where_nothing_can_be_said(spark):
    cols = "g int, k int, title string, price double, currency string"
    raw = spark.createDataFrame([(1, 1, "a", 5.0, "EUR"), (1, 2, "b", 4.0, "USD"), (2, 3, "c", 0.0, "EUR"), (None, 4, "d", 1.0, None), (3, 5, "e", 2.0, "EUR"), (3, 6, "f", 2.0, "EUR")], cols)
    safe = raw.filter("k <> 4")
    found = {r["g"]: r for r in deals.compare_deals(raw, safe, "g", "k").collect()}
    assert (found[1]["naive"]["k"], found[1]["verified"], found[1]["currencies"], found[1]["reason"]) == (2, None, ["EUR", "USD"], "no rate between currencies")
    assert (found[2]["naive"], found[2]["verified"], found[2]["diverged"], found[2]["reason"]) == (None, None, False, None)
    assert (found[None]["naive"]["k"], found[None]["reason"]) == (4, "nothing is stood behind")
    assert (found[3]["naive"]["k"], found[3]["verified"]["k"], found[3]["diverged"]) == (5, 5, False)
    assert deals.compare_deals(raw.limit(0), safe.limit(0), "g", "k").count() == 0
