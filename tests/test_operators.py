"""Contracts, verdicts, pages, gates, opportunities and rankings on small tables."""

import datetime

import pytest
from lumenyard.operators import contract, drafts, gate, opportunity, pages, ranking, serving, stats, verdict
from lumenyard.operators.contract import Invariant
from pyspark.sql import functions as F

PRODUCT = "run int, name string, price string, deposit string, availability string, sku string"
RULES = [
    Invariant("required", "name"),
    Invariant("range", "price", low=1),
    Invariant("compare", "price", op=">", other="deposit"),
    Invariant("currency", "price", allowed=("USD",)),
    Invariant("enum", "availability", allowed=("in_stock", "out_of_stock", "preorder")),
    Invariant("unique", "sku"),
]


def product(run=0, name="Nova Headphones", price="249 USD", deposit="25 USD", availability="in_stock", sku="NOVA-001"):
    return (run, name, price, deposit, availability, sku)


@pytest.fixture(scope="module")
def learned(spark):
    rows = spark.createDataFrame([product(i, price=f"{249 + i % 3} USD") for i in range(12)], PRODUCT)
    header, fields = contract.learn(rows, "run")
    return header.cache(), fields.cache(), contract.vocabularies(rows.drop("run")).cache()


def checks(spark, learned, *rows):
    header, fields, words = learned
    df = spark.createDataFrame(list(rows), PRODUCT).drop("run")
    return {r["check_id"]: r["status"] for r in contract.validate(df, header, fields, RULES, words=words).collect()}


def failed(found):
    return {k for k, v in found.items() if v in ("fail", "warn")}


def test_healthy_row_passes(spark, learned):
    assert failed(checks(spark, learned, product())) == set()


@pytest.mark.parametrize(
    "row, expected",
    [
        (product(price="25 USD"), {"invariant:compare:price", "learned:numeric:price", "learned:shape:price", "learned:enum:price"}),
        (product(price="0 USD"), {"invariant:range:price", "invariant:compare:price", "learned:numeric:price", "learned:shape:price", "learned:enum:price"}),
        (product(price="249 EUR"), {"invariant:currency:price", "learned:currency:price", "learned:enum:price"}),
        (product(availability="gone"), {"invariant:enum:availability", "learned:enum:availability", "learned:shape:availability"}),
        (product(name=None), {"invariant:required:name", "structure:required:name"}),
        (product(sku="OTHER-2"), {"learned:enum:sku", "learned:numeric:sku", "learned:shape:sku"}),
    ],
)
def test_departures_are_caught(spark, learned, row, expected):
    assert failed(checks(spark, learned, row)) == expected


def test_structure_checks(spark, learned):
    header, fields, _ = learned
    assert [(r["check_id"], r["status"]) for r in contract.validate(spark.createDataFrame([], PRODUCT).drop("run"), header, fields, RULES).collect()] == [("structure:empty_result", "fail")]
    doubled = checks(spark, learned, *[product() for _ in range(4)])
    assert doubled["invariant:unique:sku"] == "fail"
    few = spark.createDataFrame([product(i) for i in range(2)], PRODUCT)
    header, fields = contract.learn(few, "run")
    found = {r["check_id"]: r["status"] for r in contract.validate(few.drop("run"), header, fields, []).collect()}
    assert found["learned:insufficient_baseline"] == "unknown"


def test_nested_fields_and_statistics(spark):
    df = spark.createDataFrame([((float(x),),) for x in (1, 2, 4, 9)], "price struct<value double>")
    row = contract.profile(df).first()
    assert row["path"] == "price.value" and row["p05"] == pytest.approx(1.15) and row["med"] == 3
    assert [r["c"] for r in spark.createDataFrame([(1,), (5,), (20,), (50,)], "n int").select(stats.sample_confidence(F.col("n")).alias("c")).collect()] == pytest.approx([0, 1 - 5 / 9, 1 - 5 / 24, 1 - 5 / 54])
    two = spark.createDataFrame([([1, 2, 2], [2, 2, 3])], "a array<int>, b array<int>").select(stats.dice(F.col("a"), F.col("b")).alias("d"), stats.jaccard(F.col("a"), F.col("b")).alias("j")).first()
    assert two["d"] == pytest.approx(4 / 6) and two["j"] == pytest.approx(1 / 3)


RUN = "run_id int, explicit boolean, failed boolean, warned boolean, failing array<string>, check_coverage double, departs boolean, aligned boolean, agreed array<string>, disagreed array<string>, incomparable array<string>, weakest double, agreement_rate double, coverage double"
N = None
VERDICTS = [
    ((True, True, False, ["p"], 1.0, False, N, ["p"], [], [], 1.0, 1.0, 1.0), "explicit_failure", 1.0),
    ((False, False, False, [], 0.9, False, N, N, N, N, N, N, N), "healthy", 0.9),
    ((False, False, False, [], 0.2, False, N, ["p"], [], [], 1.0, 1.0, 1.0), "healthy", 0.5),
    ((False, True, False, ["p"], 1.0, False, N, N, N, N, N, N, N), "inconclusive", 0.3),
    ((False, True, False, ["q"], 1.0, False, N, ["p"], [], [], 1.0, 1.0, 1.0), "inconclusive", 0.35),
    ((False, True, False, ["p.value"], 1.0, True, N, ["p"], [], [], 1.0, 1.0, 1.0), "genuine_source_change", 0.8),
    ((False, True, False, ["p"], 1.0, True, False, ["p"], [], [], 1.0, 1.0, 1.0), "access_anomaly", 0.7),
    ((False, True, False, ["p"], 1.0, True, True, ["p"], [], ["a", "b"], 1.0, 1.0, 1 / 3), "inconclusive", 0.35),
    ((False, False, True, ["p"], 1.0, False, N, ["p"], [], [], 1.0, 1.0, 1.0), "healthy", 0.8),
    ((False, False, True, ["p"], 1.0, False, N, [], ["p"], [], 0.35, 0.0, 1.0), "inconclusive", 0.4),
    ((False, False, True, ["p"], 1.0, False, N, ["a"], ["p"], [], 0.85, 0.5, 1.0), "extractor_drift", 0.925),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, *v) for i, (v, _, _) in enumerate(VERDICTS)], RUN)
    rows = verdict.classify(df).orderBy("run_id").collect()
    assert [r["verdict"] for r in rows] == [k for _, k, _ in VERDICTS]
    assert [r["verdict_confidence"] for r in rows] == pytest.approx([c for _, _, c in VERDICTS])


def test_reconciliation(spark):
    specs = spark.createDataFrame([("price", None, False), ("when", "date", False), ("link", None, True)], "path string, shape string, required_on_page boolean")
    collected = spark.createDataFrame([(1, "price", "25"), (1, "when", "18 September 2026"), (1, "link", "https://a"), (2, "price", "249")], "run_id int, path string, value string")
    seen = spark.createDataFrame([(1, "price", "$249", 0.85), (1, "when", "2026-09-18", 0.85), (2, "deposit", "249", 0.85)], "run_id int, path string, value string, confidence double")
    fields = verdict.compare_fields(specs, collected, seen)
    found = {(r["run_id"], r["path"]): (r["kind"], r["confidence"]) for r in fields.collect()}
    assert found[1, "price"] == ("disagree", 0.85) and found[1, "when"][0] == "agree" and found[1, "link"] == ("disagree", 0.8)
    assert found[2, "price"][0] == "incomparable" and found[2, "link"][0] == "agree"
    total = {r["run_id"]: r for r in verdict.summary(fields).collect()}
    assert total[1]["agreement_rate"] == pytest.approx(1 / 3) and total[1]["coverage"] == 1 and total[1]["weakest"] == 0.8
    moved = spark.createDataFrame([(1, "price", "25", "249", "disagree", 0.8), (1, "deposit", "25", "25", "agree", 0.8)], "run_id int, path string, collector string, witness string, kind string, confidence double")
    assert [(r["path"], r["other"]) for r in verdict.captured_instead(moved).collect()] == [("price", "deposit")]


PAGE = "# Nova\n\n## Facts\nPrice: $249\nDeposit: $25\nStock: yes\nSku: N1\n\n[buy](https://a.test/buy)\n" + "words here again " * 40
WALL = "We value your privacy\nAccept all\n"


def test_page_shapes(spark):
    df = spark.createDataFrame([(1, PAGE, PAGE.replace("249", "229")), (2, PAGE, WALL), (3, WALL, PAGE)], "i int, a string, b string")
    df = df.select("i", verdict.page_shape(F.col("a")).alias("x"), verdict.page_shape(F.col("b")).alias("y"))
    rows = {r["i"]: r["s"] for r in df.select("i", verdict.shape_similarity(F.col("x"), F.col("y")).alias("s")).collect()}
    assert rows[1]["similarity"] == 1 and rows[1]["same_page"]
    assert not rows[2]["same_page"] and rows[3]["same_page"]
    shape = df.filter("i = 1").select("x.*").first()
    assert shape["headings"] == [1, 2] and shape["labels"] == ["deposit", "price", "sku", "stock"] and shape["links"] == 1


FIELDS = {
    "price": pages.Field("price", ("price", "purchase price"), "money", exclude=("deposit",)),
    "availability": pages.Field("availability", ("availability",), "enum", allowed=("in stock", "out of stock")),
    "deadline": pages.Field("deadline", ("deadline", "closing date"), shape="date"),
    "link": pages.Field("application_url", ("apply now",), shape="url"),
}
READ = [
    ("price", "Price: $249\nRefundable deposit: $25\nAvailability: In stock", "$249", "labelled-line"),
    ("availability", "Price: $249\nAvailability: In stock", "in stock", "labelled-line"),
    ("price", "Refundable deposit price: $25\nPurchase price: $249", "$249", "labelled-line"),
    ("availability", "Price: $249", None, None),
    ("deadline", "Deadline\n\n18 September 2026\n", "18 September 2026", "labelled-line"),
    ("deadline", "## Closing date\nsoon\n18 September 2026", "18 September 2026", "heading-adjacent"),
    ("price", "| Item | Cost |\n| Price | $249 |", "$249", "table-row"),
    ("price", "Now only $249 for you", "$249", "bare-currency"),
    ("price", "$249 or $229", None, None),
    ("link", "See [Apply now](/apply?utm_source=x&id=3)", "https://a.test/apply?id=3", "markdown-link"),
    ("link", "Apply later", None, None),
    ("price", '{"price": "249.00", "priceCurrency": "USD"}', "249.00", "json-ld"),
    ("price", "", None, None),
    ("price", None, None, None),
]


@pytest.mark.parametrize("name", sorted(FIELDS))
def test_extraction(spark, name):
    own = [(i, body) for i, (n, body, _, _) in enumerate(READ) if n == name]
    df = spark.createDataFrame(own, "i int, body string").select("i", pages.extract(F.col("body"), F.lit("https://a.test/x"), FIELDS[name]).alias("r"))
    for r in df.collect():
        _, _, value, strategy = READ[r["i"]]
        assert (r["r"] and (r["r"]["value"], r["r"]["strategy"])) == (value and (value, strategy)), READ[r["i"]]


def test_labels_are_no_patterns_and_need_a_key(spark):
    read = lambda body, spec: spark.range(1).select(pages.extract(F.lit(body), F.lit("https://a.test/"), spec).alias("r")).first()["r"]
    assert read("Weight (kg): 12", pages.Field("w", ("Weight (kg",), "number"))["value"] == "12"
    assert read("Weight: 12", pages.Field("p", ("\u4fa1\u683c",), "number")) is None
    assert read('the "price": 25 stands in prose', pages.Field("price", ("price",), "number"))["strategy"] == "labelled-line"


def test_robots_keep_repeated_urls(spark):
    rules = pages.robots_rules(spark.createDataFrame([("https://a.test", "User-agent: *\nDisallow: /x")], "origin string, text string"))
    urls = spark.createDataFrame([("https://a.test/x",), ("https://a.test/x",), ("https://a.test/y",)], "url string")
    assert sorted(r["allowed"] for r in pages.robots_allowed(urls, rules).collect()) == [False, False, True]


def test_quantiles_over_ranges(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    rows = [(k, None if v > 95 else float(v)) for k, n in (("a", 1), ("b", 2), ("c", 700)) for v in draw.integers(0, 100, n)] + [("d", None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    asked = stats.counted(df, ["k"], F.col("v")), ["k"], {"low": 0.05, "med": 0.5, "top": 1.0}
    found = {r["k"]: r for r in stats.quantiles(*asked, splits=3).collect()}
    whole = {r["k"]: r for r in stats.quantiles(*asked).collect()}
    assert found.keys() == whole.keys() == {"a", "b", "c", None} - ({"a"} if "a" not in found else set()) and all(found[k][c] == pytest.approx(whole[k][c]) for k in found for c in ("n", "low", "med", "top"))
    spread = {r["k"]: r["mad"] for r in stats.centre_and_spread(df, ["k"], "v").collect()}
    for k in ("a", "b", "c"):
        own = np.array([v for x, v in rows if x == k and v is not None])
        if len(own):
            assert found[k]["n"] == len(own) and [found[k][c] for c in ("low", "med", "top")] == pytest.approx([np.quantile(own, q) for q in (0.05, 0.5, 1)])
            assert spread[k] == pytest.approx(np.median(np.abs(own - np.median(own))) * 1.4826)
    assert "d" not in found
    whole = stats.centre_and_spread(df, [], "v").first()
    assert whole["med"] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_feed_takes_the_newest_incident_about_the_url_or_the_collector(spark):
    t = lambda h: datetime.datetime(2026, 1, 1, h)
    shots = spark.createDataFrame([("c", "u", "v", t(9), "two_sensors"), ("c", "w", "v", t(9), "two_sensors"), ("d", "u", "v", t(9), "two_sensors"), ("c", "x", None, None, None)], "collector_id string, url string, data string, verified_at timestamp, confirmed_by string")
    incidents = [(1, "c", "u", t(1), True), (2, "c", None, t(2), True), (3, "c", "u", t(3), True), (4, "c", None, t(4), False), (5, "d", "other", t(5), True)]
    df = spark.createDataFrame([(i, c, u, "extractor_drift", 0.75, at, None, q) for i, c, u, at, q in incidents], "incident_id int, collector_id string, url string, verdict string, confidence double, created_at timestamp, resolved_at timestamp, quarantined boolean")
    rows = {(r["collector_id"], r["url"]): (r["status"], r["incident_id"]) for r in serving.feed(shots, df, F.lit("2026-01-01 12:00:00").cast("timestamp")).collect()}
    assert rows == {("c", "u"): ("quarantined", 3), ("c", "w"): ("quarantined", 2), ("d", "u"): ("verified", None), ("c", "x"): ("unavailable", 2)}


def test_recovery_is_the_next_good_run(spark):
    at = lambda d: datetime.datetime(2026, 1, d)
    incidents = spark.createDataFrame([(1, "u", at(2)), (2, "u", at(5)), (3, "w", at(1))], "incident_id int, url string, created_at timestamp")
    runs = spark.createDataFrame([("u", at(2), True), ("u", at(3), False), ("u", at(4), True), ("u", at(9), True), ("v", at(9), True)], "url string, at timestamp, publishable boolean")
    assert {r["incident_id"]: r["resolved_at"] for r in verdict.recovered(incidents, runs).collect()} == {1: at(4), 2: at(9), 3: None}


def test_titles_of_lists_and_of_furniture(spark):
    df = spark.createDataFrame([(t,) for t in ("2,431 AI internships", "Accept all cookies", "Online", "Full-time", "Register for an upcoming hackathon", "Nova Research Fellowship 2026")], "t string")
    got = df.select("t", drafts.is_index(F.col("t"), F.lit(""), F.lit("https://a.test/x")).alias("a"), drafts.is_furniture(F.col("t")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(True, False), (False, True), (False, True), (False, True), (True, False), (False, False)]


def test_links_and_robots(spark):
    md = "[Scholarship](https://a.test/x?utm_source=news&id=7) [again](https://a.test/x?id=7) ![pic](/p.png) [login](/login) [pdf](/f.pdf) [fb](https://www.facebook.com/x) [rel](more/y)"
    rows = pages.harvest(spark.createDataFrame([(1, "https://a.test/d/i", md)], "page_id int, url string, markdown string")).orderBy("pos").collect()
    assert [(r["url"], r["text"]) for r in rows] == [("https://a.test/x?id=7", "Scholarship")]  # [rel] promises nothing
    many = "[grant](/same) " * 200 + "[award](/other)"
    rows = pages.harvest(spark.createDataFrame([(1, "https://a.test/d/i", many)], "page_id int, url string, markdown string"), limit=2).orderBy("pos").collect()
    assert [r["url"] for r in rows] == ["https://a.test/same", "https://a.test/other"]
    text = "User-agent: bot\nUser-agent: crawler\nDisallow: /\n\nUser-agent: *\nDisallow: /private # no\nAllow: /private/open\nDisallow: /*.php$\n"
    rules = pages.robots_rules(spark.createDataFrame([("https://a.test", text)], "origin string, text string"))
    urls = spark.createDataFrame([(u,) for u in ("https://a.test/private/x", "https://a.test/private/open/1", "https://a.test/a.php", "https://a.test/a.php?x", "https://a.test", "https://b.test/x")], "url string")
    found = {r["url"]: (r["allowed"], r["reason"]) for r in pages.robots_allowed(urls, rules).collect()}
    assert [found[u][0] for u in ("https://a.test/private/x", "https://a.test/private/open/1", "https://a.test/a.php", "https://a.test/a.php?x", "https://a.test", "https://b.test/x")] == [False, True, False, True, True, True]
    assert found["https://b.test/x"][1] == "no_rules"
    assert not any(r["allowed"] for r in pages.robots_allowed(urls, rules, "MyBot").filter("url like 'https://a%'").collect())


def test_gate(spark):
    schema = "case string, url string, path string, value string, shape string"
    expected = spark.createDataFrame([("incident", "u1", "price", "249", None), ("golden", "u2", "when", "18 September 2026", "date"), ("unrun", "u3", "price", "5", None), ("empty", "u1", None, None, None)], schema)
    rows = spark.createDataFrame([("u1", "price", "$249"), ("u2", "when", "1 September 2026")], "url string, path string, value string")
    found = {r["case"]: (r["passed"], r["missing"], r["wrong"]) for r in gate.evaluate(expected, rows).collect()}
    assert found == {"incident": (True, False, []), "golden": (False, False, ["when"]), "unrun": (False, True, ["price"]), "empty": (False, False, [])}
    decision = gate.decide(gate.evaluate(expected, rows), spark.createDataFrame([("u2", "when", "2026-09-01")], "url string, path string, value string"), rows, ["price"]).first()
    assert not decision["approved"] and "u2: protected price is empty" in decision["reasons"]
    good = gate.evaluate(expected.filter("case = 'incident'"), rows)
    assert gate.decide(good).first()["approved"]
    body = gate.certificate(spark.createDataFrame([(1, 2.0, None)], "a int, b double, c string"), ["a", "b", "c"]).first()
    assert body["body"] == '{"a":1,"b":"2","c":null}' and len(body["digest"]) == 64


def test_drift_scores(spark):
    """Three ways of judging six pages, of which four have a fault: just two sensors are right on all."""
    cases = [("selector_drift", True), ("silent_zero", True), ("missing_field", True), ("sponsored", True), ("price_change", False), ("baseline", False)]
    notices = {"conventional": {"silent_zero", "missing_field"}, "change_monitor": {"selector_drift", "silent_zero", "missing_field", "sponsored", "price_change"}, "two_sensors": {"selector_drift", "silent_zero", "missing_field", "sponsored"}}
    df = spark.createDataFrame([(m, fault, mode in seen) for m, seen in notices.items() for mode, fault in cases], "method string, fault boolean, notice boolean")
    assert {r["method"]: r["score"] for r in gate.drift_score(df).collect()} == {"conventional": 67, "change_monitor": 83, "two_sensors": 100}


def test_feed_ages(spark):
    at = datetime.datetime(2026, 8, 22, 12)
    hours = lambda n: at - datetime.timedelta(hours=n)
    snapshots = spark.createDataFrame([("a", "u", "1", hours(2), "two_sensors"), ("b", "u", "1", hours(30), "two_sensors"), ("c", "u", "1", hours(2), None), ("d", "u", "1", hours(2), "two_sensors"), ("e", "u", "1", hours(2), "two_sensors")], "collector_id string, url string, data string, verified_at timestamp, confirmed_by string")
    incidents = spark.createDataFrame([("i1", "d", None, "extractor_drift", 0.95, hours(3), None, True), ("i2", "d", "u", "inconclusive", 0.35, hours(1), None, True), ("i3", "e", "other", "extractor_drift", 0.9, hours(1), None, True)], "incident_id string, collector_id string, url string, verdict string, confidence double, created_at timestamp, resolved_at timestamp, quarantined boolean")
    found = {r["collector_id"]: r for r in serving.feed(snapshots, incidents, F.lit("2026-08-22 12:00:00").cast("timestamp")).collect()}
    assert [(found[k]["status"], round(found[k]["confidence"], 3)) for k in "abcde"] == [("verified", 0.95), ("stale", 0.475), ("verified", 0.6), ("quarantined", 0.65), ("verified", 0.95)]
    assert found["d"]["incident_id"] == "i2" and found["d"]["reason"] == "insufficient_evidence_to_verify"


def test_batches_over_hosts(spark):
    rows = spark.createDataFrame([(f"https://a.test/{i}", "a.test") for i in range(20)] + [(f"https://b.test/{i}", "b.test") for i in range(3)], "url string, host string")
    hosts = [r["host"] for r in ranking.round_robin(rows, "host", 3, 6, F.col("url")).collect()]
    assert hosts == ["a.test", "b.test"] * 3
    many = spark.createDataFrame([(0, i, f"https://a.test/{i}", "a.test", False) for i in range(6)] + [(1, 3, "https://x.edu/1", "x.edu", True), (1, 4, "https://a.test/0", "a.test", False)], "batch int, pos int, url string, host string, official boolean")
    assert [r["url"] for r in ranking.merge_results(many).collect()] == ["https://x.edu/1", "https://a.test/0", "https://a.test/1"]


def test_lifecycle(spark):
    now = F.lit("2026-08-22 00:00:00").cast("timestamp")
    cases = [
        ("Applications closed", None, "1 January 2030", None, "closed"),
        (None, "Applications are now closed.", "1 January 2030", None, "closed"),
        (None, "Applications are closed, applications will open in May", None, None, "unknown"),
        (None, None, "7 Nov 2025", None, "closed"),
        ("rolling", None, None, None, "rolling"),
        (None, "Apply now!", None, None, "open"),
        (None, None, "sometime soon", None, "open"),
        (None, None, None, "open", "open"),
        (None, None, None, None, "unknown"),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, s string, p string, d string, x string")
    assert [r["v"] for r in df.select("i", opportunity.lifecycle(F.col("s"), F.col("p"), F.col("d"), F.col("x"), now).alias("v")).orderBy("i").collect()] == [c[4] for c in cases]


DRAFT_DEADLINES = [
    ("Deadline: 10 October 2026", "Deadline: 10 October 2026"),
    ("Rolling until 10 October 2026", "Rolling until 10 October 2026"),
    ("usually 10 October 2026", None),
    ("2026", None),
    ("see https://a.test 10 October 2026", None),
    ("Award for work. Closing on 10 October 2026", "Closing on 10 October 2026"),
    ("x" * 170 + " 10 October 2026", None),
    (None, None),
]


def test_plausible_facts(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(DRAFT_DEADLINES)], "i int, a string")
    assert [r["v"] for r in df.select("i", drafts.plausible_deadline(F.col("a")).alias("v")).orderBy("i").collect()] == [b for _, b in DRAFT_DEADLINES]
    row = spark.range(1).select(drafts.plausible_funding(F.lit("INR 250,000")).alias("a"), drafts.plausible_funding(F.lit("good prospects")).alias("b"), drafts.plausible_provider(F.lit("some words in prose")).alias("c"), drafts.plausible_provider(F.lit("MIT Media Lab")).alias("d")).first()
    assert tuple(row) == ("INR 250,000", None, None, "MIT Media Lab")


def test_scans_and_detectors(spark):
    pages_ = [
        (1, "# X\n- **Deadline:** 18 September 2026"),
        (2, "Important dates\n18 September 2026\nApplications close\n"),
        (3, "Deadline\n\n18 September 2026"),
        (4, "Results announced before 18 September 2026"),
        (5, "A stipend of $500 a month"),
        (6, None),
    ]
    rows = spark.createDataFrame(pages_, "i int, m string").select("i", drafts.scan_for_deadline(F.col("m")).alias("d"), drafts.scan_for_funding(F.col("m")).alias("f")).orderBy("i").collect()
    assert [r["d"] for r in rows] == ["Deadline: 18 September 2026", "18 September 2026 Applications close", "18 September 2026", None, None, None]
    assert [r["f"] for r in rows] == [None, None, None, None, "A stipend of $500 a month", None]
    titles = ["Top 10 scholarships", "Nova Fellowship 2026", "Cookie policy", "Scholarships in Canada", "Home", "Grant", "", "Payment options"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    found = df.select("i", drafts.is_index(F.col("t"), F.lit("x"), F.lit("https://a.test/x")).alias("a"), drafts.is_furniture(F.col("t")).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in found] == [True] + [False] * 7
    assert [r["b"] for r in found] == [False, False, True, True, True, False, True, True]


def test_counted_values_are_summed_without_being_sorted(spark):
    """Neither quantiles nor profiles may sort all values of a group to add them up."""
    rows = spark.range(1000).selectExpr("id % 3 AS g", "id % 101 + 0.5D AS v", "concat('w', id % 7) AS w")
    asked = [stats.quantiles(stats.counted(rows, ["g"], F.col("v")), ["g"], {"med": 0.5}), contract.profile(rows)]
    for found in asked:
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["path"], r["kind"], r["distinct"]) for r in asked[1].collect()} == {("g", "number", 3), ("v", "number", 101), ("w", "string", 7)}


def test_match_searches_a_text_once(spark):
    """Other words of an interest are looked for together, and both figures take the hits from one search."""
    low = F.col("t")
    plan = spark.createDataFrame([("x",)], "t string").select(ranking.mentions(low, "machine learning").alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("rlike") == 1
    texts = [("an ml course", True), ("html", False), ("by artificial intelligence", True), ("(ai)", True), ("said", False), (None, None), ("machine learning", True)]
    found = spark.createDataFrame(texts, "t string, y boolean").select("y", ranking.mentions(low, "machine learning").alias("x")).collect()
    assert all(r["x"] == r["y"] for r in found)
