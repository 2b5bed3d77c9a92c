"""Untyped rows, observations of many runs, repairs, markup and methods of noticing, on small cases made by hand."""

import datetime
import json

import pytest
from lumenyard.operators import gate, markup, observe, paths, verdict
from lumenyard.sources.tables import kept
from pyspark.sql import functions as F


def leaf_names(value, prefix="", depth=8):
    """Leaf paths by a plain walk."""
    if depth < 0:
        return []
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in leaf_names(v, f"{prefix}.{k}" if prefix else k, depth - 1)]
    if isinstance(value, list):
        own = f"{prefix}.[]" if prefix else "[]"
        return [p for v in value for p in leaf_names(v, own, depth - 1)] or [own]
    return [prefix] if prefix else []


DOCS = [
    {"a": 1, "b": {"c": None, "d": "x", "e": {}}, "t": ["p", "q"], "u": [], "w": [{}, {"k": True}], "z": [[1, 2], []], "n": 1.5},
    3,
    None,
    [{"a": 1}],
    {},
    {"a": "s", "e": [{}]},
    {"1": {"2": {"3": {"4": {"5": {"6": {"7": {"8": 5, "8o": {"9": 1}, "8a": [1]}}}}}}}},
]


def test_leaf_paths(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(99, None), (98, "{broken")], "i int, j string").withColumn("v", F.try_parse_json("j"))
    found = {}
    for r in paths.cells(df, "v", ["i"]).collect():
        found.setdefault(r["i"], []).append(r["path"])
    for i, d in enumerate(DOCS):
        assert sorted(found.get(i, [])) == sorted(leaf_names(d)), d
    assert 99 not in found and 98 not in found
    union = {r["path"]: r["kinds"] for r in paths.leaf_paths(df, "v").collect()}
    assert union["a"] == {"number": 1, "string": 1} and union["b.c"] == {"null": 1} and union["z.[].[]"] == {"null": 1, "number": 2} and union["w.[].k"] == {"boolean": 1}


AT = datetime.datetime(2026, 5, 1)


def observed(spark, given):
    """The tables of several collectors: by id their runs and healthy runs (run_id, [rows]), invariants, specs and protected."""
    both = {side: [(f"{c}{r}", c, many, i) for c, own in given.items() for i, (r, many) in enumerate(own.get(side, []))] for side in ("runs", "healthy")}
    table = lambda own: spark.createDataFrame([(r, c, "u", AT + datetime.timedelta(hours=i)) for r, c, _, i in own], "run_id string, collector_id string, url string, observed_at timestamp")
    rows = lambda own: spark.createDataFrame([(r, i, json.dumps(x)) for r, _, many, _ in own for i, x in enumerate(many)], "run_id string, row_no int, j string").select("run_id", "row_no", F.parse_json("j").alias("row"))
    setting = [(c, "US", "desktop", own.get("protected", ["price"]), json.dumps(own.get("specs", [{"path": "price"}])), json.dumps(own.get("rules", []))) for c, own in given.items()]
    collectors = spark.createDataFrame(setting, "collector_id string, country string, device string, protected array<string>, s string, i string")
    collectors = collectors.withColumns({"specs": F.from_json("s", observe.SPECS), "invariants": F.from_json("i", observe.INVARIANTS)})
    seen = [(f"{c}{r}", True, True, "US", "desktop", AT + datetime.timedelta(hours=h)) for c, own in given.items() for r, h in own.get("seen", [])]
    seen = spark.createDataFrame(seen, "run_id string, fetched boolean, same_page boolean, country string, device string, fetched_at timestamp")
    read = spark.createDataFrame([(f"{c}{r}", *x) for c, own in given.items() for r, *x in own.get("read", [])], "run_id string, path string, value string, confidence double")
    return collectors, table(both["runs"]), rows(both["runs"]), seen, read, observe.learn(table(both["healthy"]), rows(both["healthy"]))


HEALTHY = [(f"h{i}", [{"price": 100 + i, "state": "open", "tags": ["a"]}]) for i in range(8)]


def test_checks_of_many_runs(spark):
    rules = [
        {"kind": "required", "field": "state"},
        {"kind": "range", "field": "price", "low": 0, "high": 1000},
        {"kind": "compare", "field": "price", "op": ">", "other": "least"},
        {"kind": "enum", "field": "state", "allowed": ["open", "shut"]},
        {"kind": "host", "field": "link", "host": "a.test"},
        {"kind": "currency", "field": "cost", "allowed": ["USD"]},
        {"kind": "unique", "field": "id"},
    ]
    runs = [
        ("ok", [{"price": 101, "state": "open"}]),
        ("none", []),
        ("error", [{"error": "timeout"}, {"price": 101, "state": "open"}]),
        ("absent", [{"price": 101}]),
        ("null", [{"price": None, "state": ""}]),
        ("rules", [{"price": 5000, "least": 9000, "state": "odd", "link": "https://b.test/x", "cost": "EUR 5", "id": 1}, {"price": 102, "state": "open", "id": 1}]),
        ("type", [{"price": "about a hundred", "state": "open"}]),
    ]
    given = {"c-": {"runs": runs, "healthy": HEALTHY, "rules": rules}, "d-": {"runs": [("few", [{"price": 10**6}])], "healthy": HEALTHY[:2]}}
    collectors, table, rows, *_, contracts = observed(spark, given)
    found = {}
    for r in observe.checks(collectors, table, rows, contracts).collect():
        found.setdefault(r["run_id"][2:], {}).setdefault((r["check_id"], r["status"]), r["n"])
    bad = {run: {c for c, s in own if s in ("fail", "warn")} for run, own in found.items()}
    assert bad["ok"] == set() and found["none"] == {("structure:empty_result", "fail"): 1}
    assert bad["error"] == {"structure:collector_error", "structure:required:price", "structure:required:state", "invariant:required:state"}
    assert bad["absent"] == {"structure:required:state", "invariant:required:state"}
    assert bad["null"] == {"structure:required:price", "structure:required:state", "invariant:required:state", "learned:enum:state", "learned:shape:state", "invariant:enum:state"}
    assert bad["rules"] == {"invariant:range:price", "invariant:compare:price", "invariant:enum:state", "invariant:host:link", "invariant:currency:cost", "invariant:unique:id", "learned:numeric:price", "learned:enum:state", "learned:shape:state"}
    assert bad["type"] == {"learned:type:price"} and found["ok"]["invariant:unique:id", "unknown"] == 1 and found["rules"]["invariant:compare:price", "unknown"] == 1
    # two runs teach too little for learned checks, but tell what is required
    assert found["few"] == {("structure:required:price", "pass"): 1, ("structure:required:state", "fail"): 1, ("learned:insufficient_baseline", "unknown"): 1, ("learned:row_count", "pass"): 1}
    fields = {r["path"]: r for r in contracts.fields.filter("collector_id = 'c-'").collect()}
    assert fields["price"]["med"] == 103.5 and fields["price"]["required"] and fields["state"]["required"] and not fields["tags.[]"]["required"] and fields["price"]["kinds"] == {"number": 8}


def test_verdicts_incidents_and_feed(spark):
    """a-: nothing is learned, so the second reading decides. b-: it did not read the field that fails. c-: runs that fail and recover."""
    given = {
        "a-": {
            "runs": [("same", [{"price": 100}]), ("other", [{"price": 25}]), ("unseen", [{"price": 100}]), ("blank", [{"price": 100}])],
            "seen": [("same", 0), ("other", 1), ("blank", 3)],
            "read": [("same", "price", "$100", 0.9), ("other", "price", "$100", 0.9), ("other", "price", "7", 0.2)],
        },
        "b-": {"runs": [("r", [{"price": 101}])], "healthy": HEALTHY, "seen": [("r", 0)], "read": [("r", "price", "101", 0.9)]},
        "c-": {"runs": [("r1", [{"price": 101, "state": "open"}]), ("r2", []), ("r3", [{"price": 102, "state": "open"}]), ("r4", [])], "healthy": HEALTHY, "seen": [("r2", 1), ("r4", 3)]},
    }
    tables = observed(spark, given)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    observed_runs = observe.observe(*tables)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == jobs, "a plan is built without reading anything"
    observed_runs = kept(observed_runs)
    found = {r["run_id"]: r for r in observed_runs.collect()}
    assert {k: (r["verdict"], r["publishable"], r["confirmed_by"]) for k, r in found.items()} == {
        "a-same": ("healthy", True, "two_sensors"),
        "a-other": ("extractor_drift", False, "contract_only"),
        "a-unseen": ("inconclusive", False, "contract_only"),
        "a-blank": ("healthy", True, "contract_only"),
        "b-r": ("inconclusive", False, "two_sensors"),
        "c-r1": ("healthy", True, "contract_only"),
        "c-r2": ("explicit_failure", False, "contract_only"),
        "c-r3": ("healthy", True, "contract_only"),
        "c-r4": ("explicit_failure", False, "contract_only"),
    }
    assert found["a-other"]["affected"] == ["price"] and found["a-other"]["verdict_confidence"] == pytest.approx(0.5)
    about = found["b-r"]
    assert about["verdict_confidence"] == 0.35 and about["affected"] == ["state"] and about["worst"][0]["check_id"] == "structure:required:state"
    incidents = {r["incident_id"]: r for r in observe.incidents(observed_runs).collect()}
    assert incidents["c-r2"]["resolved_at"] == AT + datetime.timedelta(hours=2) and incidents["c-r4"]["resolved_at"] is None and "c-r1" not in incidents
    feed = {r["collector_id"]: r for r in observe.served(observed_runs, tables[2], F.lit("2026-05-01 04:00:00").cast("timestamp")).collect()}
    assert {c: (r["status"], r["data"] and json.loads(r["data"])["price"], r["incident_id"]) for c, r in feed.items()} == {
        "a-": ("verified", 100, None), "b-": ("unavailable", None, "b-r"), "c-": ("quarantined", 102, "c-r4"),
    }


def test_recovered_is_the_next_run_only(spark):
    rows = 3000
    incidents = spark.range(rows).select(F.col("id").alias("incident_id"), F.lit("u").alias("url"), F.timestamp_seconds(F.col("id") * 10).alias("created_at"))
    runs = spark.range(rows).select(F.lit("u").alias("url"), F.timestamp_seconds(F.col("id") * 10 + F.col("id") % 2 * 3).alias("at"), (F.col("id") % 5 != 4).alias("publishable"))
    good = sorted(10 * i + i % 2 * 3 for i in range(rows) if i % 5 != 4)
    import bisect

    for r in verdict.recovered(incidents, runs).collect():
        at = bisect.bisect_right(good, 10 * r["incident_id"])
        assert (r["resolved_at"].timestamp() if r["resolved_at"] else None) == (good[at] if at < len(good) else None)


def facts(spark, html):
    return spark.createDataFrame([(html,)], "h string").select(markup.structured_facts(F.col("h")).alias("f")).first()["f"]


def block(value):
    return f'<script type="application/ld+json">\n{value if isinstance(value, str) else json.dumps(value)}\n</script>'


def test_declared_facts(spark):
    event = facts(spark, block({"@type": "Event", "name": "A hackathon", "organizer": {"@type": "Organization", "name": "A centre"}, "startDate": "2026-07-08", "endDate": "2026-07-16", "registrationDeadline": "2026-07-15"}))
    assert (str(event["deadline"]), event["deadline_field"], str(event["start"]), event["title"], event["provider"]) == ("2026-07-15", "registrationDeadline", "2026-07-08", "A hackathon", "A centre")
    assert event["types"] == ["Event", "Organization"] and event["amount"] is None
    deep = facts(spark, block({"@graph": [{"@type": "WebPage", "mainEntity": {"@type": "Course", "name": "A course", "offers": {"@type": "Offer", "price": 250000, "priceCurrency": "INR"}, "validThrough": "2027-01-31"}}]}))
    assert (deep["title"], str(deep["deadline"]), deep["amount"], deep["currency"]) == ("A course", "2027-01-31", 250000.0, "INR")
    assert str(facts(spark, block("{ this is not json }") + block({"@type": "Event", "registrationDeadline": "2026-09-01"}))["deadline"]) == "2026-09-01"
    bad = facts(spark, block({"registrationDeadline": "soon", "startDate": "0001-01-01", "deadline": "2026-02-31", "price": "free", "currency": "usd"}))
    assert (bad["deadline"], bad["start"], bad["amount"], bad["currency"]) == (None, None, None, None)
    assert facts(spark, '<meta property="og:title" content="A fellowship">')["title"] == "A fellowship"
    for nothing in ("", "<p>Apply soon!</p>", None, block(""), block("3"), block("[]")):
        found = facts(spark, nothing)
        assert found["types"] == [] and found["deadline"] is None and found["title"] is None


def test_objects_come_in_the_order_of_the_text(spark):
    html = block('{"z": {"name": "first"}, "a": {"name": "second"}}') + block('[{"offers": [{"price": 3}], "name": "third"}]')
    found = spark.range(1).select(F.transform(markup.objects(F.lit(html)), lambda o: F.to_json(o)).alias("o")).first()["o"]
    assert [json.loads(o).get("name") for o in found] == [None, "first", "second", "third", None]


def test_adjudication(spark):
    day = datetime.date(2027, 7, 15)
    rows = [(1, "15th July 2027", day), (2, "15th July 2027", datetime.date(2027, 9, 1)), (3, None, day), (4, "15th July 2027", None), (5, "July 15, 2027", day)]
    df = spark.createDataFrame(rows, "id int, said string, d date").select("id", "said", F.struct(F.col("d").alias("deadline")).alias("f"))
    found = {r["id"]: r["ruling"] for r in markup.adjudicated(df, "said", "f").collect()}
    assert {i: r and (r["verdict"], r["confidence"], r["corroborated"]) for i, r in found.items()} == {
        1: ("healthy", 0.5, True), 2: ("extractor_drift", 0.5, False), 3: ("healthy", 0.5, False), 4: None, 5: ("healthy", 0.5, True),
    }


DAY = "18 September 2026"


ISO = "2026-09-18T00:00:00.000Z"
TOKEN = {"day": "TOKEN-1"}
#: By name: what the candidate gave on the incident and the anchor page, the shape of the day, protected fields, reasons.
TRIED = {
    "right": ({"i": {"day": DAY}, "a": TOKEN}, "date", [], []),
    "position": ({"i": {"day": DAY}, "a": {"day": DAY}}, "date", [], ["anchor: followed the decoy: reads a position"]),
    "something": ({"i": {"day": DAY}, "a": {"day": "Applications are open"}}, "date", [], ["anchor: did not give the token: not shown to read the label"]),
    "never ran": ({"i": {"day": DAY}}, "date", [], ["anchor: was never run"]),
    "same day": ({"i": {"day": ISO}, "a": TOKEN}, "date", [], []),
    "no day": ({"i": {"day": ISO}, "a": TOKEN}, None, [], ["incident: wrong day"]),
    "wrong day": ({"i": {"day": "2026-09-01"}, "a": TOKEN}, "date", [], ["incident: wrong day"]),
    "nothing": ({"i": {"day": None}, "a": TOKEN}, "date", ["day"], ["incident: protected day is missing", "incident: wrong day"]),
    "no row": ({"i": None, "a": TOKEN}, "date", ["day"], ["incident: gave no row"]),
    "error": ({"i": {"error": "blocked"}, "a": TOKEN}, "date", [], ["incident: blocked", "incident: fails structure:collector_error"]),
}


def test_repairs(spark):
    """An anchor tells a label from a position; dates are days; what never ran, failed or is missing blocks a repair."""
    cases = [(p, label, label, url) for p in TRIED for label, url in (("incident", "i"), ("anchor", "a"))]
    pins = [x for p in TRIED for x in ((p, "incident", "day", DAY, None), (p, "anchor", "day", "TOKEN-1", DAY))]
    given = gate.Repairs(
        spark.createDataFrame([(p, p) for p in TRIED], "repair_id string, collector_id string"),
        spark.createDataFrame(cases, "repair_id string, label string, kind string, url string"),
        spark.createDataFrame(pins, "repair_id string, label string, path string, value string, decoy string"),
        spark.createDataFrame([(p, url) for p, (pages, *_) in TRIED.items() for url in pages], "repair_id string, url string"),
        spark.createDataFrame([(p, url, 0, json.dumps(row)) for p, (pages, *_) in TRIED.items() for url, row in pages.items() if row], "repair_id string, url string, row_no int, j string").select("repair_id", "url", "row_no", F.parse_json("j").alias("row")),
    )
    collectors, *_, contracts = observed(spark, {p: {"specs": [{"path": "day", "shape": shape}], "protected": protected} for p, (_, shape, protected, _) in TRIED.items()})
    found = {r["repair_id"]: (r["approved"], r["reasons"]) for r in gate.judge_repairs(given, collectors, contracts).collect()}
    assert found == {p: (not reasons, reasons) for p, (*_, reasons) in TRIED.items()}
    texts = {r["repair_id"]: r["text"] for r in gate.matrix(gate.judge_cases(given, collectors)).collect()}
    assert [line.split()[:2] for line in texts["position"].splitlines()] == [["PASS", "incident"], ["FAIL", "anchor"]]


def test_drift_score_of_the_six_readings(spark):
    rows = [
        (True, "249", "$249", "249", False), (True, "249", "$229", "229", False), (True, "249", "$25", "249", True),
        (True, "249", "0", "249", True), (True, "249", "$99", "249", True), (False, "In stock", None, None, True),
    ]
    df = spark.createDataFrame(rows, "number boolean, known string, collector string, witness string, fault boolean")
    found = {r["method"]: (r["detected"], r["restrained"], r["score"]) for r in gate.drift_score(gate.notices(df)).collect()}
    assert found == {"conventional": (2, 2, 67), "monitor": (4, 1, 83), "two_sensors": (4, 2, 100)}


def test_safeguards(spark):
    bodies = ['{"product_name":"x","price":"$9","availability":"yes"}', '{"product_name":"x","price":0,"availability":"yes"}', '{"product_name":"","price":null,"availability":"yes"}', "{}", None]
    df = spark.createDataFrame([(b,) for b in bodies], "j string").withColumn("v", F.try_parse_json("j"))
    found = [r["s"].asDict() for r in df.select(gate.safeguards(F.col("v"), F.lit(True), "price", ["product_name", "availability"]).alias("s")).collect()]
    assert all(found[0].values()) and [k for k, ok in found[1].items() if not ok] == ["range", "schema"]
    assert [k for k, ok in found[2].items() if not ok] == ["not_null", "type", "range", "schema"]
    assert not found[3]["filled"] and not found[3]["present"] and not found[4]["valid"]


def test_tables_that_grow_with_the_runs_are_not_broadcast(spark):
    """However small they look to the planner: exploded and filtered tables are far larger than it takes them for."""
    of = lambda rows, schema: kept(spark.createDataFrame(rows, schema))
    given = gate.Repairs(
        of([("x", "c")], "repair_id string, collector_id string"),
        of([("x", "incident", "incident", "i")], "repair_id string, label string, kind string, url string"),
        of([("x", "incident", "day", DAY, None)], "repair_id string, label string, path string, value string, decoy string"),
        of([("x", "i")], "repair_id string, url string"),
        of([("x", "i", n, json.dumps({"day": day})) for n, day in ((1, "no day"), (0, DAY))], "repair_id string, url string, row_no int, j string").select("repair_id", "url", "row_no", F.parse_json("j").alias("row")),
    )
    collectors = spark.createDataFrame([("c", [("day", "date", False)])], f"collector_id string, specs {observe.SPECS}")
    judged = gate.judge_cases(given, collectors)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [repair_id" in line or "BroadcastHashJoin [run_id" in line]
    assert [r["passed"] for r in judged.collect()] == [True]  # by its first row


def test_walks_read_a_text_or_member_once(spark):
    """Objects are put in order without being written and parsed again; a leaf is not opened at every level."""
    plan = lambda c: spark.range(1).select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "to_json" not in plan(markup.objects(F.lit("")))
    assert "leaf" in plan(paths.leaves(F.parse_json(F.lit("{}"))))
    page = '<script type="application/ld+json">{"z":{"n":"{","a":[{"n":"1"},5,"[",{"m":{"n":"2"}}]},"b":{"n":"3"}}</script>'
    found = spark.range(1).select(F.transform(markup.objects(F.lit(page)), lambda o: F.to_json(o)).alias("x")).first()["x"]
    names = [json.loads(x) for x in found]
    assert [sorted(o) for o in names] == [["b", "z"], ["a", "n"], ["n"], ["m"], ["n"], ["n"]] and [o["n"] for o in names[1:] if "n" in o] == ["{", "1", "2", "3"]
