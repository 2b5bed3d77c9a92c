"""Stateful streams against plain loops, on the smallest sample."""

import collections
import random
import tracemalloc

import pandas as pd
from lumenyard.plans import streams
from lumenyard.streaming import limits

SF = "/root/testdata/sf0.001"


def admitted(rows):
    held, out = collections.defaultdict(list), []
    for user, at in rows:
        seconds = at.timestamp()
        held[user] = [s for s in held[user] if s > seconds - 3600]
        ok = len(held[user]) < 5
        if ok:
            held[user].append(seconds)
        out.append((user, ok))
    return collections.Counter(out)


def test_sliding_window():
    assert limits.admit([], [0, 1, 2, 3, 4, 5, 3600.5, 3601.5], 5, 3600)[0] == [True] * 5 + [False, True, True]


def test_limited_batch_and_stream(spark):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts"])
    expected = admitted(zip(events.user_id, events.ts))
    for query in (streams.st03, streams.st03_stream):
        found = collections.Counter((r["user_id"], r["admitted"]) for r in query(spark, SF).collect())
        assert found == expected


def test_histories(spark):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts"])
    state, legal = {}, collections.Counter()
    for user, kind in zip(events.user_id, events.event_type):
        ok = (state.get(user, "signup"), kind) in streams.EDGES
        if ok:
            state[user] = kind
        legal[user, ok] += 1
    found = collections.Counter((r["user_id"], r["legal"]) for r in streams.st07(spark, SF).collect())
    assert found == legal


def test_a_user_of_several_arrow_batches(spark, tmp_path):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    draw = random.Random(6)
    kinds = [draw.choice(["view", "click", "purchase"]) for _ in range(400)]
    rows = [(1, kind, i) for i, kind in enumerate(kinds)] + [(2, "view", 3), (2, "purchase", 4)]
    draw.shuffle(rows)
    spark.createDataFrame(rows, "user_id int, event_type string, seq bigint").coalesce(1).write.parquet(f"{tmp_path}/events")
    state, expected = {}, collections.Counter()
    for user, kind, _ in sorted(rows, key=lambda r: r[2]):
        ok = (state.get(user, "signup"), kind) in streams.EDGES
        state[user] = kind if ok else state.get(user, "signup")
        expected[user, kind, ok] += 1
    spark.conf.set(setting, "7")
    try:
        source = spark.readStream.schema("user_id int, event_type string, seq bigint").parquet(f"{tmp_path}/events")
        found = streams._drained(limits.lifecycle_stream(source, "user_id", "event_type", streams.EDGES, start="signup"))
        assert collections.Counter((r["user_id"], r["event_type"], r["legal"]) for r in found.collect()) == expected
        start = pd.Timestamp("2024-01-01")
        asked = [(user, (start + pd.Timedelta(seconds=97 * seq)).to_pydatetime(), seq) for user, _, seq in rows]
        one = limits.limited(spark.createDataFrame(asked, "user_id int, ts timestamp_ntz, n bigint"), "user_id", "ts")
        assert "FlatMapGroupsInPandas" not in one._jdf.queryExecution().toString()
        assert collections.Counter((r["user_id"], r["admitted"]) for r in one.collect()) == admitted(sorted((u, t) for u, t, _ in asked))
    finally:
        spark.conf.set(setting, before)


def rulings(rows, overall):
    """Every request's ruling by a plain loop over all requests in time order."""
    held, out = [], collections.Counter()
    for at, user in sorted(rows):
        held = [(s, u) for s, u in held if s > at - 3600]
        own = sum(u == user for _, u in held)
        ruling = "busy" if len(held) >= overall else "caller" if own >= 5 else "admitted"
        if ruling == "admitted":
            held.append((at, user))
        out[user, ruling] += 1
    return out


def test_limit_for_all_callers_together(spark):
    events = pd.read_parquet(f"{SF}/events.parquet")
    rows = [(at.timestamp(), str(user)) for at, user in zip(events.ts, events.user_id)]
    few = limits.Limits(overall=3)
    expected = rulings(rows, 3)
    assert {r for _, r in expected} == {"busy", "admitted"}
    own = streams.table(spark, SF, "events").selectExpr("cast(user_id as string) as user_id", "ts", "event_id")
    found = limits.limited_overall(own, "user_id", "ts", few)
    assert collections.Counter((r["user_id"], r["ruling"]) for r in found.collect()) == expected
    stream = streams._stream(spark, SF, "events").selectExpr("cast(user_id as string) as user_id", "ts")
    found = streams._drained(limits.limited_overall_stream(stream, "user_id", "ts", few))
    assert collections.Counter((r["user_id"], r["ruling"]) for r in found.collect()) == expected


def test_limit_over_pauses_and_odd_requests(spark):
    start = pd.Timestamp("2024-01-01")
    draw = random.Random(8)
    times = [s for spell in (0, 9000, 40000) for s in sorted(draw.uniform(spell, spell + 5000) for _ in range(150))]
    rows = [((start + pd.Timedelta(seconds=s)).to_pydatetime(), draw.choice("abcd"), "own") for s in times] + [(None, "a", "own"), (None, None, "own")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, who string, ruling string").repartition(4)
    expected = rulings([((t - start.to_pydatetime()).total_seconds(), w) for t, w, _ in rows if t], 12)
    expected["a", "undated"] += 1
    expected[None, "undated"] += 1
    found = limits.limited_overall(df, "who", "ts", limits.Limits(overall=12))
    assert collections.Counter((r["who"], r["ruling"]) for r in found.collect()) == expected
    assert {r for _, r in expected} == {"busy", "caller", "admitted", "undated"}


def test_limit_for_all_over_many_chunks(spark, monkeypatch):
    """A busy spell is put in order in many tasks; one sees no more of it than packed callers and times."""
    monkeypatch.setattr(limits, "CHUNK", 100)
    monkeypatch.setattr(limits, "PIECE", 16)
    start, draw = pd.Timestamp("2024-01-01"), random.Random(9)
    times = [draw.randrange(60_000) for _ in range(1500)] + [100_000 + draw.randrange(20) for _ in range(300)] + [200_000 + 9000 * k for k in range(5)]
    rows = [((start + pd.Timedelta(seconds=s)).to_pydatetime(), draw.choice(["a", "b", "c", "d", None]), i) for i, s in enumerate(times)] + [(None, draw.choice("ab"), -i) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, who string, i bigint").repartition(3)
    places, expected = limits.Window(limits.Limits(per_caller=4, overall=11)), {}
    for t, who, i in sorted(rows, key=lambda r: (r[0] is None, r[0] or start, r[1] is None, r[1] or "", r[2])):
        expected[i] = places.take(who, float("nan") if t is None else pd.Timestamp(t).timestamp())
    for given in (df, df.withColumn("ts", limits.F.col("ts").cast("timestamp"))):
        found = limits.limited_overall(given, "who", "ts", places.limits)
        assert found.columns == ["ts", "who", "i", "ruling"]
        assert sorted((r["i"], r["ruling"]) for r in found.collect()) == sorted(expected.items())
    assert set(expected.values()) == {"busy", "caller", "admitted", "undated"}
    parts = limits._chunks(df, "ts", 3600.0).filter("__run is not null").groupBy("__run", "__chunk").count().collect()
    assert len(parts) > 15 and sorted(r["count"] for r in parts)[-2] < 300  # 300 requests stand in one cell
    assert limits.limited_overall(df.limit(0), "who", "ts").count() == 0


def test_requests_without_a_time_are_refused(spark, tmp_path):
    rows = [(1, None)] * 4 + [(1, pd.Timestamp("2024-01-01").to_pydatetime())]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz")
    asked = lambda found: sorted((r["ts"] is not None, r["admitted"]) for r in found.collect())
    assert asked(limits.limited(df, "user_id", "ts", limit=2)) == [(False, False)] * 4 + [(True, True)]
    df.write.parquet(f"{tmp_path}/requests")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/requests")
    assert asked(streams._drained(limits.limited_stream(stream, "user_id", "ts", limit=2))) == [(False, False)] * 4 + [(True, True)]


def test_a_micro_batch_for_all_callers_holds_little_of_each_request(spark):
    """A time, a number and a place of each request: no objects, which would take hundreds of bytes."""
    n, size = 200_000, 10_000

    class Stream:
        dtypes = [("who", "string"), ("ts", "timestamp")]
        select = groupBy = lambda self, *_: self
        applyInPandasWithState = lambda self, run, *_: run

    class State:
        exists, kept = False, None
        update = lambda self, value: setattr(self, "kept", value)

    def batches():
        for at in range(0, n, size):
            ks = range(at, at + size)
            yield pd.DataFrame({"who": [None if k % 97 == 0 else f"caller {k % 50}" for k in ks], "ts": pd.to_datetime([(k * 7919 % n) * 1000 for k in ks], unit="ms")})

    state, run = State(), limits.limited_overall_stream(Stream(), "who", "ts", limits.Limits(overall=20))
    tracemalloc.start()
    out = collections.Counter()
    for found in run((0,), batches(), state):
        out.update(found["ruling"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * n
    places = limits.Window(limits.Limits(overall=20))
    asked = sorted(((k * 7919 % n) * 1.0, k % 97 == 0, "" if k % 97 == 0 else f"caller {k % 50}") for k in range(n))
    assert out == collections.Counter(places.take(None if none else who, at) for at, none, who in asked)
