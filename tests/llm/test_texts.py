"""Operators on texts against brute force: license scans, language ID, decontamination, fingerprints, near-duplicates."""

import hashlib
import random
import re
import struct

import numpy as np
import pandas as pd
import pytest
import xxhash
from lumenyard.llm import decontam, fingerprint, langid, licenses, neardup
from lumenyard.llm.queries import QUERIES
from pyspark.sql import functions as F

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if c < "\x80" else c for c in (t or ""))


def words(t):
    return WORD.findall(lower(t))


def test_license_base_phrases(spark, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    text = dict(zip(texts.doc_id, texts.text))
    for r in QUERIES["op5_license_scans"](spark, SF).collect():
        w = words(text[r["doc_id"]])
        places = [(i, x) for p, x in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        labels = lambda c: {x for x in r[c].split(",") if x}
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and labels("base_labels") <= labels("labels")


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}),
        ("under the terms of the GNU Lesser General Public License version 2.1", {"gpl", "lgpl", "lgpl-2.1"}),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
        ("released into the public domain", {"public-domain"}),
        ("MIT License", {"mit"}),
        ("general public license " * 300, {"gpl"}),
        ("distributed under the terms of the GNU Lesser General Public License", {"gpl", "lgpl"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", {"bsd"}),
        ("It is public-\ndomain text, released into the public\n domain.", {"public-domain"}),
        ("under the GPL license; licensed under the LGPL; AGPLv3", {"gpl", "lgpl", "agpl-3.0"}),
        ("you may not use this file except in compliance with the License", {"apache-2.0"}),
        ("either version 3 of the License, or (at your option) any later version", {"gpl-3.0-or-later"}),
        ("Creative Commons Attribution-ShareAlike 4.0", {"cc-by-sa"}),
        ("no such words", set()),
    ],
)
def test_license_suppression(spark, text, labels):
    row = licenses.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert {d["label"] for d in row["licenses"]} == labels
    assert len(licenses.SIGNATURES) > 150 and len(licenses.rules()) > 400


def brute_scan(text):
    """Every rule at every anchor word over the whole text, and suppression among all detections."""
    w = words(text)
    found, base = [], []
    for at, word in enumerate(w):
        for label, ahead in licenses.BASE:
            if word == "license" and w[max(0, at - len(ahead)) : at] == ahead:
                base.append((label, at - len(ahead), at + 1))
        context = "".join(f" {'@' if i == at else ''}{x}" for i, x in enumerate(w)) + " "
        for r in licenses.rules():
            if word.startswith(r.anchor) and (m := re.search(r.pattern, context)):
                start = context[: m.start()].count(" ")
                found.append((r.label, start, start + len(m[0].split()), r.priority))
    over = lambda e, d: e[1] <= d[1] and e[2] >= d[2] and (e[3] > d[3] or (e[3] == d[3] and e[2] - e[1] > d[2] - d[1]))
    return base, [d[:3] for d in found if not any(over(e, d) for e in found)]


def test_license_scan_against_brute_force(spark, texts):
    draw = random.Random(8)
    pieces = [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "GNU Lesser General Public License version 2.1, GPLv3 or LGPL 3.0; all rights reserved, Copyright (c) 2019 by Some One",
        "SPDX-License-Identifier: BSD-3-Clause MIT License the MIT license public domain Creative Commons Attribution-NonCommercial 4.0",
        "without warranty of any kind, express or implied; in no event shall the authors be liable",
        "license license licensed copyright gpl agpl commons domain permission",
    ]
    own = [" ".join(draw.choice([*pieces, "some plain words", "und auch"]) for _ in range(draw.randint(1, 12))) for _ in range(40)]
    own += [t for t in texts.text if re.search("(?i)licen", t)][:20]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id int, text string").repartition(4)
    for r in licenses.scan(df).collect():
        base, rest = brute_scan(own[r["doc_id"]])
        got = [(d["label"], d["start"], d["end"], d["base"]) for d in r["licenses"]]
        assert sorted(x[:3] for x in got if x[3]) == sorted(base)
        assert sorted(x[:3] for x in got if not x[3]) == sorted(rest), own[r["doc_id"]]


def test_phrases_are_greedy_parses():
    reference = b" abab cde "
    parser = langid.Parser((("a", reference), ("b", b" xyz ")))
    draw = random.Random(3)

    def greedy(ref, t):
        i = n = 0
        while i < len(t):
            j = i + 1
            while j < len(t) and t[i : j + 1] in ref:
                j += 1
            n, i = n + 1, j if t[i : i + 1] in ref else i + 1
        return n

    for _ in range(300):
        t = bytes(draw.choice(b"abcde xyzq") for _ in range(draw.randint(1, 60)))
        assert parser.phrases([t])[0].tolist() == [greedy(reference, t), greedy(b" xyz ", t)]


def test_a_copied_passage_is_one_phrase():
    reference = b" one passage of many words that a text copies whole and another has not "
    parser = langid.Parser((("a", reference), ("b", reference[::-1])))
    assert parser.phrases([reference, reference[5:40] * 2])[:, 0].tolist() == [1, 2]


def test_languages_in_several_passes(spark, texts):
    draw = random.Random(6)
    references = tuple((f"l{k}", langid.normal(" ".join(draw.choice(texts.text.tolist()[k].split() or ["x"]) for _ in range(80)))) for k in range(7))
    docs = spark.createDataFrame([(i, t, "own") for i, t in zip(texts.doc_id.tolist(), texts.text)] + [(-1, None, "own"), (-2, "\u00b2 \u2167 \u2460 12", "own")], "doc_id bigint, text string, lang_pred string")
    one = {r["doc_id"]: r for r in langid.identify(docs, references).collect()}
    two = {r["doc_id"]: r for r in langid.identify(docs, references, together=3).collect()}
    assert all(one[i]["lang_pred"] == two[i]["lang_pred"] and abs(one[i]["lang_score"] - two[i]["lang_score"]) < 1e-9 for i in one)
    assert [one[i]["lang_pred"] for i in (-1, -2)] == ["und", "und"]
    parser = langid.Parser(references)
    for i, t in zip(texts.doc_id.tolist(), texts.text):  # brute force
        if langid.has_letter(t):
            clean = langid.normal(t)
            bits = [n * b / len(clean) for n, b in zip(parser.phrases([clean])[0], parser.bits)]
            assert one[i]["lang_pred"] == parser.langs[int(np.argmin(bits))] and abs(one[i]["lang_entropy"] - min(bits)) < 1e-9


def test_language_held_out_accuracy(spark):
    truth = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").lang
    rows = [r for r in QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(rows) > 150 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.97


def brute_contamination(docs, bench):
    windows = {}
    for i, t in bench:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = {}
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark, texts):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    expected = brute_contamination(zip(texts.doc_id, texts.text), zip(bench.item_id, bench.text))
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op8_benchmark_decontamination"](spark, SF).collect()} == expected


def test_decontamination_in_blocks_and_shards(spark):
    draw = random.Random(5)
    text = lambda n: " ".join(draw.choice("abc") for _ in range(n))
    docs = [(i, text(draw.randint(0, 60))) for i in range(60)]
    bench = [(i, text(draw.choice([1, 3, 7, 13, 20]))) for i in range(3, 12)] + [(40, docs[7][1] + " a b"), (41, "d e")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    expected = brute_contamination(docs, bench)
    for kw in ({}, {"block_bytes": 40, "shard_words": 50}):
        rows = decontam.contamination(d, b, **kw).collect()
        assert {r["doc_id"]: (r["bench_words"], r["bench_hit"], len({m["item_id"] for m in r["bench_matches"]})) for r in rows} == {k: v[:3] for k, v in expected.items()}
        for r in rows:  # matches are verbatim
            own, item = words(dict(docs)[r["doc_id"]]), {str(i): words(t) for i, t in bench}
            assert all(own[m["doc_pos"] : m["doc_pos"] + m["length"]] == item[m["item_id"]][m["item_pos"] : m["item_pos"] + m["length"]] for m in r["bench_matches"])


def sketch(t):
    chain = lambda hs: [s := 42, [s := xxhash.xxh64_intdigest(struct.pack("<Q", h), s) for h in hs]][1][-1]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[\x20\x09-\x0d]+", t) if w]
    if not h:
        return []
    runs = [chain(h)] if len(h) < 5 else [chain(h[i : i + 5]) for i in range(len(h) - 4)]
    runs = sorted({r - (1 << 64) if r >> 63 else r for r in runs})
    return [r for r in runs if r < fingerprint.CUTOFF] or runs[:1]


@pytest.mark.parametrize("rows", [4000, 17])
def test_fingerprints(spark, texts, rows, monkeypatch):
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (lambda rows: rows, rows))
    d = texts.sort_values("doc_id")
    ids, own = d.doc_id.tolist(), d.text.tolist()
    sketches = [sketch(t) for t in own]
    hexed = lambda s: "".join(f"{h & (1 << 64) - 1:016X}" for h in s)
    found = {r["doc_id"]: r for r in QUERIES["op9_document_fingerprints"](spark, SF).collect()}
    for k, (i, t) in enumerate(zip(ids, own)):
        c = len(t) // 4
        edited = t[: len(t) - c] + own[(k + 1) % len(own)][:c]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(sketches[k]), hexed(sketch(edited)))
    true = lambda a, b: len(a & b) / max(1, len(a | b))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    gaps = []
    for k, (i, t) in enumerate(zip(ids, own)):
        c = len(t) // 4
        gaps.append(abs(found[i]["near_edited"] - true(grams(t), grams(t[: len(t) - c] + own[(k + 1) % len(own)][:c]))))
    assert np.mean(gaps) < 0.08


def test_merged_sketches_and_containment(spark):
    draw = random.Random(2)
    parts = [" ".join(f"w{draw.randint(0, 10**6)}" for _ in range(n)) for n in (60, 8000, 3, 0, 900)]
    rows = spark.createDataFrame([(parts[0], parts[1] + " " + parts[0] + " " + parts[4], parts[2], parts[3])], "short string, long string, three string, none string")
    sk = {c: fingerprint.sketch(F.col(c)) for c in rows.columns}
    found = rows.select(
        sk["three"].alias("of_three"),
        sk["none"].alias("of_none"),
        fingerprint.merged(sk["short"], sk["long"], sk["three"]).alias("all"),
        fingerprint.merged(sk["three"], sk["none"]).alias("few"),
        fingerprint.contained(sk["short"], sk["long"]).alias("within"),
        fingerprint.contained(sk["long"], sk["short"]).alias("back"),
        fingerprint.compared(sk["short"], sk["long"]).alias("pair"),
        fingerprint.contained(sk["none"], sk["long"]).alias("nothing"),
    ).first()
    every = set(sketch(parts[0])) | set(sketch(rows.first()["long"])) | set(sketch(parts[2]))
    assert found["all"] == sorted(h for h in every if h < fingerprint.CUTOFF)
    assert found["few"] == found["of_three"] == sketch(parts[2]) and len(found["of_three"]) == 1 and found["of_none"] == []
    assert found["within"] == found["pair"]["containment"] == 1 and found["back"] < 0.05 and found["nothing"] is None


def test_containment_of_short_texts_is_whole_or_not_known(spark):
    draw = random.Random(3)
    words = [f"w{draw.randint(0, 10**6)}" for _ in range(500)]
    rows = [(n, " ".join(words[at : at + n]), " ".join(words)) for n in range(1, 21) for at in range(0, 480, 24)]
    df = spark.createDataFrame(rows, "n int, short string, long string")
    a, b = fingerprint.sketch(F.col("short")), fingerprint.sketch(F.col("long"))
    found = df.select("n", "short", fingerprint.contained(a, b).alias("within"), fingerprint.compared(a, b)["containment"].alias("pair")).collect()
    for r in found:
        below = any(h < fingerprint.CUTOFF for h in sketch(r["short"]))
        assert r["within"] == r["pair"] == (1.0 if below and r["n"] > 4 else 0.0 if below else None)
    assert {1.0, None} <= {r["within"] for r in found if r["n"] == 6}


def test_plan_grows_by_one_step_as_ranges_double(spark):
    df = spark.range(640).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    steps = [fingerprint.with_next(df, ["text"], rows=n)._jdf.queryExecution().analyzed().toString().count("\n") for n in (320, 160, 10)]
    assert steps[1] - steps[0] == 3 and steps[2] - steps[0] == 15  # a projection and the two lines of its subquery each
    found = fingerprint.with_next(df, ["text"], rows=10).select("doc_id", F.col("next_text").cast("bigint").alias("n"))
    assert found.filter("n = (doc_id + 1) % 640").count() == found.count() == 640


def test_next_documents_where_one_id_fills_many_ranges(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, 7, 7, i]), f"text {draw.randint(0, 60)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = fingerprint.with_next(df, ["text", "doc_id"], rows=20)
    assert found.columns == ["doc_id", "text", "next_text", "next_doc_id"]
    got = found.collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t) for i, t in rows)
    tie = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    expected = sorted((str(a), str(b)) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted((str((r["doc_id"], r["text"])), str((r["next_doc_id"], r["next_text"]))) for r in got) == expected


def components(codes, limit=2):
    label = list(range(len(codes)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    a = np.array(codes, dtype=np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= limit)):
        x, y = top(i), top(j)
        label[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(codes))]


@pytest.mark.parametrize("group", [1000, 6])
def test_links_of_fingerprints(spark, group):
    draw = random.Random(1)
    codes = {draw.getrandbits(64) for _ in range(150)}
    for c in sorted(codes)[:30]:
        for _ in range(draw.randint(1, 25)):
            near = c
            for b in draw.sample(range(64), draw.randint(1, 3)):
                near ^= 1 << b
            codes.add(near)
            c = near if draw.random() < 0.5 else c
    codes = sorted(codes)
    expected = {}
    for c, k in zip(codes, components(codes)):
        expected.setdefault(k, set()).add(c)
    df = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp bigint")
    found = {}
    for r in neardup.components(neardup.link_forest(df, group)).collect():
        found.setdefault(r["label"], set()).add(r["node"] & (1 << 64) - 1)
    assert {frozenset(v) for v in found.values()} == {frozenset(v) for v in expected.values() if len(v) > 1}


def test_simhash_and_groups(spark, texts):
    def code(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", lower(t))
        grams = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = texts.doc_id.tolist()
    codes = [code(t) for t in texts.text]
    label = components(codes)
    first = {k: min(i for i, x in zip(ids, label) if x == k) for k in set(label)}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash_near_dedup"](spark, SF).collect()}
    assert found == {i: (f"{c:016x}", first[k]) for i, c, k in zip(ids, codes, label)}
