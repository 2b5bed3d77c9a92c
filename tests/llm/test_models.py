"""Models, packing, sharding, link graph and the pipeline against brute force or held-out labels."""

import collections
import math
import pathlib
import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
from lumenyard.llm import attention, lm_scoring, packing, sharding, subwords, urlfilter
from lumenyard.llm.queries import QUERIES
from lumenyard.llm.shared import shared_folder
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .conftest import SF


def test_subwords_are_the_tokenizers(texts):
    odd = ["It's DON'T <|endoftext|>x", "İstanbul ΣΑΣ ς ǅ", " nb sp　z \x1c\x1d\x85 é ä,", "日本語 テスト! 12 3a4b ½", "x'll!'s '' é,é", "", "   ", "a—b … “q” ﬁ", "É, ÀÉ. ÿ? ß! ×÷ µ"]
    own = odd + texts.text.tolist()
    plain = Tokenizer.from_file(subwords.vocabulary_path())
    expected = [np.array(e.ids, dtype="<u4").tobytes() for e in plain.encode_batch(own, add_special_tokens=False)]
    assert subwords.Subwords(subwords.vocabulary_path()).encode([t.encode() for t in own]) == expected


def test_packing(spark, texts):
    encode = subwords.Subwords(subwords.vocabulary_path())
    expected = {}
    for i, b in zip(texts.doc_id, encode.encode([t.encode() for t in texts.text])):
        ids = np.append(np.frombuffer(b, "<u4"), 1).astype("<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            expected[i, k] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    check_packing(rows, 4096, slack=1)


def check_packing(rows, room, slack):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / room) + slack


def test_packing_over_cells_and_islands(spark):
    draw = np.random.default_rng(2)
    lengths = [int(x) for x in np.minimum(100, draw.exponential(38, 900).astype(int) + 5)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id int, length bigint")
    found = packing.pack(rows, room=100, cell=150).collect()
    assert sorted((r["id"], r["length"]) for r in found) == list(enumerate(lengths))
    check_packing(found, 100, slack=12)


def test_genetic_steps_keep_all_pieces():
    import random

    draw = random.Random(4)
    lengths = [draw.randint(20, 70) for _ in range(120)]
    first = packing.best_fit(list(range(120)), lengths, [], 100)
    other = packing.loosen(first, lengths, 100, draw)
    for bins in (first, other, packing.cross(first, other, lengths, 100, draw)):
        assert sorted(i for _, own in bins for i in own) == list(range(120))
        assert all(load == sum(lengths[i] for i in own) <= 100 for load, own in bins)
    best = packing.evolve(lengths, 1, [], 100)
    assert [packing.fitness(b) for b in best] == sorted(packing.fitness(b) for b in best) and len(best[0]) <= len(first)


def longest_first(lengths, room):
    return packing.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, [], room)


def test_evolution_beats_best_fit_of_the_longest_first(monkeypatch):
    import random

    children = []
    monkeypatch.setattr(packing, "cross", lambda *a, own=packing.cross: children.append(1) or own(*a))
    for seed in range(3):  # bins of three pieces that fill them exactly
        draw, lengths = random.Random(seed), []
        for _ in range(40):
            a = draw.randint(380, 490)
            b = draw.randint(250, (1000 - a) // 2)
            lengths += [a, b, 1000 - a - b]
        assert len(packing.evolve(lengths, seed, [], 1000)[0]) <= len(longest_first(lengths, 1000)) - 2
    assert len(children) == 3 * 2 * packing.GENERATIONS


def test_packing_does_not_depend_on_how_rows_are_dealt(spark):
    draw = np.random.default_rng(5)
    rows = [(i, int(n)) for i, n in enumerate(draw.integers(1, 100, 500))]
    sizes = set()
    for parts in (1, 7):
        found = packing.pack(spark.createDataFrame(rows, "id int, length bigint").repartition(parts), room=100, cell=200).collect()
        assert sorted((r["id"], r["length"]) for r in found) == rows
        check_packing(found, 100, slack=8)
        sizes.add(len({r["sequence_id"] for r in found}))
    assert max(sizes) - min(sizes) <= 3


def test_shards(spark):
    text = lambda i: "same text" if i % 3 == 0 else f"text {i} " * (i % 40)
    docs = [(i, text(i), 1) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, shard int")
    for cell in (20000, 300):
        rows = sharding.shard(df, cell=cell).toPandas()
        assert sorted(rows.doc_id) == list(range(3000))
        assert all(r.size == len(text(r.doc_id)) + 8 and r.text_crc32 == zlib.crc32(text(r.doc_id).encode()) for r in rows.itertuples(index=False))
        size = rows.groupby("shard")["size"].sum()
        assert len(size) == 24 and (size.max() - size.min()) / size.mean() < 0.03
        assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard").slot)
        once = rows[rows.doc_id % 3 == 0]
        assert once.groupby("shard").size().max() < 400  # the large group is cut


def test_shards_balance_bytes_tokens_and_rows_jointly():
    draw = np.random.default_rng(1)
    sizes = np.stack([draw.exponential(2000, 6000) + 8, draw.exponential(300, 6000), draw.integers(1, 4, 6000)], axis=1).round()
    bins, _ = sharding.place(sizes, 24)
    total = np.stack([np.bincount(bins, weights=sizes[:, k], minlength=24) for k in range(3)], axis=1)
    spread = (total.max(axis=0) - total.min(axis=0)) / total.mean(axis=0)
    assert spread[0] < 1e-4 and spread[1] < 0.03 and spread[2] < 0.05, spread


def test_shard_query_keeps_its_law(spark, texts):
    rows = QUERIES["op7_sharding"](spark, SF).toPandas()
    text = dict(zip(texts.doc_id, texts.text))
    assert sorted(rows.doc_id) == sorted(text)
    assert all(r["size"] == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for _, r in rows.iterrows())
    assert set(rows.law) == {"bytes"} and rows.grown_shard.isna().all() and set(rows["shard"]) <= set(range(24))
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard").slot)


def test_personalised_pagerank(spark):
    links = [("a", "b", 1), ("b", "c", 2), ("b", "a", 1), ("c", "d", 1)]
    edges = spark.createDataFrame([("t", *x) for x in links] + [("other", "d", "a", 5)], "kind string, src string, dst string, n bigint")
    seeds = spark.createDataFrame([("t", "a", 1.0), ("other", "b", 1.0)], "kind string, host string, seed double")
    step = np.zeros((4, 4))
    step[0, 1] = step[2, 3] = 1
    step[1, 2], step[1, 0] = 2 / 3, 1 / 3
    mass = start = np.array([1.0, 0, 0, 0])
    for _ in range(urlfilter.STEPS):
        moved = 0.85 * mass @ step
        mass = moved + (1 - moved.sum()) * start
    found = {(r["kind"], r["host"]): r["mass"] for r in urlfilter.personalised(edges, seeds).collect()}
    assert np.allclose([found["t", h] for h in "abcd"], mass) and 0.85**urlfilter.STEPS <= urlfilter.LEFT
    assert found["other", "b"] == 1 and len(found) == 5  # a walk that finds no link stays at its seeds


def test_links_between_hosts_with_a_port_meet(spark):
    pages = [(1, "http://Bad.com:8080/en/1", ""), (2, "http://u@odd.io:81/", '<a href="https://bad.COM:8080/en/1">x</a>'), (3, "http://third.io", "<a href='//u@odd.io:81'>y</a>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert {(r["src"], r["dst"]) for r in urlfilter.host_links(df).collect()} == {("u@odd.io:81", "bad.com:8080"), ("third.io", "u@odd.io:81")}


def test_url_query_matches_its_sql(spark):
    import duckdb
    from lumenyard.llm.queries import ORACLES

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rel = c.execute(ORACLES["op6_url_filters"])
    names = [d[0] for d in rel.description]
    expected = sorted(map(str, ({n: r[names.index(n)] for n in sorted(names)} for r in rel.fetchall())))
    assert sorted(str({n: r[n] for n in sorted(names)}) for r in QUERIES["op6_url_filters"](spark, SF).collect()) == expected


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    pages = [(1, "http://bad.com/en/1", ""), (2, "http://friend.io/a", '<a href="//bad.com/en/1">x</a>'), (3, "http://good.net/de/1", '<A HREF=http://fine.io/>'), (4, "http://fine.io/x", ""), (5, "http://alone.io/", ""), (6, "https://sub.example.com/en/77", ""), (7, "https://example.net/de/81#x", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = {r["page_id"]: (r["verdict"], r["rule"]) for r in urlfilter.judge(df).collect()}
    assert found == {1: ("block", "com/en/"), 2: ("block", None), 3: ("allow", "net/de/"), 4: ("allow", None), 5: ("allow", None), 6: ("allow", "example.com/en/7"), 7: ("block", "example.net/de/8")}


def test_quality_held_out(spark):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id").quality
    rows = [r for r in QUERIES["op2_quality_classifier"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels.index]
    assert len(rows) > 50 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95
    assert all((r["score"] >= 0.3) == r["predicted"] and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def small_model(seed=0):
    draw = np.random.default_rng(seed)
    size = 1500
    counts = np.sort(draw.integers(0, 900, size))[::-1].copy()
    vocabulary = attention.Vocabulary.of(counts)
    params = attention.initial(vocabulary, counts)
    params["near"] += draw.standard_normal(params["near"].shape).astype(np.float32)
    return params, vocabulary, draw


def test_attention_probabilities_sum_to_one():
    params, vocabulary, draw = small_model()
    context = draw.integers(0, vocabulary.size, 20)
    base, total = None, 0.0
    texts = [np.append(context, i) for i in range(vocabulary.size)]
    inputs, goal, own = attention.windows([*texts, context], vocabulary)
    p = np.bincount(own, weights=attention.score_windows(params, vocabulary, inputs, goal))
    base = p[-1]
    total = np.exp(p[:-1] - base).sum()
    assert abs(total - 1) < 1e-3


def test_attention_gradients():
    params, vocabulary, draw = small_model()
    params = {k: v.astype(np.float64) for k, v in params.items()}
    inputs, goal, _ = attention.windows([draw.integers(0, vocabulary.size, n) for n in (5, 40)], vocabulary)
    _, g = attention.gradients(params, vocabulary, inputs, goal)
    for k in params:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        two = []
        for step in (1e-4, -2e-4):
            params[k][at] += step
            two.append(attention.gradients(params, vocabulary, inputs, goal)[0])
        params[k][at] += 1e-4
        assert abs((two[0] - two[1]) / 2e-4 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


def test_windows_score_every_id_once():
    _, vocabulary, draw = small_model()
    texts = [draw.integers(0, vocabulary.size, n) for n in (1, 16, 17, 50, 0)]
    inputs, goal, own = attention.windows(texts, vocabulary)
    assert [goal[own == i][goal[own == i] >= 0].tolist() for i in range(5)] == [t.tolist() for t in texts]
    assert inputs.shape[1] == attention.WIDTH and (inputs[own == 3][1, : attention.CONTEXT] == inputs[own == 3][0, -attention.CONTEXT :]).all()


def test_context_is_sixteen_to_thirty_one_ids_before_the_own_input():
    params, vocabulary, draw = small_model()
    text = draw.integers(0, vocabulary.size, 64)
    inputs, goal, _ = attention.windows([text], vocabulary)
    assert attention.HEADS == 2
    for place in (32, 40, 47):
        window, at = divmod(place, attention.STRIDE)
        before = inputs[window, : at + attention.CONTEXT]
        assert before.tolist() == vocabulary.input_of[text[place - 1 - len(before) : place - 1]].tolist() and 16 <= len(before) <= 31
    other = inputs.copy()
    other[2, 0] = (other[2, 0] + 1) % attention.KEPT  # the input 16 places before the window's first
    assert attention.score_windows(params, vocabulary, inputs, goal)[2] != attention.score_windows(params, vocabulary, other, goal)[2]


def test_lm_scores(spark, texts, monkeypatch):
    monkeypatch.setattr(lm_scoring.frequent, "__defaults__", (300,))
    counts, ends = collections.Counter(), 0
    for i, t in zip(texts.doc_id, texts.text):
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(t.encode().lower().split())
            ends += 1
    n = sum(counts.values()) + ends
    total = n + 0.1 * (len(counts) + 2)
    rows = {r["doc_id"]: r for r in QUERIES["op1_lm_scoring"](spark, SF).collect()}
    for i, t in zip(texts.doc_id, texts.text):
        w, r = t.encode().lower().split(), rows[i]
        base = sum(math.log10((counts[x] + 0.1) / total) for x in w) + math.log10((ends + 0.1) / total)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, 1 + sum(counts[x] > 0 for x in w), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["score"] < 0


def test_model_beats_the_word_counts_held_out(spark):
    held = [r for r in QUERIES["op1_lm_scoring"](spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_every_text_trains_in_every_round():
    _, vocabulary, draw = small_model(3)
    texts = [draw.integers(0, vocabulary.size, n) for n in (0, 1, 16, 17, 500, 16 * 640, 0, 3000)]
    m = [-(-len(t) // attention.STRIDE) for t in texts]
    first = np.cumsum(m) - m
    for _ in range(20):
        got = attention.share_of(texts, draw.integers(0, 1 << 32, len(texts)), 32)
        own = np.searchsorted(first, got, "right") - 1
        assert len(set(got)) == len(got) and all(np.diff(got) > 0)
        per = np.bincount(own, minlength=len(texts))
        some, every = attention.windows(texts, vocabulary, got), attention.windows(texts, vocabulary)
        assert all((x == y[got]).all() for x, y in zip(some, every))
        assert all(p == 0 if not k else k // 32 <= p <= -(-k // 32) or p == 1 for p, k in zip(per, m)) and per[5] == 20


def test_window_scores_match_a_plain_forward_pass():
    """score_windows against the loss of the separate forward pass that training differentiates, text by text."""
    params, vocabulary, draw = small_model(3)
    for n in (1, 15, 16, 40, 200):
        text = draw.integers(0, vocabulary.size, n)
        inputs, goal, _ = attention.windows([text], vocabulary)
        loss, _ = attention.gradients(params, vocabulary, inputs, goal)
        rest = vocabulary.rest[text].sum()  # constant in training, so not a part of its loss
        assert abs(attention.score_windows(params, vocabulary, inputs, goal).sum() - (rest - loss * n)) < 1e-3 * n


def test_pipeline_stages_filter_as_their_operators_judge(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
        assert docs.count() == len(kept[name])
    assert kept["language_id"] == set(texts.doc_id)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == kept["benchmark_decontamination"]
    check_packing(packed, 4096, slack=1)


def test_every_window_of_every_text_trains_the_model():
    """Over the rounds, each at least once; and windows that are built as they are needed train as those built before."""
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 2000, n).astype("<u2") for n in (0, 1, 16, 17, 40, 333, 1000)]
    starts = draw.integers(0, 1 << 32, len(texts))
    rounds, share = len(lm_scoring.RATES), lm_scoring.SHARE
    taken = [attention.share_of(texts, starts + number * (share // rounds), share) for number in range(rounds)]
    assert set(np.concatenate(taken).tolist()) == set(range(sum(-(-len(t) // attention.STRIDE) for t in texts)))
    counts = np.bincount(np.concatenate(texts), minlength=2001)
    vocabulary = attention.Vocabulary.of(counts)
    params = attention.initial(vocabulary, counts)
    built = attention.windows(texts, vocabulary, taken[0])[:2]
    assert attention.packed(attention.train_texts(params, vocabulary, texts, taken[0], 0.01)[0]) == attention.packed(attention.train(params, vocabulary, *built, 0.01)[0])


def test_sharding_writes_few_files(spark):
    """One for each partition of the input, and between levels one for each cell and not for each shuffle partition."""
    files = lambda: {f for f in pathlib.Path(shared_folder(spark).removeprefix("file://")).rglob("part-*")}
    docs = spark.range(2000, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id") % 1500).alias("text"))
    dealt = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept, before = {k: spark.conf.get(k) for k in dealt}, files()
    try:
        for k, v in dealt.items():
            spark.conf.set(k, v)
        rows = sharding.shard(docs, cell=500).toPandas()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(rows.doc_id) == list(range(2000)) and all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard").slot)
    assert 0 < len(files() - before) <= 14
