"""Ranked search against SQL and against every score computed one by one."""

import math
import re
from collections import Counter

import duckdb
import pytest
from lumenyard.llm import lexical
from lumenyard.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAME = "op12_ranked_lexical_search"


def terms_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical.TERM, lower)


def brute(docs, items, top):
    held = [(i, terms_of(t)) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, counts, size in held:
            m = 100 - 90 + (90 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in set(terms_of(text)) if counts[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def test_query_against_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = duck.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES[NAME]})").fetchall()
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in QUERIES[NAME](spark, SF).collect()) == sorted(rows)


DOCS = [
    (1, "A quick brown fox. A quick dog!"),
    (2, None),
    (3, ""),
    (4, "... --- ..."),
    (5, "quick quick quick QUICK"),
    (None, "brown dog without an id"),
    (6, "same text twice, brown"),
    (6, "same text twice, brown"),
    (7, "same text twice, brown"),
    (8, "déjà vu, Éa"),
    (-9, "zebra brown"),
    (10, "filler words " * 60_000 + "zebra"),
    *((100 + k, f"common w{k % 7} w{k % 11} " + "pad " * (k % 30)) for k in range(300)),
]
ITEMS = [(1, "quick brown"), (1, "quick brown"), (2, None), (3, ""), (None, "zebra, zebra!"), (4, "nothing of this"), (5, "same text"), (6, "éa Éa déjà"), (7, "common w3 w5 pad"), (7, "filler")]


@pytest.mark.parametrize(("block", "top", "item_terms"), [(4096, 10, 10**6), (3, 10, 4), (50, 2, 10**6), (1, 1, 10**6)])
def test_search_against_brute_force(spark, block, top, item_terms):
    docs = spark.createDataFrame([(i, t, "own") for i, t in DOCS], "doc_id bigint, text string, terms string").repartition(5)
    items = spark.createDataFrame([(i, t, "own") for i, t in ITEMS], "item_id bigint, text string, rank string")
    blocks, corpus = lexical.index(docs, block_docs=block)
    found = lexical.search(blocks, corpus, items, top, item_terms=item_terms)
    rows = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, brute(DOCS, ITEMS, top)))


def test_bytes_bound_impacts():
    import numpy as np

    tfs = np.array([1, 1, 2, 9, 10**6, 1], np.int64)
    norms = np.array([10, 10**9, 55, 11, 10, 125_000_000], np.int64)
    impacts = lexical.exact(tfs, norms)
    stored = -(-impacts // lexical.STEP)
    assert (stored <= 255).all() and (impacts <= stored * lexical.STEP).all()
    assert (impacts[stored > 0] > (stored[stored > 0] - 1) * lexical.STEP).all()


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(*lexical.index(none), items).collect() == []
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    assert lexical.search(*lexical.index(docs), items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search(*lexical.index(docs), items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_a_task_writes_and_reads_one_block_at_a_time(spark):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(k, f"common w{k}") for k in range(12)], "doc_id bigint, text string").coalesce(1)
    blocks, _ = lexical.index(docs, block_docs=3)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in blocks.inputFiles()]
    assert [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)] == [1, 1, 1, 1]
