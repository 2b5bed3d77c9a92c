"""Byte-level BPE against tiktoken, and alignment against token lists compared one by one."""

import base64
import hashlib
import random
from bisect import bisect_right
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from lumenyard.llm import alignment, bytebpe
from lumenyard.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SIGNS = list("ab'sS1 2  \n\t\r\x0b\x1c\x85\xa0 　 é日本語😀.,!?-<|>̈ʼſǅ٣Ⅷ ​\x00﻿") + ["<|endoftext|>", " 's", "'ll", " '", " the", "<s>", "<0x41>"]
ODD = [None, "", " ", "a", " a", "a ", "a  b   c ", "\n x", " same words", " same words", "▁", "a ▁b", "x" * 50_000, "日本" * 20_000, " " * 30_000, "ab1 " * 20_000, "line\n " * 9000]


def made(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(SIGNS, k=rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranked():
    import tiktoken

    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_ranks(ranked):
    coder = bytebpe.byte_bpe(public_tokenizers.path(bytebpe.VOCABULARY))
    texts = made(20_000, 1) + [t or "" for t in ODD]
    for _ in range(2):  # the second time from what is kept
        ids, begin = coder.encode(pa.array(texts))
        for text, a, z in zip(texts, begin, begin[1:]):
            assert ids[a:z].tolist() == ranked.encode_ordinary(text)
            assert coder.decode(ids[a:z].tolist()) == text.encode()
    assert coder.decode([None, -1, 10**6, ids[0]]) == coder.pieces[ids[0]]
    assert coder.encode(pa.array([], pa.string()))[0].tolist() == []


def test_whole_texts(spark, ranked, texts):
    found = {r["doc_id"]: r for r in QUERIES["op13_byte_bpe"](spark, SF).collect()}
    assert len(found) == len(texts)
    for doc_id, text in zip(texts.doc_id, texts.text):
        ids = ranked.encode_ordinary(text)
        row = found[doc_id]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_spans_and_split_characters(spark):
    texts = ["a 😀日é", "", None, "plain words here", "\U0001f9ff" * 3]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id bigint, text string, bpe_ids string")
    rows = bytebpe.decode(bytebpe.encode(df, spans=True), pieces=True).collect()
    coder = bytebpe.byte_bpe(public_tokenizers.path(bytebpe.VOCABULARY))
    for r in rows:
        text = r["text"] or ""
        assert r["bpe_text"] == text == "".join(r["bpe_pieces"]) and bytes(r["bpe_bytes"]) == text.encode()
        for i, at, first, end in zip(r["bpe_ids"], r["byte_starts"], r["char_starts"], r["char_ends"]):
            own = coder.pieces[i]
            assert text.encode()[at : at + len(own)] == own
            assert len(text.encode()[: at + 1].decode(errors="ignore")) in (first, first + 1)
            assert own in text[first:end].encode() and (first == end - 1 or own not in text[first + 1 : end].encode())
    # ids cut within a character: what is there of it is one replacement character
    ids = next(r["bpe_ids"] for r in rows if r["doc_id"] == 4)
    cut = bytebpe.decode(spark.createDataFrame([(ids[:-1],), (None,), ([],)], "bpe_ids array<int>")).collect()
    assert cut[0]["bpe_text"] == "\U0001f9ff" * 2 + "�" and cut[1]["bpe_text"] == cut[2]["bpe_text"] == ""


@pytest.fixture(scope="module")
def both():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = bytebpe.byte_bpe(public_tokenizers.path("byte_bpe_50k.json")).pieces

    def spans(ids, data):
        out, at = [], 0
        for i, d in zip(ids, data):
            out.append((at, at + len(d), i))
            at += len(d)
        return out

    def of(text):
        if not text:
            return [], [], [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_x = [table[i] for i in x]
        bytes_y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(bytes_x) == b"".join(bytes_y) == (" " + text).encode():
            return [], [], [], []
        one, two = spans(x, bytes_x), spans(y, bytes_y)
        begins = [s for s, _, _ in two]
        links = []
        for s, e, i in one:
            for other in two[max(0, bisect_right(begins, s) - 1) :]:
                if other[0] >= e:
                    break
                links.append((i, other[2]))
        groups, p, q = [], 0, 0
        for end in sorted({e for _, e, _ in one} & {e for _, e, _ in two}):
            p2, q2 = p, q
            while p2 < len(one) and one[p2][1] <= end:
                p2 += 1
            while q2 < len(two) and two[q2][1] <= end:
                q2 += 1
            groups.append((x[p:p2], y[q:q2]))
            p, q = p2, q2
        return x, y, groups, links

    return of


def expected(both, rows):
    found = [both(t) for _, t in rows]
    count = Counter(x for f in found for x in f[3])
    most: Counter = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), (a, b, groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best, total = sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), best, total, text))
    return sorted(map(str, out))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_products", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_alignment_of_odd_texts(spark, both, head):
    rows = list(enumerate(made(600, 2) + ODD)) + [(None, "no id"), (5, "an id twice"), (5, "an id twice")]
    df = spark.createDataFrame([(i, t, "own", "own") for i, t in rows], "doc_id bigint, text string, n_best string, __row string").repartition(3)
    found = alignment.scored(alignment.align(df).drop("text"), head=head)
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in found.collect()) == expected(both, rows)


def test_query_of_alignment(spark, both, texts):
    rows = list(zip(texts.doc_id.tolist(), texts.text.tolist()))
    exact = sorted(str((*eval(x)[:5], *eval(x)[6:8], hashlib.sha256(eval(x)[8].encode()).hexdigest() if eval(x)[8] else "")) for x in expected(both, rows))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r[c] for c in names)) for r in QUERIES["op11_cross_tokenizer_alignment"](spark, SF).collect()) == exact


def test_head_keeps_what_fits(spark):
    pairs = spark.createDataFrame([(i, 0, n) for i, n in enumerate([1, 1, 1, 2, 3, 4, 9])], "a int, b int, n bigint").withColumn("best", F.lit(False))
    sizes = {most: sorted(r["n"] for r in alignment.head_of(pairs, most).collect()) for most in (0, 1, 2, 3, 4, 6, 7)}
    assert sizes == {0: [], 1: [9], 2: [4, 9], 3: [4, 9], 4: [2, 3, 4, 9], 6: [2, 3, 4, 9], 7: [1, 1, 1, 2, 3, 4, 9]}


def test_a_worker_holds_a_bounded_number_of_pieces(ranked, texts, monkeypatch):
    monkeypatch.setattr(bytebpe, "KNOWN", 50)
    coder = bytebpe.ByteBpe(public_tokenizers.path(bytebpe.VOCABULARY))
    for at in range(0, len(texts), 20):
        some = texts.text[at : at + 20].tolist()
        ids, begin = coder.encode(pa.array(some, pa.string()))
        assert [ids[a:z].tolist() for a, z in zip(begin, begin[1:])] == [ranked.encode_ordinary(t) for t in some]
        assert 0 < len(coder.known) <= 50
    pieces = [f" piece{i}" for i in range(200)]
    for some in (pieces, pieces[:30], pieces[150:], pieces):  # many at once, and some that are kept
        assert [list(memoryview(x).cast("I")) for x in coder.ids_of(some)] == [ranked.encode_ordinary(p) for p in some]
        assert 0 < len(coder.known) <= 50


def test_a_round_trip_takes_one_worker_a_task(spark, odd):
    query = QUERIES["op13_byte_bpe"](spark, odd)
    assert query._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text")
    apart = bytebpe.decode(bytebpe.encode(docs))
    key = lambda r: (str(r["doc_id"]), r["bpe_ids"], bytes(r["bpe_bytes"]))
    together = bytebpe.round_trip(docs)
    assert together.columns == ["doc_id", "bpe_ids", "bpe_bytes"]
    assert sorted(map(key, together.collect())) == sorted(map(key, apart.collect()))
