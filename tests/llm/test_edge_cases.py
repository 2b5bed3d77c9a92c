"""Every operator's query, and every pipeline stage, on odd rows and on empty tables."""

import corpus_pipeline
import pytest
from lumenyard.llm import neardup
from lumenyard.llm.queries import QUERIES
from lumenyard.llm.shared import table

ROWS = {"op6_url_filters": 6, "op12_ranked_lexical_search": 10}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name == "op4_best_fit_packing":
        assert sum(r["piece"] == 0 for r in rows) == 13
    else:
        assert len(rows) == ROWS.get(name, 13)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_pipeline_on_odd_rows(spark, odd):
    docs = table(spark, odd, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd)
        assert docs.columns == columns
    assert {r["doc_id"] for r in docs.collect()} <= {None, 1, 4, 5, 6, 7, 8, 9, 10}
    assert corpus_pipeline.run(spark, odd).count() >= 1


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_defined_results_of_odd_rows(spark, odd):
    lang = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, odd).collect()}
    assert [lang[i]["lang_pred"] for i in (2, 3, 4, 11)] == ["und"] * 4 and lang[2]["score"] == 0
    quality = {r["doc_id"]: r["score"] for r in QUERIES["op2_quality_classifier"](spark, odd).collect()}
    assert quality[2] == quality[3] and all(0 <= s <= 1 for s in quality.values())
    groups = {r["doc_id"]: r for r in QUERIES["op10_simhash_near_dedup"](spark, odd).collect()}
    assert groups[2]["fingerprint"] == "0" * 16 and {groups[i]["component_id"] for i in (2, 3, 11)} == {2}
    assert groups[8]["component_id"] == 7 and groups[None]["component_id"] is None
    hit = {r["doc_id"]: r for r in QUERIES["op8_benchmark_decontamination"](spark, odd).collect()}
    assert hit[7]["n_hit"] == 5 and hit[1]["n_hit"] == 3 and hit[1]["n_items"] == 1 and not hit[9]["contaminated"] and hit[2]["n_words"] == 0
    url = {r["page_id"]: r for r in QUERIES["op6_url_filters"](spark, odd).collect()}
    assert url[1]["host"] == "a.example.com" and url[1]["rule"] == "com/en/" and url[1]["verdict"] == "block"
    assert (url[2]["host"], url[2]["path"], url[2]["rule"], url[2]["verdict"]) == ("", "", None, "allow")
    assert (url[5]["host"], url[5]["path"]) == ("h", "") and url[None]["verdict"] == "allow"
    model = {r["doc_id"]: r for r in QUERIES["op1_lm_scoring"](spark, odd).collect()}
    assert model[2]["n_tokens"] == model[3]["n_tokens"] == 1 and model[2]["score"] == model[3]["score"] < 0
    prints = {r["doc_id"]: r for r in QUERIES["op9_document_fingerprints"](spark, odd).collect()}
    assert prints[2]["fingerprint"] == "" and prints[7]["fingerprint"] == prints[8]["fingerprint"] and prints[7]["near_next"] == 1


def test_near_dedup_keeps_different_texts_without_an_id_or_with_the_same(spark):
    text = lambda i: " ".join(f"{w}{i}" for w in "several words that no other row has in this small table".split())
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (8, text(0)), (9, text(5)), (3, text(5)), (-(1 << 63), text(6))]
    kept = neardup.keep_one(spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id bigint, text string, source string").repartition(3))
    assert kept.columns == ["doc_id", "text", "source"]
    expected = [(8, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (3, text(5)), (-(1 << 63), text(6))]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((str(i), t) for i, t in expected)


def test_defined_results_of_tokens_and_search(spark, odd):
    coded = {r["doc_id"]: r for r in QUERIES["op13_byte_bpe"](spark, odd).collect()}
    empty_sha = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert all((coded[i]["n_tokens"], coded[i]["ids_sha256"], coded[i]["decoded_sha256"]) == (0, empty_sha, empty_sha) for i in (2, 3))
    assert coded[7]["ids_sha256"] == coded[8]["ids_sha256"] and coded[10]["n_tokens"] > 10
    links = {r["doc_id"]: r for r in QUERIES["op11_cross_tokenizer_alignment"](spark, odd).collect()}
    assert all(tuple(links[i])[1:] == (0,) * 7 + ("",) or (links[i]["n_a"], links[i]["groups_sha256"]) == (0, "") for i in (2, 3))
    assert links[7]["count_sum"] == links[8]["count_sum"] > 0 and links[5]["n_links"] > 25_000
    ranked = [(r["item_id"], r["rank"], r["doc_id"]) for r in QUERIES["op12_ranked_lexical_search"](spark, odd).collect()]
    assert [d for i, k, d in sorted(ranked, key=str) if i == 1 and k < 3] == [7, 8] and (None, 1, 9) in ranked
    assert sorted((k, d) for i, k, d in ranked if i == 4) == [(1, 1), (1, 1), (2, 1), (2, 1)]
