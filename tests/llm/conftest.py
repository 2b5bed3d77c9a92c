import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, folder, docs, labels=(), benchmark=(), pages=(), schema=DOCS):
    spark.createDataFrame(list(docs), schema).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id bigint, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(pages), "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls, empty, repeated and very long texts, ties, and columns named as the operators name theirs."""
    long = "A rather long text, number %d of many. " * 5000
    rows = [
        (1, "The MIT License. Some words here.", "en", "a"),
        (1, "The MIT License. Some words here.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (None, "a row without an id", "en", "b"),
        (4, "1234 5678 !!! ...", "en", "b"),
        (5, long % tuple(range(5000)), "en", "b"),
        (6, "un petit texte en français, déjà vu", "fr", "c"),
        (7, "same words in another row", "en", "c"),
        (8, "same words in another row", "en", "c"),
        (9, "x", None, "d"),
        (10, "\x1c \x85 odd blanks　and \U0001f600 <|endoftext|> it's", "en", "d"),
        (11, " \n\t ", "en", "d"),
    ]
    docs = [(i, t, la, s, None, "own", 0.5, 7, "own", 1) for i, t, la, s in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, quality_score double, bench_hit int, fp string, row int"
    labels = [(1, 1, 0), (1, 1, 0), (2, 0, 0), (4, 0, None), (7, None, 0), (None, 1, 0), (99, 1, 0), (6, 1, 0)]
    bench = [(1, "same words in another row"), (2, None), (3, ""), (None, "x"), (4, "the mit license"), (4, "the mit license")]
    pages = [(1, "http://A.example.com/en/1?x", '<a href="https://b.test/x">b</a>'), (2, None, None), (3, "no scheme", ""), (None, "http://x.net/de/1", None), (1, "http://A.example.com/en/1?x", None), (5, "http://h", "")]
    return write(spark, tmp_path_factory.mktemp("odd") / "t", docs, labels, bench, pages, schema)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty") / "t", [])


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    import pandas as pd

    return pd.read_parquet(f"{SF}/documents.parquet")
