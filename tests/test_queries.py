"""Every registered query against its SQL on DuckDB, over the smallest sample; and the library without its optional part."""

import datetime
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from lumenyard.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rel = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    expected = sorted(str(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in rel.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == expected


def test_merged_results_with_shared_positions_and_odd_urls(spark, tmp_path):
    """Half positions are rounded to even, pages of one batch then share one, and a text that is no address has no host."""
    name = "w04_merge_results"
    urls = [f"http://h{k % 5}.example.{'org' if k % 3 else 'net'}/{k // 2}" for k in range(40)] + ["no address", "ftp://x.test/1", None]
    order = [2, 6, 10, 14, 18, 22, 40, 41, 42, *(k for k in range(60) if k % 4 != 2 or k > 42)][: len(urls)]
    spark.createDataFrame(list(zip(order, urls[::-1])), "page_id bigint, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = sorted(c.execute(catalog.oracles()[name]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).select("url", "host", "official").collect()) == expected


def test_library_without_its_optional_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("lumenyard", "__spark_entry__.py"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "lumenyard" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
