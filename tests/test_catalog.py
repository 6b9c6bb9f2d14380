"""Every core query against its SQL, on the smallest tables."""

import math
import re

import duckdb
import pytest

from loomtext import catalog, catalog_derived  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = df.collect()
    if name in catalog.ORACLE_SQL:
        rel = con.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, rel.fetchall())


def test_code_share_keeps_documents_with_code(spark, tmp_path):
    long = "x = 1\n" * 20
    texts = ["plain", "", None, f"a ```py\n{long}``` b <PRE>{long}</PRE>", f"[code]{long}[/code] ```short```", f"```\n{long}", f"<pre>{long} ```py\n{long}```</pre>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_blocks, r.code_ratio) for r in catalog.QUERIES["code_share"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        rest, sizes = t or "", []
        for pattern in (r"(?s)```[a-zA-Z0-9]*\n(.*?)```", r"(?is)<pre>(.*?)</pre>", r"(?is)\[code\](.*?)\[/code\]"):
            sizes += [n for x in re.findall(pattern, rest) if (n := len(x.strip())) >= 50]
            rest = re.sub(pattern, "", rest)
        want[i] = (len(sizes), sum(sizes) / len(t) if t else 0.0)
    assert got.keys() == want.keys() and any(n for n, _ in got.values())
    assert all(got[i][0] == n and got[i][1] == pytest.approx(share) for i, (n, share) in want.items())


def test_bookmark_sources_keeps_pages_of_one_url(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.org/x"), (2, "https://a.org/x"), (10, "https://a.org/x"), (3, "https://a.org/y.pdf?a=1&b=2")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    rel = c.execute(catalog.ORACLE_SQL["bookmark_sources"])
    names = [d[0] for d in rel.description]
    df = catalog.QUERIES["bookmark_sources"](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows(names, rel.fetchall()) and df.count() == 4


@pytest.mark.parametrize("name", ["score_histogram", "quality_metrics"])
def test_scores_near_a_half_round_as_in_sql(spark, tmp_path, name):
    sizes = [(510, 399), (500, 399), (490, 399), (570, 389), (180, 145), (2294, 1305), (2000, 1001), (2000, 1023), (4000, 2006)]
    texts = ["ab" * (n // 2) + "a" * (n % 2) + "-" * (size - n) for size, n in sizes] + ["a\nb\n" * 4 + "c\n" * 3, "", "word"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = c.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows(names, rel.fetchall())
