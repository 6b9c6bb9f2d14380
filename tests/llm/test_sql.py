"""Queries with SQL against it, and the shape of the others' results, on the smallest tables."""

import duckdb
import pytest

from loomtext.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mix_sources": {"doc_id", "size", "source_size", "target", "taken"}, "op3_pack_sequences": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op7_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}, "op9_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in queries.ORACLE_SQL:
        assert COLUMNS[name] <= set(df.columns) and got
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda n, rows: sorted(tuple(str(r[n.index(c)]) for c in sorted(n)) for r in rows)
    assert key(df.columns, got) == key(names, rel.fetchall())
