"""The operators that SQL can state against their DuckDB forms, on the test tables and on rows at the edges."""

import duckdb
import pandas as pd
import pytest

from larkspar.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
KEY = "aB3" * 13 + "x"
TEXTS = [
    None, "", "no secret here", "token=api_key : longvalue99", 'PassWord: "abcdefgh" secret=short', "x\u0001token=abcdefgh1\u0001y", "ſecret=abcdefghi",
    "é😀 api_key = 'ZZZZZZZZ9' AKIAABCDEFGHIJKL AKIAA", f"username=bob and {KEY}", f"username=bob {'z ' * 150} {KEY}", "https://example.com/path token=abcdefgh",
    "ab" * 150, "é" * 99, "é" * 100 + "é", "x" * 200, "x" * 200, "y" * 1400 + "z", "z" + "y" * 1400, "".join(chr(97 + i * i % 23) for i in range(2500)),
    "head " + "".join(chr(97 + i * i % 23) for i in range(900, 1300)) + " tail",
]


def compared(df, con, sql):
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(rows, key=repr)
    assert key(tuple(r[c] for c in names) for r in df.collect()) == key(want.fetchall())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    compared(queries()[name](spark, SF), con, oracle_sql()[name])


@pytest.mark.parametrize("name", ["op6_suffix_array_dedup", "op9_secret_scan"])
def test_edge_texts_equal_duckdb(spark, tmp_path, name):
    pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    compared(queries()[name](spark, str(tmp_path)), con, oracle_sql()[name])


def test_edge_vectors_equal_duckdb(spark, tmp_path):
    near = [[1.0, 0.1], [1.0, 0.0], [1.0, 0.35], [0.0, 1.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, None], [1.0, 0.0, 0.0], [1.0, 0.0]]
    rows = pd.DataFrame({"vec_id": range(10), "embedding": near, "label": pd.array([1] * 9 + [None], "Int32")})
    rows.to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    compared(queries()["op2_embedding_near_dedup"](spark, str(tmp_path)), con, oracle_sql()["op2_embedding_near_dedup"])
