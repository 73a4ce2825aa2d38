import re
import zlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, name):
    stage = dict(pipeline.STAGES)[name]
    empty = spark.createDataFrame([], COLUMNS)
    assert stage(spark, empty, "").count() == 0
    extra = ["score", "lang_pred", "gone", "doc_", "found", "h", "kept", "class_id", "n_lines"]
    rows = [(i, t, "en" if i is None or i % 2 else "de", None, None, *[f"{c}{i}" for c in extra]) for i, t in [(1, "some english words in a row"), (1, "some english words in a row"), (2, "ein paar deutsche worte"), (None, "more english words"), (3, None), (4, ""), (5, "wort " * 30_000)]]
    docs = spark.createDataFrame(rows, COLUMNS + "".join(f", {c} string" for c in extra))
    out = stage(spark, docs, "")
    found = out.collect()
    if name != pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
        assert all(r[c] == f"{c}{r['doc_id']}" for r in found for c in extra)
    assert found


def test_stage_decisions(spark):
    body = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, f"{body} here", "en"), (2, f"{body} there", "en"), (2, "another text under the same number, quite unlike", "en"), (7, "twin text of five words or more", "en"), (7, "twin text of five words or more", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = sorted(tuple(r)[:2] for r in pipeline.near_duplicates(spark, docs, "").collect())
    assert left == [(1, f"{body} here"), (2, rows[2][1]), (7, rows[3][1])]
    rest = pipeline.lines(spark, spark.createDataFrame([(1, "a long line that both of them hold, word for word\n"), (2, "a long line that both of them hold, word for word\n\t")], "doc_id long, text string"), "")
    assert [r["doc_id"] for r in rest.collect()] == [1]
    secret = pipeline.secret_scan(spark, spark.createDataFrame([(1, "password: hunter2hunter2 ok", 26)], "doc_id long, text string, n_chars long"), "")
    assert [tuple(r) for r in secret.collect()] == [(1, "[secret] ok", 11)]


def test_the_run_chains_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    want = {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    got = pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(text) == {r["doc_id"] for r in got}
    assert not any(re.search(r"AKIA[A-Z0-9]{12}", t) for t in text.values())
    fills = {}
    for r in got:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert max(fills.values()) <= 1024 and zlib.crc32(b"") == 0
