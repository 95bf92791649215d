from __future__ import annotations

import zlib

from tickbars.llm import language as L
from tickbars.llm.queries import op6_language

SF = "/root/testdata/sf0.01"


def test_query_over_all_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op6_language(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    asked = right = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        doc = docs[r.doc_id]
        if r.held_out and doc.lang and any(map(str.isalpha, doc.text or "")):
            asked += 1
            right += r.lang_pred == doc.lang
    assert asked > 150 and right / asked >= 0.97
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_held_out_rows_are_not_learnt(spark):
    ids = [i for i in range(40)]
    rows = [(i, "alpha beta gamma", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy") for i in ids]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert L.fit(df).names == ["yy"]


def test_odd_rows(spark):
    schema = "score string, doc_id bigint, text string, lang string, rejected int"
    en, de = "the house and the garden with a tree " * 3, "das haus und der garten mit einem baum " * 3
    rows = [("s", i, en if i % 2 else de, "en" if i % 2 else "de", 0) for i in range(60)]
    odd = [("s", 100, None, "en", 0), ("s", 101, "", None, 0), ("s", 102, "12 .;", "de", 0), ("s", None, en, None, 1)]
    odd += [("s", 103, de * 3000, None, 0), ("s", 104, "q", None, 0), ("s", 104, "q", None, 0)]
    df = spark.createDataFrame(rows + odd, schema)
    model = L.fit(df)
    assert sorted(model.names) == ["de", "en"]
    got = L.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.rejected))
    assert [found[i] for i in (100, 101, 102)] == [[("und", True)]] * 3
    assert found[None] == [("en", False)] and found[103] == [("de", False)]
    assert len(found[104]) == 2 and found[104][0] == found[104][1]
    assert all(found[i] == [("en" if i % 2 else "de", False)] for i in range(60))
    assert L.predict(df.where("false"), model).count() == 0
    nothing = L.fit(df.where("false"))
    assert {r.lang_pred for r in L.predict(df, nothing).collect()} == {"und"}
