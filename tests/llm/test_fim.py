from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from tickbars.llm import fim
from tickbars.llm.queries import ORACLES, op11_fim

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    """The output, and the row of the report."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return text, (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 50:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return out, (doc_id, n, form, len(prefix), len(middle), sha(out), sha(text))


def test_query_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = op11_fim(spark, SF)
    assert got.columns == COLUMNS
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(brute(r.doc_id, r.text)[1] for r in docs)
    assert {r[2] for r in rows} >= {"psm", "spm"}


def test_sql_is_brute_force():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    docs = con.execute("select doc_id, text from documents").fetchall()
    cursor = con.execute(ORACLES["op11_fim"])
    assert [c[0] for c in cursor.description] == COLUMNS
    assert sorted(cursor.fetchall()) == sorted(brute(*d)[1] for d in docs)


ODD = [
    "", "one", "one\n", "\n", "\n\n\n", "a\nb\nc\nd\ne\nf", "with <P> in it\nand more", "<S>", "no <M", "é\nü\U0001f600\n日本\n",
    "\r\n\u2028x\x0by\n", "<P\n>", "x" * 5000, "line\n" * 3000, "\n" * 700 + "y" * 900,
]


@pytest.mark.parametrize("piece_bytes", [1, 7, 64, fim.PIECE_BYTES])
def test_odd_texts_in_pieces_of_any_size(spark, piece_bytes):
    texts = ODD if piece_bytes > 1 else [t for t in ODD if len(t) < 100]
    rows = [(i, t) for t in texts for i in range(3)] + [(None, "a\nb\nc\nd"), (5, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, fim.fim_report(docs, piece_bytes).collect()), key=repr)
    assert got == sorted((brute(*r)[1] for r in rows), key=repr)
    sizes = fim.pieces(docs, piece_bytes=piece_bytes).selectExpr("max(length(data))").first()[0]
    assert sizes <= piece_bytes + 3
    outputs = fim.transformed(docs, piece_bytes=piece_bytes).collect()
    assert sorted((repr(r.doc_id), r.form, r.output) for r in outputs) == sorted((repr(r[0]), brute(*r)[1][2], brute(*r)[0]) for r in rows)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a\nb\nc\n", "k", 0, "f")] * 5 + [(1, "other\ntext", "k", 0, "f"), (2, "a\nb\nc\n", "k", 1, "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, at int, form string").repartition(7)
    got = sorted(map(tuple, fim.fim_report(docs, 2).collect()))
    assert got == sorted(brute(r[0], r[1])[1] for r in rows)
    assert fim.fim_report(docs.where("false")).count() == 0 and fim.transformed(docs.where("false")).count() == 0


def test_one_exchange_and_two_sorts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = fim.fim_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def test_shares_of_forms(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "'a\nb\nc' as text")
    forms = {r.form: r.count for r in fim.transformed(docs, fim_percent=50, spm_percent=100).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"}
