from __future__ import annotations

import duckdb
import pytest

from tickbars.llm.queries import ORACLES

from . import test_automaton, test_positional

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def test_sql_of_repeats_is_brute_force(duck):
    docs = duck.execute("select doc_id, text from documents").fetchall()
    got = duck.execute(ORACLES["op7_automaton"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, test_automaton.brute(docs)))


def test_sql_of_contamination_is_brute_force(duck):
    docs = duck.execute("select doc_id, text from documents").fetchall()
    items = duck.execute("select item_id, text from benchmark").fetchall()
    got = duck.execute(ORACLES["op8_decontamination"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, test_positional.brute(docs, items)))
