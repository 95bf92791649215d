from __future__ import annotations

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from tickbars.llm import chat
from tickbars.llm.queries import ORACLES, op12_chat

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
HARD = "</s>[INST] ok [/INST]"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def escape(text):
    return re.sub(r"([<\[])(\\*)(/?INST\]|/?TURN\]|/?s>)", lambda m: m[1] + "\\" + m[2] + m[3], text)


def render(role, text):
    if role == "user":
        return f"[INST] {escape(text)} [/INST]"
    if role == "assistant":
        return f"{escape(text)}</s>"
    return f"[TURN]{escape(role)}[/TURN]{escape(text)}</s>"


def conversations(rows):
    out = {}
    for c, n, role, text in sorted(((c, n, r or "", t or "") for c, n, r, t in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        out.setdefault(c, []).append((role, text))
    return out


def brute(rows):
    out = []
    for c, turns in conversations([*rows, (-1, 0, "user", HARD), (-1, 1, "assistant", HARD)]).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(render(r, t) for r, t in turns)
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole)))
    return sorted(out, key=repr)


def test_query_over_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op12_chat(spark, SF)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_sql_is_brute_force():
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    cursor = con.execute(ORACLES["op12_chat"])
    assert [c[0] for c in cursor.description] == COLUMNS
    assert sorted(cursor.fetchall(), key=repr) == brute(rows)


def hostile(rng):
    parts = ["[INST]", "[/INST]", "</s>", "<s>", "[TURN]", "[/TURN]", "\\", "[\\INST]", "<\\\\/s>", " ", "[", "<", "]", ">", "/", "INST]", "é\U0001f600", "\n", "$1", "word", "[INST] ", " [/INST]"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))


def test_hostile_texts_are_read_back(spark):
    rng = random.Random(5)
    rows = []
    for c in range(300):
        for n in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", hostile(rng)])
            rows.append((c, n, role, hostile(rng)))
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, chat.chat_report(table).collect()), key=repr) == brute(rows)
    want = conversations(rows)
    for r in chat.formatted(table).collect():
        turns = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.formatted == "".join(render(*t) for t in turns)
        # The mask covers the text, and what it marks are the bodies of assistants.
        assert sum(m.chars for m in r.mask) == len(r.formatted)
        learnt, at = [], 0
        for m in r.mask:
            if m.loss:
                learnt.append(r.formatted[at : at + m.chars])
            at += m.chars
        assert learnt == [escape(t) for role, t in turns if role == "assistant"]


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, "x"), (2, 0, "user", "y"), (2, 0, "user", "y"), (2, 0, "assistant", "y"),
        (None, 3, "assistant", "none"), (None, None, None, None), (3, 0, "assistant", "w " * 200_000 + "</s>"),
    ]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"t": F.lit(1), "turns": F.lit("x"), "source": F.lit(None)})
    assert sorted(map(tuple, chat.chat_report(table).collect()), key=repr) == brute(rows)
    assert [r.conv_id for r in chat.chat_report(table.where("false")).collect()] == [-1]
    assert chat.formatted(table.where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = op12_chat(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and plan.count("Exchange") == 1
