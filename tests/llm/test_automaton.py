from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickbars.llm import automaton as A
from tickbars.llm.queries import op7_automaton

SF = "/root/testdata/sf0.01"


def brute(docs, window=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, ws in split:
        for i in range(len(ws) - window + 1):
            if d is not None:
                w = tuple(ws[i : i + window])
                first[w] = min(first.get(w, d), d)
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if d is not None and first[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(row):
    return repr(tuple(row))


def test_query_over_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op7_automaton(spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    rows = got.collect()
    assert any(r.n_removed for r in rows)
    assert sorted(map(key, rows)) == sorted(map(key, brute(docs)))


_PASSAGES = st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=12), st.integers(0, 5)), max_size=6)


@settings(max_examples=400)
@given(_PASSAGES, st.lists(st.sampled_from("abcd"), max_size=14), st.integers(1, 5))
def test_automaton(passages, text, window):
    automaton = A.SuffixAutomaton()
    for p, d in passages:
        automaton.add(p, d)
    automaton.close()
    runs = {tuple(p[i:j]) for p, _ in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    longest = [next((n for n in range(i + 1, 0, -1) if tuple(text[i + 1 - n : i + 1]) in runs), 0) for i in range(len(text))]
    assert [n for _, n in automaton.statistics(text)] == longest
    want = []
    for i in range(len(text) - window + 1):
        w = text[i : i + window]
        want.append(min((d for p, d in passages if any(p[j : j + window] == w for j in range(len(p)))), default=A.NOBODY))
    assert automaton.firsts(text, window) == want


@given(st.lists(st.text(alphabet="ab é\t\n", max_size=40), max_size=5))
def test_windows_of_a_chunk_stay_in_their_texts(texts):
    data = [t.encode() for t in texts]
    hashed = A.Hashed(data, 6)
    for i, t in enumerate(data):
        base, shards = hashed.windows_of(i)
        ws = t.split()
        assert len(shards) == max(0, len(ws) - 5)
        assert [hashed.data[hashed.begin[base + j] : hashed.end[base + j]] for j in range(len(ws))] == ws
        alone = A.Hashed([b" ".join(ws)], 6).windows_of(0)[1]
        assert shards.tolist() == alone.tolist()


SCHEMA = "windows string, doc_id bigint, text string, row int, doc string"


@pytest.mark.parametrize("limit", [50_000, 40, 1])
def test_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(A, "HOT_WORDS", limit)
    text = " ".join(f"w{i}" for i in range(40))
    part = " ".join(f"w{i}" for i in range(9, 25))
    texts = [
        (5, text), (3, f"x {part} y  z\t{part} q"), (3, text), (3, text), (7, text + "\n" + text), (None, text), (1, None),
        (2, ""), (4, "a " * 30_000), (6, "a " * 20), (8, "one two"), (9, f"p {part} r"), (10, " ".join(f"w{i}" for i in range(12))),
    ]
    df = spark.createDataFrame([("w", d, t, 0, "d") for d, t in texts], SCHEMA)
    assert sorted(map(key, A.repeat_report(df).collect())) == sorted(map(key, brute(texts)))
    assert A.repeat_report(df.where("false")).count() == 0
    assert {r.n_removed for r in A.repeat_report(df.where("doc_id = 3")).collect()} == {0}


@pytest.mark.parametrize("limit", [300, 60])
def test_variants_of_one_passage_are_dealt_out_again(spark, monkeypatch, limit):
    """Texts that share five words, and the one hash that they meet in, but differ around them."""
    monkeypatch.setattr(A, "HOT_WORDS", limit)
    rng = random.Random(2)
    texts = []
    for d in range(60):
        before, after = ([rng.choice("abcdefgh") for _ in range(12)] for _ in range(2))
        near = before[:8] + [f"v{d % 7}"] * 4
        texts.append((d, " ".join([*near, "the", "five", "common", "words", "here", *after])))
    texts += [(100 + d, t) for d, t in texts[:20]]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert sorted(map(key, A.repeat_report(df).collect())) == sorted(map(key, brute(texts)))


def test_reference_in_shards(spark, monkeypatch):
    text = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(text[5:40])), (1, "n " * 20), (2, None), (3, " ".join(text[:12]))], "doc_id bigint, text string")
    ref = spark.createDataFrame([("a", " ".join(text)), ("b", None), ("c", "n n")], "item string, text string")
    for limit in (200_000, 15):
        monkeypatch.setattr(A, "SHARD_WORDS", limit)
        got = sorted((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.kept) for r in A.reference_spans(docs, ref).collect())
        assert got == [(1, 20, [], " ".join(["n"] * 20)), (1, 35, [(0, 35)], ""), (2, 0, [], ""), (3, 12, [], " ".join(text[:12]))]
