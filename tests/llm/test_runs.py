from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tickbars.llm import runs as R
from tickbars.llm.queries import op13_runs

SF = "/root/testdata/sf0.01"
sha = lambda b: hashlib.sha256(b).hexdigest()


def brute_runs(words):
    """Every period tried over the whole sequence."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(24, 3 * q) and not any(p < q and a <= s and e <= b for a, b, p in out):
                out.append((s, e, q))
            i = j
    return sorted(out)


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = set()
    for s, e, q in found:
        dropped.update(range(s + q, e))
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    best = (None,) * 4
    if found:
        s, e, q = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
        best = (s, e - s, q, 1000 * (e - s) // q)
    return (doc_id, len(found), *best, sha(lines.encode()), sha(kept))


def sequences():
    rng = random.Random(7)
    for _ in range(400):  # few letters
        yield [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 150))]
    for _ in range(400):  # runs of all sorts between other words, within each other too
        seq = []
        while len(seq) < rng.randint(30, 250):
            unit = [rng.choice("abcdef") for _ in range(rng.randint(1, 14))]
            part = unit * rng.randint(1, 12)
            part = part[: len(part) - rng.randint(0, min(len(unit), len(part) - 1))]
            seq += part * rng.choice([1, 1, 3, 4])
            seq += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]
        yield seq[:600]
    a, b = "a", "ab"
    for _ in range(11):
        a, b = b, b + a
    yield list(b)  # a Fibonacci word
    yield list("abaab" * 60 + "b" + "abaab" * 60)


def test_runs_are_those_of_brute_force():
    for seq in sequences():
        assert R.find_runs(seq) == brute_runs(seq), "".join(seq)


def test_grammar_stands_for_its_sequence_and_repeats_no_pair():
    for seq in sequences():
        ids = np.array([ord(c) for c in seq], np.int64)
        grammar = R.Grammar(ids)
        if not grammar.pairs:
            continue
        assert grammar.expand() == ids.tolist()
        root = [grammar._symbols[i] for i in grammar.root.tolist()]
        last = {}
        for i, pair in enumerate(zip(root, root[1:])):
            assert i - last.setdefault(pair, i) < 2
        for rule, places in enumerate(grammar.places):
            size = grammar.sizes[rule]
            assert len({tuple(ids[p : p + size]) for p in places}) == 1 and len(places) > 1


@pytest.mark.parametrize(
    "make",
    [
        lambda n: ["a"] * n,
        lambda n: [str(i) for i in range(n // 2)] * 2,
        lambda n: [str(i % 7) for i in range(n)],
        lambda n: [str(i * i % 97) for i in range(n)],
        lambda n: ["x"] * (n // 4) + [str(i) for i in range(n // 4)] + (["y"] * 9 + ["z"]) * (n // 20),
        lambda n: " ".join(f"the same line that comes again and again with number {i}" for i in range(n // 11)).split(),
    ],
)
def test_long_documents_take_time_in_proportion(make):
    taken = []
    for n in (50_000, 200_000):
        words = make(n)
        began = time.perf_counter()
        R.find_runs(words)
        taken.append(time.perf_counter() - began)
    assert taken[1] < 10 * taken[0] + 1


def test_query_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = op13_runs(spark, SF)
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    short = [r for r in docs if len((r.text or "").split()) <= 3000]  # brute force is quadratic
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(rows) == len(docs)
    for r in short:
        assert rows[r.doc_id] == brute_row(r.doc_id, r.text)
    assert sum(r[1] > 0 for r in rows.values()) > len(docs) // 20


def test_odd_rows(spark):
    text = "again and " * 20 + "then no\x0bmore"
    rows = [(1, None, "x"), (2, "", "x"), (None, text, None), (3, text, "x"), (3, text, "y"), (4, " \t\n ", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    want = [(i, *brute_row("null" if i is None else i, t)[1:]) for i, t, _ in rows]
    assert sorted(map(tuple, R.run_report(docs).collect()), key=repr) == sorted(want, key=repr)
    assert R.run_report(docs.where("false")).count() == 0
    plain = R.periodic_runs(docs.where("doc_id = 3"), planted=False).first()
    assert plain.collapsed == "again and then no more" and plain.runs[0].length == 40
