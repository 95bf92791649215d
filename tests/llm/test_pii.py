from __future__ import annotations

import hashlib
import re
import time

from hypothesis import given
from hypothesis import strategies as st

from tickbars.llm import pii
from tickbars.llm.queries import op2_pii

SF = "/root/testdata/sf0.01"

# The base patterns as they are given.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for k, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(d) <= 19 and _luhn(d),
                "phone": lambda: 10 <= len(d) <= 15,
            }[kind]
            if good():
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def shown(text):
    return [f"{s.kind}:{s.start}:{s.end}" for s in sorted(pii.base_spans(text), key=lambda s: (s.start, pii.KINDS.index(s.kind)))]


@given(st.text(alphabet="aB1029.@+- ()%_é4\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert shown(text) == [f"{k}:{a}:{b}" for a, _, b, k in plain_spans(text)]


def test_query_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        spans = plain_spans(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        counts = tuple(sum(s[3] == k for s in spans) for k in PLAIN)
        want[r.doc_id] = (*counts, hashlib.sha256(joined.encode()).hexdigest(), set(filter(None, joined.split(","))))
    rows = op2_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        *digest, base = want[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == tuple(digest)
        assert base <= set(filter(None, r.spans.split(",")))


def test_checksums_and_context():
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("DE89 3704 0044 0532 0130 00") == ["iban"]
    assert kinds("DE88 3704 0044 0532 0130 00") == []
    assert kinds("SKU DE89370400440532013000") == []
    assert kinds("bank part DE89370400440532013000") == ["iban"]
    assert kinds("078-05-1120") == []
    assert kinds("social security 078-05-1120") == ["ssn"]
    assert kinds("666-05-1120 ssn") == []
    assert kinds("call 555-123-4567") == ["phone"]
    assert kinds("555-123-4567") == []
    assert kinds("4222222222222") == []
    assert kinds("visa 4222222222222") == ["card"]


def test_very_long_runs_take_linear_time():
    n = 400_000
    for text in ("a" * n, "1" * n, "1." * n, "@" * n, "a@" * n, "+1" * n, "+1 " + "1 " * n, "a@b." + "c" * n, "AA11" * n):
        pii.find_spans(text)


def test_very_many_spans_take_linear_time():
    unit = "call 555-123-4567 or a@b.cd, bank DE89370400440532013000, visa 4222222222222, +49 170 1234567 ssn 078-05-1120; 1.2.3.4 "
    taken = []
    for size in (1_000_000, 4_000_000):
        text = unit * (size // len(unit))
        began = time.perf_counter()
        found = pii.find_spans(text)
        taken.append(time.perf_counter() - began)
        assert len(found) == 7 * (size // len(unit))
    assert taken[1] < 8 * taken[0] + 0.5 and taken[1] < 30


@given(st.text(alphabet="+4 -().@a1", max_size=80))
def test_further_spans_overlap_nothing(text):
    text += " call 555-123-4567 DE89370400440532013000 +555-123-4567890 tel (555) 123-4567"
    spans = pii.find_spans(text)
    further = [s for s in spans if s.score != 1.0]
    for s in further:
        assert not any(o is not s and o.start < s.end and s.start < o.end for o in spans)


def test_odd_rows_and_masking(spark):
    schema = "spans int, doc_id bigint, text string, n_email string"
    rows = [(1, 1, None, "x"), (2, None, "", None), (3, 3, "to a@b.cd and 1.2.3.4", "y"), (3, 3, "to a@b.cd and 1.2.3.4", "y")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or -1, r.n_email, r.spans) for r in pii.pii_report(df).collect())
    assert got == [(-1, 0, ""), (1, 0, ""), (3, 1, "email:3:9,ip:14:21"), (3, 1, "email:3:9,ip:14:21")]
    assert sorted(r.text or "" for r in pii.masked(df).collect()) == ["", "", "to [EMAIL] and [IP]", "to [EMAIL] and [IP]"]
    assert pii.masked(df).schema == df.schema
    assert pii.pii_report(df.where("false")).count() == 0


def test_capitals_and_numbers_after_an_iban():
    ibans = lambda t: [t[s.start : s.end] for s in pii.find_spans(t) if s.kind == "iban"]
    german, british = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    assert ibans(f"IBAN {german} BIC COBADEFFXXX") == [german]
    assert ibans("DE89370400440532013000 USD 500") == ["DE89370400440532013000"]
    assert ibans(f"{german} {british} {german}") == [german, british, german]
    assert ibans(f"REF AB12 0000 {german} EUR") == [german]
    assert ibans("DE88370400440532013000 USD 500") == []
    pii.find_spans("AA11 " * 80_000)


def test_masking_leaves_no_iban_before_capitals(spark):
    df = spark.createDataFrame([("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX",)], "text string")
    assert pii.masked(df).first().text == "IBAN [IBAN] BIC COBADEFFXXX"
