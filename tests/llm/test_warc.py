from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from tickbars.llm import warc as W
from tickbars.llm.queries import op3_warc

SF = "/root/testdata/sf0.01"


def brute(rows):
    first = {}
    for page, html in rows:
        p = (html or "").encode()
        first[p] = min(first.get(p, page), page)
    out = []
    for page, html in rows:
        p = (html or "").encode()
        again = page != first[p]
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((page, len(p), digest, "revisit" if again else "response", first[p] if again else None))
    return sorted(out)


def test_query_over_all_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    got = op3_warc(spark, SF)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


SCHEMA = "sha string, page_id bigint, url string, html string, first_id int"


def test_odd_rows(spark):
    long = "<p>é\r\n\r\n</p>" * 60_000
    rows = [("s", 5, "http://a/\r\nX: y", "same", 0), ("s", 3, None, "same", 0), ("s", 4, "u", None, 0), ("s", 6, "u", "", 0)]
    rows += [("s", 7, "u", long, 0), ("s", 7, "u", long, 0), ("s", 9, "ü", long, 0), ("s", None, "u", "alone", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in W.archive_report(df).collect()), key=repr)
    plain = [(r[1], r[3]) for r in rows if r[1] is not None]
    want = brute(plain) + [(None, 5, W.digest_of(b"alone"), "response", None)]
    assert got == sorted(want, key=repr)
    assert W.archive_report(df.where("false")).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_hot_payloads(spark, monkeypatch, hot):
    """Without hot digests, with one beside others, and with hot ones only."""
    monkeypatch.setattr(W, "HOT", hot)
    rows = [(i, f"u{i}", "often" if i % 2 else f"page {i // 6}") for i in range(60, 0, -1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [tuple(r) for r in W.archive_report(df).collect()]
    assert sorted(got) == brute([(i, html) for i, _, html in rows])


def test_round_trip_of_payloads_and_pushdown(spark, tmp_path):
    folder = str(tmp_path / "w")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    W.write_archives(pages, folder, dedupe=False)
    found = W.read_archives(spark, folder, payload="read")
    got = {r.record_id: bytes(r.payload).decode() for r in found.where("warc_type = 'response'").collect()}
    assert got == {f"<urn:x-page:{r.page_id}>": r.html for r in pages.collect()}
    one = found.where("record_id = '<urn:x-page:7>' and warc_type in ('response', 'x') and target_uri like 'http%'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "") and one.count() == 1
    assert found.where("warc_type = 'warcinfo'").count() >= 1


def test_unwanted_payloads_are_not_inflated(monkeypatch, tmp_path):
    big = W.member(W.page_record("1", "u", b"x" * 3_000_000, None, False))
    small = W.member(W.page_record("2", "u", b"y", None, False))
    (tmp_path / "a.warc.gz").write_bytes(big + small)
    made = []
    real = W._Stream

    class Counted(real):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)

    monkeypatch.setattr(W, "_Stream", Counted)
    reader = W.WarcReader({"path": str(tmp_path), "payload": "read"})
    reader.tests = [("in", "warc-record-id", ("<urn:x-page:2>",))]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["payload"] for r in rows] == [b"y"]
    assert max(len(s.out) for s in made) < 10_000


@pytest.mark.parametrize("kind", ["own", "gzip", "plain"])
@pytest.mark.parametrize("split", [100, 1000, 1 << 20])
def test_every_split_gives_each_record_once(tmp_path, kind, split):
    pages = [(str(i), f"http://h/{i}", f"WARC/1.1 \x1f {i}".encode() * (i * 7 % 90)) for i in range(60)]
    made = [W.page_record(k, u, p, None, False) for k, u, p in pages]
    pack = {"own": W.member, "gzip": gzip.compress, "plain": bytes}[kind]
    (tmp_path / ("x.warc" if kind == "plain" else "x.warc.gz")).write_bytes(b"".join(map(pack, made)))
    reader = W.WarcReader({"path": str(tmp_path), "payload": "read", "splitBytes": str(split)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["record_id"], r["payload"]) for r in rows] == [(f"<urn:x-page:{k}>", p) for k, _, p in pages]


def test_damage_is_noticed(tmp_path):
    data = bytearray(W.page_record("1", "u", b"payload", None, False))
    data[data.index(b"payload")] ^= 1
    (tmp_path / "a.warc").write_bytes(bytes(data))
    reader = W.WarcReader({"path": str(tmp_path), "payload": "check"})
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))
