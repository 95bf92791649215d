from __future__ import annotations

import hashlib

import corpus_pipeline as P
import public_tokenizers
import tiktoken

import __spark_entry__ as entry_module
from tickbars.llm import language, pii
from tickbars.llm.queries import vocabulary

from .test_positional import brute as brute_windows
from .test_simhash import plain_print, plain_roots

SF = "/root/testdata/sf0.01"


def brute(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    # language: the smallest compressed size wins, narrow margins go
    model = language.fit(table)
    kept = []
    for d, t in docs:
        data = language.normal(t or "")
        if not data:
            continue
        blocks = [data[i : i + language.BLOCK_BYTES] for i in range(0, len(data), language.BLOCK_BYTES)]
        sizes = sorted(sum(len(c.compress(b)) for b in blocks) for c in model.compressors())
        if 1 - sizes[0] / sizes[1] >= language.MARGIN:
            kept.append((d, t))
    # near duplicates: the smallest id of each component
    kept.sort()
    roots = plain_roots([plain_print(t) for _, t in kept])
    kept = [x for i, x in enumerate(kept) if roots[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in brute_windows(kept, items) if not r[5]}
    kept = [x for x in kept if x[0] in clean]
    vocab = vocabulary()
    ranks = dict(zip(vocab.keys, vocab.ranks))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for d, t in kept:
        for s in reversed(pii.find_spans(t)):
            t = t[: s.start] + f"[{s.kind.upper()}]" + t[s.end :]
        out[d] = (known.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_pipeline_equals_brute_force(spark):
    want = brute(spark)
    rows = entry_module.queries()["pipeline"](spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids, digest = want[r.doc_id]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == digest
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    en = "the house and the garden with a tree and the street beside it where all of them live "
    rows = [(i, en + f"number{i} " * 5 + f"mail me{i}@example.com", "en", "s", 1) for i in range(8)]
    rows += [(20, None, None, None, None), (None, en * 3 + "other words here", None, "s", 2), (21, "", "en", "s", 0), (0, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.where("false"), SF).count() == 0
        if name == "personal_data":
            assert all("@" not in (r.text or "") for r in out.collect())
            assert out.count() == docs.count()
    assert P.encode(spark, docs, SF).count() == docs.count()


def test_only_the_last_tables_are_left(spark, tmp_path, monkeypatch):
    from tickbars import files

    monkeypatch.setattr(files, "shared_dir", lambda spark: str(tmp_path))
    n = P.run(spark, "/root/testdata/sf0.001").count()
    left = [name.rsplit("-", 1)[0] for name in files.children(spark, files.job_dir(spark))]
    assert n and left == ["personal_data"]
