from __future__ import annotations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tickbars.llm import mih as M
from tickbars.llm.queries import op5_mih

SF = "/root/testdata/sf0.1"


def brute(rows, k=10, every=100):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            d = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q)
            out[q] = d[:k]
    return out


def test_recall_over_all_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows)
    got = op5_mih(spark, SF)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert sorted(found) == sorted(want)
    hits = 0
    where = dict(rows)
    for q, mine in found.items():
        mine.sort()
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert mine == sorted(mine, key=lambda x: (x[1], x[2]))
        for _, score, v in mine:
            real = np.sqrt(((np.array(where[v], float) - np.array(where[q], float)) ** 2).sum())
            assert abs(score - real) < 1e-12
        hits += len({v for _, _, v in mine} & {v for _, v in want[q]})
    assert hits / sum(map(len, want.values())) >= 0.9


@given(st.lists(st.integers(0, 2**128 - 1), min_size=1, max_size=60), st.integers(0, 2**128 - 1), st.integers(0, 128))
def test_probing_finds_all_within_the_radius(codes, query, radius):
    every = codes + [query ^ (1 << i) - 1 for i in range(0, 129, 5)]
    words = lambda c: [c & 2**64 - 1, c >> 64]
    arr = np.array([words(c) for c in every], np.uint64)
    got = M.Buckets(arr, 128).within(np.array(words(query), np.uint64), radius).tolist()
    assert got == [i for i, c in enumerate(every) if (c ^ query).bit_count() <= radius]


def test_few_vectors_are_within_the_radius(spark):
    index, codes = M.build_index(spark.read.parquet(f"{SF}/embeddings.parquet"))
    rows = index.select("id", "code").collect()
    words = np.array([r.code for r in rows], np.int64).view(np.uint64)
    near = [np.count_nonzero(M.bits_apart(words, words[i]) <= codes.radius) for i, r in enumerate(rows) if r.id % 100 == 0]
    assert codes.bits == 256 and sum(near) <= 0.1 * len(near) * len(rows)


def test_rows_of_the_query_s_id(spark):
    near, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (0, near), (1, near), (2, far)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((round(r.score, 6), r.rank, r.vec_id) for r in M.neighbours(df).collect() if r.query_id == 0)
    # Of two equal query rows each finds the other one; the third, of another vector, finds both.
    assert [v for s, _, v in got if s == 0] == [0, 0, 1]
    assert len(got) == 3 * 4


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.1]), (2, [1.0, 0.0, 0.1]), (3, None), (4, [0.0, 0.0, 0.0])]
    rows += [(5, [nan, 1.0, 0.0]), (6, [1.0, None, 0.0]), (7, []), (8, [1.0]), (100, [0.0, 1.0, 0.0]), (200, None)]
    rows += [(300, [0.0, 0.0, 0.0]), (9, [0.0, 1.0, float("inf")]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(v, i, "x", 0.0) for i, v in rows], "embedding array<float>, vec_id bigint, id string, score double")
    got = {}
    for r in M.neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [0, 100]
    assert [v for _, v, _ in sorted(got[0])][:2] == [1, 2]
    assert {v for _, v, _ in got[0]} >= {1, 2, 100} and len(got[0]) == 3
    assert M.neighbours(df.where("false")).count() == 0
    assert M.neighbours(df.where("vec_id = 3")).count() == 0


def test_queries_in_blocks_give_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = sorted(map(tuple, M.neighbours(df).collect()))
    monkeypatch.setattr(M, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, M.neighbours(df).collect())) == want


def test_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(16)
    rows = [(i, (hot if i % 3 == 0 else rng.standard_normal(16)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [r for r in M.neighbours(df).collect() if r.query_id == 300]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(3 * i, 0.0) for i in range(10)]
