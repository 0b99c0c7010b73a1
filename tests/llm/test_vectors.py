import math
import random

import numpy as np
import pytest

from tessella.llm import ann, exact_search
from tessella.llm import vectors as vectors_of

KINDS = "vec_id long, embedding array<double>, score string"


def table(spark, n=700, dims=8, seed=4):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)], "x") for i in range(n)]
    rows[40] = (40, list(rows[41][1]), "x")
    rows += [(20_000, None, "x"), (20_020, [0.0] * dims, "x"), (20_040, [math.nan] + [1.0] * (dims - 1), "x"), (20_060, [None] + [1.0] * (dims - 1), "x"), (20_080, [math.inf] * dims, "x"), (20_100, [], "x"), (20_120, [1.0], "x"), (None, [1.0] * dims, "x"), rows[60], rows[61]]
    return rows, spark.createDataFrame(rows, KINDS).repartition(3)


def brute(rows, score, usable, k=20):
    vectors = [(i, v) for i, v, _ in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and usable(v)]
    out = {}
    for at, (q, v) in enumerate(vectors):
        if q % 20 == 0:
            out.setdefault(q, []).append(sorted((-score(v, w), i) for j, (i, w) in enumerate(vectors) if j != at)[:k])
    return out


def inner(v, w):
    return sum(a * b for a, b in zip(v, w, strict=True))


@pytest.mark.parametrize("least", [1_024, 64])
def test_nearest_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(vectors_of, "LEAST", least)
    monkeypatch.setattr(vectors_of, "QUERIES", 16)
    rows, vectors = table(spark)
    want = brute(rows, inner, any)
    got = {}
    for r in ann.nearest(vectors).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        lists = len(want[q])
        assert sorted(r for r, _, _ in found) == sorted([*range(1, 21)] * lists)
        if lists == 1:
            exact = {i: -s for s, i in want[q][0]}
            hits += sum(i in exact for _, i, _ in found)
            assert all(s == pytest.approx(exact[i]) for _, i, s in found if i in exact)
            assert [s for _, _, s in sorted(found)] == sorted((s for _, _, s in found), reverse=True)
    assert hits >= 0.9 * 20 * sum(len(x) == 1 for x in want.values())
    assert ann.nearest(vectors.limit(0)).collect() == []


def test_few_vectors_are_verified_where_neighbours_are_near():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((200, 64))
    vectors = np.repeat(centres, 30, axis=0) + 0.1 * rng.standard_normal((6_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    block = ann.indexed({"ids": np.arange(6_000), "rows": np.arange(6_000), "vectors": vectors})
    at = np.arange(0, 6_000, 60)
    verified, hits = [], 0
    for q, found, _ in ann.search(block, at, vectors[at], 20, verified=verified):
        scores = vectors @ vectors[at[q[0]]]
        scores[at[q[0]]] = -2
        hits += len(set(found.tolist()) & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(at) and sum(verified) < 0.05 * 6_000 * len(at)


@pytest.mark.parametrize("least", [1_024, 64])
def test_exact_top_k_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(vectors_of, "LEAST", least)
    monkeypatch.setattr(vectors_of, "QUERIES", 16)
    rows, vectors = table(spark)
    want = brute(rows, lambda v, w: sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w, strict=True)), lambda v: True)
    got = {}
    for r in exact_search.top_k(vectors).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert got.keys() == want.keys()
    for q, lists in want.items():
        assert sorted(got[q]) == sorted((n, s, i) for x in lists for n, (s, i) in enumerate(x, 1))
    assert exact_search.top_k(vectors.limit(0)).collect() == []


def test_rows_with_one_id_are_rows_of_their_own(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (20, [2.0, 0.0]), (20, [0.5, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_search.top_k(rows, 3).collect() if r.query_id == 0]
    assert sorted(got) == [(0, 1, 1, 64 * 64 * 3), (0, 2, 20, 64 * 64 * 2), (0, 3, 1, 64 * 64)]
    assert sum(r.query_id == 20 for r in exact_search.top_k(rows, 3).collect()) == 6


def test_few_rows_give_all(spark):
    few = spark.createDataFrame([(i, [1.0 * (i % 3 + 1), 0.0, 2.0]) for i in (0, 1, 2, 3, 4, 5)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in exact_search.top_k(few).orderBy("rank").collect()] == [(0, 2), (0, 5), (0, 1), (0, 4), (0, 3)]
    assert [r.vec_id for r in ann.nearest(few).orderBy("rank").collect()] == [2, 5, 1, 4, 3]


def test_each_length_is_searched_by_itself(spark, monkeypatch):
    monkeypatch.setattr(vectors_of, "LEAST", 16)
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(1, 9)) for _ in range(3 if i % 3 else 5)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = {}
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:4]
            want[q] = [i for _, i in best]
    got = {}
    for r in exact_search.top_k(df, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want
    near = ann.nearest(df, 4).collect()
    assert {r.query_id for r in near} == set(want) and all(len(rows[r.vec_id][1]) == len(rows[r.query_id][1]) for r in near)
