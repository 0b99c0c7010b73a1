"""Runs against a brute-force search over all periods."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import periodic


def brute_runs(w, least_words=6, least_periods=4):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    where = periodic.planted(doc_id, len(words))
    if where:
        a, p = where
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    keep = [not any(s + q <= i < s + n for s, n, q in runs) for i in range(len(words))]
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for w, k in zip(words, keep, strict=True) if k)
    return (len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def found_in(docs):
    return [runs for _, runs in periodic.batch_runs([(i, [b"w%d" % x for x in w]) for i, w in enumerate(docs)], None)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), min_size=1, max_size=5))
def test_runs_of_short_words(docs):
    assert found_in(docs) == [brute_runs(w) for w in docs]


def test_nested_and_neighbouring_runs():
    rng = random.Random(3)
    docs = []
    for _ in range(300):
        w = []
        while len(w) < 60:
            piece = [rng.randrange(3) for _ in range(rng.randint(1, 4))]
            w += piece * rng.randint(1, 6) + [rng.randrange(3) for _ in range(rng.randint(0, 3))]
        docs.append(w * rng.choice([1, 1, 4]))
    assert found_in(docs) == [brute_runs(w) for w in docs]


def test_a_long_run_and_a_long_text():
    # the alternative of a search over all periods would take hours on these
    assert found_in([[0] * 100_000]) == [[(0, 100_000, 1)]]
    rng = random.Random(1)
    half = [rng.randrange(1_000) for _ in range(50_000)]
    assert found_in([half * 4, half * 3]) == [[(0, 200_000, 50_000)], []]


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = periodic.query(spark, sf_dir).collect()
    assert len(rows) == len(docs) and sum(r["n_runs"] > 0 for r in rows) > 10
    few = [i for i in docs if len(docs[i] or "") < 8_000]
    got = {r["doc_id"]: tuple(r)[1:] for r in rows}
    assert len(few) > 100 and all(got[i] == brute_row(i, docs[i]) for i in few)


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a a a a a a", "a a a a a a", "x " * 6 + "y", "b c d " * 4, "\x1c \x1c " * 3 + "\x85", "m " * 70_000]
    df = spark.createDataFrame([(i if i != 3 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, `n_runs` int").withColumnRenamed("doc_id", "my.id")
    out = periodic.collapse(df, "my.id").collect()
    assert [r["n_runs"] for r in out] == list(range(len(texts)))
    assert [r["_n_runs"] for r in out] == [0, 0, 0, 0, 1, 1, 1, 1, 1, 1]
    assert [r["collapsed"] for r in out] == ["", "", "", "a", "a", "a", "x y", "b c d", "\x1c \x85", "m"]
    assert [tuple(r)[4:7] for r in out][4:8] == [(0, 6, 1), (0, 6, 1), (0, 6, 1), (0, 8, 2)]
    assert periodic.collapse(df.where("false"), "my.id").count() == 0
