"""Removed bytes against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r) + 1)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), len(r) - len(kept), sum(1 for a, b in zip(b"\x00" + gone, gone) if b and not a), kept))
    return out


def removed(spark, texts, length, anchor, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    rows = repeats.remove_repeats(df, length=length, anchor=anchor).collect()
    return [tuple(r)[2:5] + (bytes(r[5]),) for r in sorted(rows, key=lambda r: r["doc_id"])]


def passages(rng, n, letters="ab ", longest=60):
    shared = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 30))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice(letters + "cdé") for _ in range(rng.randint(0, longest))) for _ in range(rng.randint(0, 5))]
        out.append("".join(parts))
    return out + [out[0], out[1] + out[2]]


@pytest.mark.parametrize("length,anchor", [(8, 3), (12, 5), (6, 6), (5, 1), (20, 8)])
def test_windows_of_collections(length, anchor):
    import numpy as np

    rng = random.Random(length)
    for _ in range(60):
        texts = [t.encode() for t in passages(rng, 12)]
        texts = [t for t in texts if len(t) >= length]
        by_number: dict = {}
        for i, t in enumerate(texts):
            for first, size, lead, number in zip(*(x.tolist() for x in repeats.pieces_of(t, np.full(len(t), len(t)), length, anchor)), strict=True):
                by_number.setdefault(number, []).append((i, first, lead, t[first : first + size + length - 1]))
        found = set()
        mixed = [p for ps in by_number.values() for p in ps]
        for (i, first, _, _), places in zip(mixed, repeats.repeated_windows([p[3] for p in mixed], [p[2] for p in mixed], length), strict=True):
            found |= {(i, first + int(x)) for x in places}
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        assert found == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1}


@pytest.mark.parametrize("length,anchor,hot", [(12, 5, None), (12, 5, 40), (7, 2, 100)])
def test_removed_bytes(spark, monkeypatch, length, anchor, hot):
    rng = random.Random(length)
    monkeypatch.setattr(repeats, "COLLECTION", 300)
    if hot:  # numbers with many strings take the other way
        monkeypatch.setattr(repeats, "HOT", hot)
    texts = passages(rng, 60) + ["many copies " * 4] * 30 + ["ab" * 50, "ab" * 20 + "c", "a" * 90, None, "", "é" * 30, "xyz", "xyz"]
    assert removed(spark, texts, length, anchor) == brute(texts, length)


def test_a_task_cuts_many_copies_twice(spark, monkeypatch):
    copies = ["one text of many " * 3] * 50 + ["another " * 9]
    df = spark.createDataFrame([(t,) for t in copies], "text string").coalesce(1)
    assert repeats.pieces(df, "text", 20, 5).groupBy("key", "first").count().agg({"count": "max"}).first()[0] == 2
    monkeypatch.setattr(repeats, "REMEMBERED", 0)
    assert repeats.pieces(df, "text", 20, 5).groupBy("key", "first").count().agg({"count": "max"}).first()[0] == 50


def test_copies_of_a_text_do_not_meet_in_a_task(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan shows no counts
    try:
        df = spark.createDataFrame([("one text of many " * 3,)] * 90 + [("another " * 9,)] * 3 + [("short",)], "text string").repartition(3)
        found = repeats.pieces(df, "text", 20, 5).groupBy("number", "d1", "d2").agg(F.min(F.struct("key", "first", "windows", "lead")).alias("p"))
        wanted = found.select("number", "d1", "d2", "p.*").localCheckpoint()
        cut = repeats.cut_strings(df.localCheckpoint(), "text", wanted, 20)
        assert sorted((r.number, r.d1, r.d2) for r in cut.collect()) == sorted((r.number, r.d1, r.d2) for r in wanted.collect())
        dealt, plans = [], [cut._jdf.queryExecution().executedPlan()]
        for plan in plans:
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
            if plan.metrics().contains("shuffleRecordsWritten"):
                dealt.append(plan.metrics().apply("shuffleRecordsWritten").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(dealt) >= 2 and max(dealt) <= max(3 * 2, wanted.count()) < 90, dealt  # two texts in three tasks, or the pieces


def test_parts_of_long_texts_and_shuffle_joins(spark, monkeypatch):
    import tessella.llm.common as common

    monkeypatch.setattr(repeats, "PART", 64)
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    rng = random.Random(9)
    texts = passages(rng, 25, longest=200) + ["".join(rng.choice("abcd") for _ in range(700))]
    texts.append("zz" + texts[-1][100:600])
    assert removed(spark, texts, 15, 6) == brute(texts, 15)


def test_query(spark, sf_dir):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = [(i, n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(docs, brute([t for _, t in docs], 400), strict=True)]
    got = sorted(tuple(r) for r in repeats.query(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want and sum(r[2] > 0 for r in got) > 5


def test_odd_rows(spark):
    rows = [(None, "p" * 30, 1, "x"), (2, None, 2, "y"), (2, "", 3, None), (5, "q" * 9, 4, "z"), (5, "q" * 9, 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, kept string").withColumnRenamed("doc_id", "my.id")
    out = repeats.remove_repeats(df, length=10, anchor=4).sort("n_bytes").collect()
    assert [(r["_n_bytes"], r["n_removed"], r["n_spans"], bytes(r["_kept"]), r["kept"]) for r in out] == [(30, 30, 1, b"", "x"), (0, 0, 0, b"", "y"), (0, 0, 0, b"", None)] + [(9, 0, 0, b"q" * 9, "z")] * 2
    assert repeats.remove_repeats(df.where("false")).count() == 0
