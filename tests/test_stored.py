"""Stored tables: what a change leaves, what it does not touch, and what a failure leaves behind."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.operators import stored
from tessella.operators.stored import StoredTable
from tessella.streaming import ingest

KIND = "k long, version long, value string, created long"


def rows_of(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def made(spark, path, n=40):
    table = StoredTable(spark, str(path), KIND, ["k"], 8)
    table.append(frame(spark, [(i, 0, f"a{i}", 0) for i in range(n)]))
    return table


def hashes(table, version):
    files = {p: sorted(Path(table.folder.path.removeprefix("file:"), p).glob("*.parquet")) for ps in table.manifest(version)["buckets"].values() for p in ps}
    return {p: [hashlib.sha256(f.read_bytes()).hexdigest() for f in fs] for p, fs in files.items()}


def test_changes(spark, tmp_path):
    t = made(spark, tmp_path / "t")
    want = {i: (i, 0, f"a{i}", 0) for i in range(40)}
    t.upsert(frame(spark, [(3, 5, "new", 9), (3, 4, "older", 8), (100, 1, "x", 9)]), "version", ["created"])
    want |= {3: (3, 5, "new", 0), 100: (100, 1, "x", 9)}
    assert rows_of(t) == sorted(want.values())
    t.delete(frame(spark, [(3, 0, "", 0), (999, 0, "", 0)]).select("k"))
    del want[3]
    assert rows_of(t) == sorted(want.values())
    t.delete(spark.createDataFrame([("a7",), ("a8",)], "value string"), ["value"])
    del want[7], want[8]
    assert rows_of(t) == sorted(want.values())
    t.replace(frame(spark, [(5, 1, "p", 0), (5, 1, "q", 0)]))
    del want[5]
    assert rows_of(t) == sorted([*want.values(), (5, 1, "p", 0), (5, 1, "q", 0)])
    assert sorted(tuple(r) for r in t.lookup(spark.createDataFrame([(5,), (6,)], "k long")).collect()) == [(5, 1, "p", 0), (5, 1, "q", 0), (6, 0, "a6", 0)]
    assert len(rows_of(t, 1)) == 40 and t.version() == 5
    before = rows_of(t)
    assert t.vacuum() > 0 and rows_of(t) == before and t.vacuum() == 0
    with pytest.raises(Exception):
        t.read(1).collect()


def test_other_buckets_keep_their_files(spark, tmp_path):
    t = made(spark, tmp_path / "t")
    old = hashes(t, 1)
    t.upsert(frame(spark, [(3, 5, "new", 9)]), "version")
    new = hashes(t, 2)
    assert len(old) == 8 and len(old.keys() & new.keys()) == 7 and all(new[p] == old[p] for p in old.keys() & new.keys())


def test_a_bucket_can_become_empty(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), KIND, ["k"], 4)
    assert rows_of(t) == [] and t.version() == 0
    t.append(frame(spark, [(1, 0, "a", 0), (None, 0, "b", 0)]))
    t.delete(spark.createDataFrame([(1,)], "k long"))
    assert rows_of(t) == [(None, 0, "b", 0)]
    t.change(frame(spark, []), lambda old, new: old)
    assert rows_of(t) == [(None, 0, "b", 0)]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    t = made(spark, tmp_path / "t")
    new = frame(spark, [(1, 1, "n", 1)])
    assert t.append(new, "s", 0) and t.append(new, "s", 1)
    now = rows_of(t)
    assert not t.append(new, "s", 1) and not t.append(new, "s", 0) and not t.upsert(new, "version", stream="s", batch=1)
    assert rows_of(t) == now and t.append(new, "another", 0)


def test_a_change_that_stops_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    t = made(spark, tmp_path / "t")
    before, new = rows_of(t), frame(spark, [(1, 1, "n", 1)])
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.upsert(new, "version", stream="s", batch=0)
    assert rows_of(t) == before and t.version() == 1
    assert t.upsert(new, "version", stream="s", batch=0) and (1, 1, "n", 1) in rows_of(t)
    bad = F.udf(lambda v: 1 / 0, "string")
    with pytest.raises(Exception):
        t.change(new, lambda old, n: old.withColumn("value", bad("value")))
    assert t.version() == 2


def test_of_two_writers_one_fails_and_can_try_again(spark, tmp_path):
    t, other = made(spark, tmp_path / "t"), StoredTable(spark, str(tmp_path / "t"), KIND, ["k"], 8)
    new, calls = frame(spark, [(1, 1, "n", 1)]), []

    def slow(old, changes):
        if not calls:
            other.append(frame(spark, [(500, 0, "o", 0)]))
        calls.append(1)
        return old.unionByName(changes)

    with pytest.raises(stored.ChangedMeanwhile):
        t.change(new, slow)
    calls.clear()
    stored.sink(t, "s", lambda table, rows, batch: table.change(rows, slow, **batch))(new, 0)
    assert len(calls) == 2 and sum(r[0] == 500 for r in rows_of(t)) == 2 and (1, 1, "n", 1) in rows_of(t)
    with pytest.raises(ValueError):
        StoredTable(spark, str(tmp_path / "t"), KIND, ["k"], 16).read()


def test_a_stream_that_is_stopped_and_started(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), KIND, ["k"], 4)
    for batch in range(3):
        frame(spark, [(i, batch, f"b{batch}", batch) for i in range(batch, 12, batch + 1)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.read_stream(spark, f"{tmp_path}/in", KIND, 1)
        ingest.run_available(stream, stored.sink(t, "in", lambda table, rows, b: table.upsert(rows, "version", ["created"], **b)), f"{tmp_path}/check")
    want = {}
    for batch in range(3):
        for i in range(batch, 12, batch + 1):
            want[i] = (i, batch, f"b{batch}", want.get(i, (0, 0, 0, batch))[3])
    assert rows_of(t) == sorted(want.values())
