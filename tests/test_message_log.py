"""Message logs: offsets, planned ranges, draining, and a cascade of targets that fail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.operators.stored import ChangedMeanwhile
from tessella.streaming import ingest, message_log as ml

KIND = "id long, at timestamp_ntz, body string"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def log_of(spark, path, batches):
    log = ml.MessageLog(spark, str(path), KIND)
    for i, rows in enumerate(batches):
        log.append(spark.createDataFrame(rows, KIND).coalesce(1), "s", i)
    return log


def ten(first, start):
    return [(first + i, at(start + i), f"b{i}") for i in range(10)]


def test_offsets_and_order(spark, tmp_path):
    log = log_of(spark, tmp_path / "log", [ten(0, 0), [], list(reversed(ten(10, 50))), [(99, None, None)]])
    got = [(r.offset, r.id) for r in sorted(log.read().collect(), key=lambda r: r.offset)]
    assert got == list(enumerate([*range(20), 99])) and ml.end_of(log.path) == 21
    assert sorted(r.id for r in log.read(8, 12).collect()) == [8, 9, 10, 11]
    assert not log.append(spark.createDataFrame(ten(0, 0), KIND), "s", 2) and ml.end_of(log.path) == 21
    assert log.has("s", 3) and not log.has("s", 4) and not log.has("t", 0)


def test_an_empty_log(spark, tmp_path):
    log = ml.MessageLog(spark, str(tmp_path / "log"), KIND)
    assert log.read().collect() == [] and log.oldest(5).collect() == [] and ml.end_of(log.path) == 0
    with pytest.raises(ValueError):
        ml.MessageLog(spark, str(tmp_path / "x"), "id long, offset long, at timestamp")


def test_planning_reads_only_what_can_match(spark, tmp_path):
    log = log_of(spark, tmp_path / "log", [ten(10 * i, 100 * i) for i in range(6)])
    reader = ml._Reader(log.whole, {"path": log.path})
    list(reader.pushFilters([ml.GreaterThanOrEqual(("at",), at(205)), ml.LessThan(("at",), at(301))]))
    assert [s.first for s in reader.planned()] == [20, 30]
    reader = ml._Reader(log.whole, {"path": log.path})
    list(reader.pushFilters([ml.GreaterThan(("offset",), 18), ml.LessThanOrEqual(("offset",), 31)]))
    assert [(p.first, p.high - p.low) for p in reader.partitions()] == [(19, 1), (20, 10), (30, 2)]
    assert [(p.first, p.high - p.low) for p in ml.ranges(ml.segments(log.path, 15, 40), 15, 35, rows=4)] == [(15, 4), (19, 1), (20, 4), (24, 4), (28, 2), (30, 4), (34, 1)]
    found = log.read().where((F.col("at") >= F.lit(at(205))) & (F.col("at") < F.lit(at(301)))).collect()
    assert sorted(r.id for r in found) == [25, 26, 27, 28, 29, 30]
    # what Spark asked of the source: with other files gone the query still works
    from pathlib import Path

    for s in ml.segments(log.path):
        if s.first not in (20, 30):
            Path(log.path.removeprefix("file://"), s.path).unlink()
    assert sorted(r.id for r in log.read().where((F.col("at") >= F.lit(at(205))) & (F.col("at") < F.lit(at(301)))).collect()) == [25, 26, 27, 28, 29, 30]


def test_oldest_plans_the_files_that_hold_them(spark, tmp_path):
    log = log_of(spark, tmp_path / "log", [ten(0, 300), ten(10, 100), ten(20, 104), ten(30, 500), [(40, None, "x")]])
    assert [s.first for s in log.needed(3)] == [10, 20] and [s.first for s in log.needed(12)] == [10, 20] and len(log.needed(21)) == 3
    want = sorted((r for b in ([*ten(10, 100), *ten(20, 104)],) for r in b), key=lambda r: (r[1], r[0]))
    assert [r.id for r in log.oldest(7).collect()] == [r[0] for r in want[:7]]
    assert len(log.oldest(100).collect()) == 40


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    log = log_of(spark, tmp_path / "log", [ten(0, 0)])
    for i in range(3):
        ingest.run_available(log.stream(), ingest.append_batch(f"{tmp_path}/out"), f"{tmp_path}/check")
        if i < 2:
            log.append(spark.createDataFrame(ten(10 * (i + 1), 50), KIND), "s", i + 1)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(30))


def test_two_writers(spark, tmp_path, monkeypatch):
    log = log_of(spark, tmp_path / "log", [ten(0, 0)])
    old = log.last()
    log.append(spark.createDataFrame(ten(10, 0), KIND))
    monkeypatch.setattr(log, "last", lambda: old)
    with pytest.raises(ChangedMeanwhile):
        log.append(spark.createDataFrame(ten(20, 0), KIND))
    assert ml.end_of(log.path) == 20


def test_drain_moves_each_message_once(spark, tmp_path, monkeypatch):
    fallback, main = log_of(spark, tmp_path / "f", [ten(0, 0)]), log_of(spark, tmp_path / "m", [])
    fresh = lambda rows: rows.withColumn("body", F.lit("again"))
    with monkeypatch.context() as m:
        m.setattr(main.folder, "make", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            ml.drain(fallback, main, fresh)
    assert main.read().count() == 0
    assert ml.drain(fallback, main, fresh) == 10 and ml.drain(fallback, main, fresh) == 0
    fallback.append(spark.createDataFrame(ten(10, 0), KIND))
    assert ml.drain(fallback, main, fresh) == 10
    assert sorted((r.id, r.body) for r in main.read().collect()) == [(i, "again") for i in range(20)]


@pytest.mark.parametrize("before,after,place", [((), (), "a"), (("a",), (), "b"), (("a", "b"), (), "dead"), ((), ("a",), "a"), (("a",), ("b",), "b")])
def test_every_message_is_in_one_place(spark, tmp_path, before, after, place):
    logs = {n: log_of(spark, tmp_path / n, []) for n in ("a", "b", "dead")}
    reasons = []

    def target(name):
        def append(rows, stream, batch):
            if name in before:
                raise OSError(f"{name} is gone")
            logs[name].append(rows, stream, batch)
            if name in after:
                raise OSError(f"{name} hung up")

        return ml.Target(name, append, logs[name].has)

    def dead(rows, why, stream, batch):
        reasons.append(why)
        logs["dead"].append(rows, stream, batch)

    rows = spark.createDataFrame([*ten(0, 0), (50, at(0), None)], KIND)
    for _ in range(2):  # the batch comes again
        out = ml.dispatch(rows, [target("a"), target("b")], dead, "s", 0, F.when(F.col("body").isNull(), "no body"))
        assert out == {"refused": "dead", "messages": place}
    held = {n: sorted(r.id for r in log.read().collect()) for n, log in logs.items()}
    assert held == {n: ([*range(10)] if n == place else []) + ([50] if n == "dead" else []) for n in logs}
    assert place != "dead" or "a is gone; b: b is gone" in reasons[1]
