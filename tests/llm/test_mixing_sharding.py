import re
import zlib

import pytest

from tessella.llm import mixing, sharding


def targets_of(sizes, most=3):
    """Water filling, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        got = {s: most * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and got[s] > most * sizes[s]}
        if not over:
            return got
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, "d": 500, None: 7}, {"x": 5}, {"x": 0, "y": 0}, {"x": 0, "y": 9, "é": 1}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = targets_of(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0)
    assert {r.source: r.target for r in got} == pytest.approx(want)


def test_mix(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}" if i % 5 else None, "c") for i in range(400)] + [(None, None, "s0", "c"), (1, "same", "s1", "c"), (1, "same", "s1", "c")]
    rows.append((9_999, "long " * 200_000, "s1", "c"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string").repartition(3)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    taken, target = {}, {}
    for r in plan:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken == r._copies * r.size <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.25 * target[s] + 20 for s in target if s != "s1")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r._copies for r in plan) and {r.copies for r in mixed.collect()} == {"c"}
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, mixed.collect()))
    assert mixing.mix(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bucket_bytes", [500, 1 << 20])
def test_shards(spark, bucket_bytes):
    rows = [(i, f"text {i} é" * (i % 5), "a") for i in range(203)] + [(None, None, "b"), (None, "", "b"), (7, "same", "c"), (7, "same", "c")] + [(1000 + i, "copy", "d") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(3)
    got = sharding.shuffle_into_shards(docs, 16, bucket_bytes=bucket_bytes)
    assert got.columns == [*docs.columns, "shard", "slot"]
    found = got.collect()
    assert sorted(str(r[:3]) for r in found) == sorted(str(r) for r in map(tuple, rows))
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shuffle_into_shards(docs.repartition(2), 16, bucket_bytes=bucket_bytes).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    ids = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None and r.doc_id < 203]
    assert ids != sorted(ids)
    assert sharding.shuffle_into_shards(docs.limit(0), 16).collect() == []


def test_shards_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sharding.query(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def plain_shuffle(rows, shards, bucket_bytes):
    """Fisher-Yates over the same buckets, in plain lists; rows are (hash, row)."""
    import numpy as np

    total = sum(len((t or "").encode()) + 1 + sharding.ROW_BYTES for _, (_, t, *_) in rows)
    n = max(1, -(-total // bucket_bytes))
    buckets = {}
    for h, row in rows:
        buckets.setdefault(h % n, []).append((h, row))
    out = []
    for b in sorted(buckets):
        held = [row for _, row in sorted(buckets[b], key=lambda x: x[0])]
        last = np.arange(len(held) - 1, 0, -1)
        picks = np.random.default_rng([sharding.SEED, b]).integers(0, last + 1) if len(last) else []
        for i, j in zip(last, picks, strict=True):
            held[i], held[j] = held[j], held[i]
        out += held
    return [(row, p * shards // len(out)) for p, row in enumerate(out)]


def test_equals_a_plain_shuffle(spark):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(150)] + [(900, "w " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", f"xxhash64({sharding.SEED}, doc_id, text) AS h").collect()}
    got = sharding.shuffle_into_shards(docs, 5, bucket_bytes=3_000).collect()
    want = plain_shuffle([(hashes[r[0]], r) for r in rows], 5, 3_000)
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == [row[0] for row, _ in want]
    assert {r.doc_id: r.shard for r in got} == {row[0]: s for row, s in want}


def test_many_equal_rows_scatter(spark):
    docs = spark.range(5_000).selectExpr("CASE WHEN id < 3000 THEN NULL ELSE id END AS doc_id", "CASE WHEN id < 3000 THEN NULL ELSE 'x' END AS text", "'s' AS shard")
    got = sharding.shuffle_into_shards(docs, 7, bucket_bytes=20_000)
    assert got.columns == ["doc_id", "text", "shard", "_shard", "slot"]
    rows = got.collect()
    assert sum(r.doc_id is None for r in rows) == 3_000 and {r.shard for r in rows} == {"s"}
    by = {}
    for r in rows:
        by.setdefault(r._shard, []).append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    # the equal rows are in every shard, about as often as elsewhere
    assert all(0.4 <= sum(r.doc_id is None for r in x) / len(x) <= 0.8 for x in by.values())


def test_repeats_beside_columns_of_any_name(spark):
    docs = spark.range(400).selectExpr("CASE WHEN id < 250 THEN 7 ELSE id END AS `my.id`", "CASE WHEN id < 250 THEN 'x' ELSE repeat('y', 3) END AS `the text`", "1 AS `a.b`", "id AS Bucket")
    docs = docs.unionByName(spark.createDataFrame([(1_000, "long " * 200_000, 1, 5)], "`my.id` long, `the text` string, `a.b` int, Bucket long"))
    got = sharding.shuffle_into_shards(docs, 4, "my.id", "the text", bucket_bytes=4_000)
    assert got.columns == ["my.id", "the text", "a.b", "Bucket", "shard", "slot"]
    rows = got.collect()
    assert len(rows) == 401 and sum(r["my.id"] == 7 for r in rows) == 250 and max(len(r["the text"]) for r in rows) == 1_000_000
    sizes = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
