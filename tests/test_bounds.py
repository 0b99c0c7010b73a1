"""Memory and plans that stay bounded as tables grow."""

import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessella.operators import cases, embedding, retrieval
from tessella.plans import catalog
from tessella.sources import readers


def test_knn_holds_a_block_and_lets_queries_pass(spark):
    rng = np.random.default_rng(3)
    ids, vectors = np.arange(30_000), rng.integers(-2, 3, (30_000, 8)).astype(float)  # many equal scores, equal vectors and zeros
    vectors[:40] = 0

    def stream():
        for part, asked in ((ids, False), (ids[::20], True)):
            for i in range(0, len(part), 1_000):
                some = part[i : i + 1_000]
                yield pa.RecordBatch.from_pydict({"block": ["b"] * len(some), "asked": [asked] * len(some), "id": some, "vector": list(vectors[some])})

    tracemalloc.start()
    most, got = 0, {}
    for batch in retrieval._search(stream(), 7):
        for q, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got.setdefault(q, []).append((-s, i))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300 << 20  # all pairs of scores are 360 MB, and were held with two copies of them
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]
    for q in [*range(0, 400, 20), *range(400, 30_000, 1_900)]:
        s = np.round(unit[q] @ unit.T, 9)
        want = [(-s[i], i) for i in np.lexsort((ids, -s)) if i != q][:7]
        assert [i for _, i in got[q]] == [i for _, i in want] and [x for x, _ in got[q]] == pytest.approx([x for x, _ in want])


def test_runs_of_a_text_are_not_shuffled_one_by_one(spark, monkeypatch):
    texts = spark.createDataFrame([(i % 60, "the same few words again and again " * 50 + f"own{i} word") for i in range(80)], "id long, text string")
    want = {r.id: r.vector for r in embedding.HashedGrams.fitted(texts, "text", 16).embed(texts, "id", "text").collect()}
    assert embedding._held(embedding._in_blocks(texts, "id", "text", 16)[0], 2).count() <= 80 * 3 + 40  # a row per text and run before
    for size in (1 << 20, 2_000):  # equal keys in several blocks
        monkeypatch.setattr(embedding, "BLOCK_BYTES", size)
        got = {r.id: r.vector for r in embedding.HashedGrams.embed_corpus(texts, "id", "text", 16).collect()}
        assert got == want


def test_documents_of_a_small_table_are_checked_by_all_slots(spark, sf_dir):
    for name in ("dsl_violations", "dsl_adopt", "dsl_types", "dsl_check_batch"):
        assert catalog.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 4, name


def test_lines_are_numbered_without_a_sort_of_them(spark, tmp_path):
    for name, n in (("a", 3_000), ("b", 1), ("c", 700)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits of a file
    try:
        lines = readers.numbered_lines(spark, str(tmp_path))
        got = [(r.file[-5], r.line, r.value) for r in lines.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3_701 and all(value == f"{name}{line}" for name, line, value in got)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "value" not in plan[plan.index("Window") :].split("Relation")[0]


def test_a_tree_is_not_shuffled(spark):
    deep = {"ref": "leaf"}
    for _ in range(450):
        deep = {"children": [deep]}
    odd = '{"ref": 5, "role": 1.50, "name": true, "attributes": {"data-testid": {"b": 1, "a": [2.0, "x"]}}, "children": {"b": {"ref": "2"}, "a": {"ref": "1"}, "c": 4}}'
    rows = [("p", json.dumps(deep)), ("q", odd), ("r", '{"ref": 1, "ref": 2}'), ("s", '{"name": "\\u00e9\\ud83d\\ude00"}')]
    nodes = cases.flatten_trees(spark.createDataFrame(rows, "page string, raw string"))
    assert "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in nodes.orderBy("page", "preorder").collect():
        got.setdefault(r.page, []).append(r)
    assert len(got["p"]) == 451 and got["p"][-1].depth == 450 and got["p"][-1].ref == "leaf"
    first = spark.sql("""SELECT try_variant_get(v, '$.ref', 'string') ref, try_variant_get(v, '$.role', 'string') role, try_variant_get(v, '$.name', 'string') name, try_variant_get(v, "$.attributes['data-testid']", 'string') test_id FROM (SELECT parse_json('%s') v)""" % odd).first()
    assert tuple(got["q"][0])[3:] == tuple(first) and [r.ref for r in got["q"]] == ["5", "1", "2"]
    assert "r" not in got and got["s"][0].name == "\u00e9\U0001f600"


@pytest.mark.parametrize("turn", (1, 2))
def test_memory_is_traced_for_one_test_alone(turn):
    assert not tracemalloc.is_tracing()
    tracemalloc.start()  # left on
