"""Operators against plain versions, on random tables, and against stated cases."""

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import generated as g
from tessella.functions import splitters as sp
from tessella.functions import text as t
from tessella.functions.json_schema import compile_schema
from tessella.operators import cases, evaluation as ev, rerank, retrieval, runs, store
from tessella.sources import readers
from tessella.streaming import ingest

QRELS = "query_id string, candidate_id string, grade int"
RANKS = "query_id string, candidate_id string, rank int, grp string"


def evaluation_tables(seed=11, queries=25):
    """Labels with ties and gaps, and two systems' rankings, some of which are short, empty or full of unlabelled items."""
    rng = random.Random(seed)
    labels, ranks = {}, {}
    for q in range(queries):
        pool = [f"d{i}" for i in range(14)]
        labels[f"q{q}"] = {c: rng.choice([0, 0, 1, 2, 3]) for c in rng.sample(pool, rng.randrange(1, 12))}
        for system in ("one", "two"):
            if rng.random() < 0.9:
                ranks[system, f"q{q}"] = rng.sample(pool, rng.randrange(0, 13))
    return labels, ranks


def plain_metrics(order, grades, k):
    top = order[:k]
    relevant = [c for c, x in grades.items() if x >= 2]
    high = [c for c, x in grades.items() if x >= 3]
    gain = lambda xs: sum(x / math.log2(i + 2) for i, x in enumerate(xs))
    ideal = gain(sorted(grades.values(), reverse=True)[:k])
    places = [i for i, c in enumerate(top, 1) if c in relevant]
    false = sum(grades.get(c) == 0 for c in top)
    missed = len(high) - sum(c in high for c in top)
    share = lambda a, b: a / b if b else 0.0
    return (share(len(places), len(relevant)), share(len(places), len(top)), 1 / places[0] if places else 0.0, share(gain([grades.get(c, 0) for c in top]), ideal), false, share(false, len(top)), missed, share(missed, len(high)))


def as_tables(spark, labels, ranks):
    qrels = spark.createDataFrame([(q, c, x) for q, cs in labels.items() for c, x in cs.items()], QRELS)
    return qrels, spark.createDataFrame([(q, c, i, s) for (s, q), order in ranks.items() for i, c in enumerate(order, 1)], RANKS)


def test_metrics_against_a_plain_version(spark):
    labels, ranks = evaluation_tables()
    qrels, ranked = as_tables(spark, labels, ranks)
    got = {(r.grp, r.query_id, r.k): r for r in ev.metrics(ranked, qrels, group=["grp"]).collect()}
    assert len(got) == 2 * len(labels) * len(ev.KS)
    for (system, q, k), r in got.items():
        want = plain_metrics(ranks.get((system, q), []), labels[q], k)
        assert (r.recall, r.precision, r.mrr, r.ndcg, r.fp_count, r.fp_rate, r.fn_count, r.fn_rate) == pytest.approx(want)
    alone = ev.metrics(ranked.where("grp = 'one'").drop("grp"), qrels).collect()
    assert all(r.ndcg == pytest.approx(got["one", r.query_id, r.k].ndcg) for r in alone)


def test_losses_failures_and_classes_against_plain_versions(spark):
    labels, ranks = evaluation_tables(12, 40)
    frozen = {q: sorted({c for s in ("one", "two") for c in ranks.get((s, q), [])} - {"d3", "d7"}) for q in labels}
    qrels, ranked = as_tables(spark, labels, ranks)
    have = spark.createDataFrame([(q, c) for q, cs in frozen.items() for c in cs], "query_id string, candidate_id string")
    relevant = lambda q, cs: {c for c in cs if labels[q].get(c, 0) >= 2}
    for k in (None, 3):
        lost = {r.query_id: r.drop_rate for r in ev.drop_rate(ranked.where("grp = 'one'"), have, qrels, k).collect()}
        for q, x in lost.items():
            good = relevant(q, frozen[q])
            assert x == pytest.approx(len(good - set(ranks.get(("one", q), [])[:k])) / len(good) if good else 0)
    failed = {r.query_id: r.retrieval_failure for r in ev.retrieval_failures(have, qrels).collect()}
    assert failed == {q: not relevant(q, cs) for q, cs in frozen.items() if cs}
    want = dict.fromkeys(("retrieval_failure", "both_success", "both_failure", "reranking_failure_only", "a_only", "b_only"), 0)
    for q, bad in failed.items():
        ok = [bool(relevant(q, ranks.get((s, q), [])[:5])) for s in ("one", "two")]
        name = "retrieval_failure" if bad else {(1, 1): "both_success", (0, 0): "both_failure", (1, 0): "a_only", (0, 1): "b_only"}[tuple(map(int, ok))]
        want[name] += 1
    want["reranking_failure_only"] = want["both_failure"]
    got = {r["class"]: r.queries for r in ev.error_classes(ranked, qrels, ev.retrieval_failures(have, qrels), "one", "two").collect()}
    assert got == want and sum(want.values()) > 10
    macro = {(r.grp, r.k): r for r in ev.macro(ev.metrics(ranked, qrels, group=["grp"]), ev.retrieval_failures(have, qrels), ["grp"]).collect()}
    kept = [q for q, bad in failed.items() if not bad]
    for (system, k), r in macro.items():
        assert r.queries == len(kept)
        assert r.ndcg == pytest.approx(sum(plain_metrics(ranks.get((system, q), []), labels[q], k)[3] for q in kept) / len(kept), abs=6e-5)
    text = ev.markdown_report(ev.macro(ev.metrics(ranked, qrels, group=["grp"]), ev.retrieval_failures(have, qrels), ["grp"]), ev.error_classes(ranked, qrels, ev.retrieval_failures(have, qrels), "one", "two"), {"candidates": "13"})
    assert f"| ndcg@5 | {macro['one', 5].ndcg} | {macro['two', 5].ndcg} |" in text and f"| a_only | {want['a_only']} |" in text


def test_judge_scores(spark):
    rng = random.Random(3)
    rows = [({n: rng.random() for n in rng.sample(["directly_answers", "useful", "tangential", "irrelevant"], rng.randrange(5))},) for _ in range(40)]
    got = spark.createDataFrame(rows, "p map<string,double>").select("p", *g.judge_scores(F.col("p"))).collect()
    for r in got:
        expected = 3 * r.p.get("directly_answers", 0) + 2 * r.p.get("useful", 0) + r.p.get("tangential", 0)
        assert (r.score_choice, r.score_expected, r.score_normalized) == pytest.approx((r.p.get("directly_answers", 0), expected, expected / 3))


def test_character_sets(spark):
    rng = random.Random(4)
    pairs = [tuple(None if rng.random() < 0.1 else "".join(rng.choices("abcXYZ 019-é中", k=rng.randrange(7))) for _ in range(2)) for _ in range(200)]
    letters = lambda x: {c for c in x.lower() if c.isalnum()}
    for a, b, found in spark.createDataFrame(pairs, "a string, b string").select("a", "b", t.char_jaccard(F.col("a"), F.col("b"))).collect():
        both = letters(a) | letters(b) if a is not None and b is not None else set()
        want = 0 if a is None or b is None else 1 if a == b else len(letters(a) & letters(b)) / len(both) if both else 0
        assert found == pytest.approx(want)


def plain_diverse(texts, scores, n, weight):
    left, chosen = list(range(len(texts))), []
    while left and len(chosen) < n:
        value = lambda i: weight * scores[i] - (1 - weight) * max((rerank.jaccard(texts[i], texts[j]) for j in chosen), default=0.0)
        chosen.append(max(left, key=lambda i: (value(i), -i)))
        left.remove(chosen[-1])
    return chosen


def test_diversity_against_a_plain_version():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(2, 9)
        texts = ["".join(rng.choices("abcdefg ", k=rng.randrange(1, 9))) for _ in range(n)]
        scores = [round(rng.random(), 1) for _ in range(n)]
        k = rng.randrange(1, n)
        assert rerank.mmr_order(texts, scores, k) == plain_diverse(texts, scores, k, rerank.LAMBDA)
        assert rerank.mmr_order(texts, scores, k, first="input")[0] == 0


def test_dead_letters_and_best_chunks(spark):
    dead = spark.createDataFrame([(f"t{i}", i % 4) for i in range(9)], "task_id string, failed_at int")
    n, last = ingest.dead_letter_stats(dead, 3)
    assert n == 9 and [r.task_id for r in last.collect()] == ["t3", "t7", "t2"]
    hits = spark.createDataFrame([("r", i, f"d{i % 3}", 1.0 - i / 10) for i in range(8)], "request string, id int, doc string, score double")
    assert [(r.id, r.place) for r in retrieval.best_chunk_per_document(hits, "doc", 2).orderBy("place").collect()] == [(0, 1), (1, 2)]
    bad = spark.createDataFrame([("", [], [])], readers.EVAL_QUERY.replace("query_id string,", "query_id string,").split(", query string")[0] + ", candidates array<struct<rag_rank: int>>, ground_truth array<struct<relevance: int>>")
    assert readers.invalid_queries(bad).count() == 1


def test_two_stage_falls_back(spark):
    rows = [(1, i, i, 1 - i / 10, f"note {i} {'pqrstuvw'[i]}") for i in range(1, 8)]
    c = spark.createDataFrame(rows, "query_id long, candidate_id long, rag_rank int, score double, text string")
    assert {r.reranker for r in rerank.two_stage(c, None, 3).collect()} == {"mmr"}
    ext = spark.createDataFrame([(1, i, float(i)) for i in range(1, 8)], "query_id long, candidate_id long, relevance double")
    got = rerank.two_stage(c, ext, 3).orderBy("new_rank").collect()
    assert len(got) == 3 and [r.candidate_id for r in got] == sorted((r.candidate_id for r in got), reverse=True)


@pytest.mark.parametrize("on", [[], ["tag"]])
def test_knn_against_brute_force(spark, on, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 37)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(150)] + [(500, [0.0] * 6, 0)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, tag int")
    got = {}
    for r in retrieval.knn(v.where("id % 20 = 0").selectExpr("id AS query_id", "vector AS q", "tag").select("query_id", "q", *on), v.select("id", "vector", *on), 4, on).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))

    def cos(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    for q, vec, tag in rows:
        if q % 20 == 0:
            want = sorted((-round(cos(vec, w), 9), i) for i, w, x in rows if i != q and (not on or x == tag))[:4]
            assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want]
            assert [-s for _, _, s in sorted(got[q])] == pytest.approx([s for s, _ in want])


def attempts(spark, rows):
    return spark.createDataFrame(rows, "run_id string, case_id string, attempt_number int, outcome string")


@pytest.mark.parametrize(
    ("rows", "status", "outcome"),
    [
        ([("a", 1, "PASSED")], "RUNNING", "PASS"),
        ([("a", 1, "PASSED"), ("b", 1, "PASSED")], "COMPLETED", "PASS"),
        ([("a", 1, "FAILED"), ("a", 2, "PASSED"), ("b", 1, "PASSED")], "COMPLETED", "PASS"),
        ([("a", 1, "FAILED"), ("b", 1, "PASSED")], "COMPLETED", "FAIL"),
        ([("a", 1, "BLOCKED"), ("b", 1, "PASSED")], "COMPLETED", "ERROR"),
        ([("a", 1, "BLOCKED"), ("b", 1, "FAILED")], "FAILED", "FAIL"),
    ],
)
def test_run_status(spark, rows, status, outcome):
    r = runs.rollup(attempts(spark, [("r", *x) for x in rows])).select(runs.run_status(F.lit(2)).alias("s"), runs.overall_outcome().alias("o")).first()
    assert (r.s, r.o) == (status, outcome)


def test_artifacts(spark):
    rows = [(1, "image/png", "screenshot", "../../etc"), (60 << 20, "image/png", "x", "a"), (1, "application/zip", "LOG", "b"), (1, None, "Trace", "c"), (1, "image/jpg", "a11y", "d")]
    df = spark.createDataFrame(rows, "size long, kind string, type string, run string")
    got = df.select(runs.validate_artifact(F.col("size"), F.col("kind")), runs.artifact_type(F.col("type")), runs.artifact_path(F.col("run"), F.lit("c"), F.lit(1), F.lit("id"))).collect()
    assert [r[0] for r in got] == [None, "too large", "content type not allowed", "content type not allowed", None]
    assert [r[1] for r in got] == ["SCREENSHOT", "OTHER", "OTHER", "TRACE", "A11Y"]
    assert ".." not in got[0][2]


VALID = {
    "schemaVersion": "1.0.0",
    "summary": {"app": "library", "page": "shelf", "totalCases": 1},
    "cases": [
        {
            "caseId": "TC_7",
            "title": "Lend a book",
            "caseType": "FLOW",
            "automationCandidate": "WEB_FUNCTIONAL",
            "testData": {"title": "Emma", "copies": 2, "new": True, "tags": ["a", "b"]},
            "steps": [
                {"order": 1, "action": "NAVIGATE", "url": "http://shelf"},
                {"order": 2, "action": "INPUT", "target": {"strategy": "ROLE", "role": "textbox", "name": "Title"}, "value": "Emma"},
                {"order": 3, "action": "ASSERT", "target": {"strategy": "LABEL", "text": "Lent"}},
                {"order": 4, "action": "WAIT"},
            ],
            "expectedOutcome": "lent",
            "assertions": [{"kind": "TEXT_CONTAINS", "target": {"strategy": "TEXT", "text": "Lent"}, "expected": "Lent"}, {"kind": "VALUE_EQUALS", "expected": "x"}],
        }
    ],
}


def broken(path, value):
    doc = json.loads(json.dumps(VALID))
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(doc)


CASE, STEP, CHECK = ("cases", 0), ("cases", 0, "steps", 1), ("cases", 0, "assertions", 0)
AT, J, K = "$.cases[0]", "$/cases/0", "$.cases[0].steps[1]"
LOCATOR = "SEM_LOCATOR_FIELD_REQUIRED"
BROKEN = [
    (json.dumps(VALID), set()),
    ("{not json", {("$", "PARSE_ERROR")}),
    (broken(("schemaVersion",), "2.0.0"), {("$.schemaVersion", "UNKNOWN_VERSION")}),
    (broken(("schemaVersion",), "1.0"), {("$/schemaVersion", "SCHEMA_const"), ("$.schemaVersion", "SEM_SCHEMA_VERSION")}),
    (broken(("schemaVersion",), ...), {("$", "SCHEMA_required"), ("$.schemaVersion", "SEM_SCHEMA_VERSION")}),
    (broken(("cases",), []), {("$/cases", "SCHEMA_minItems"), ("$.cases", "SEM_CASES_EMPTY")}),
    (broken(("summary",), ...), {("$", "SCHEMA_required"), ("$.summary", "SEM_SUMMARY_REQUIRED")}),
    (broken(("summary", "page"), ...), {("$/summary", "SCHEMA_required")}),
    (broken(("summary", "app"), ""), {("$/summary/app", "SCHEMA_minLength")}),
    (broken(("summary", "totalCases"), ...), {("$/summary", "SCHEMA_required"), ("$.summary.totalCases", "SEM_FIELD_REQUIRED")}),
    (broken(("summary", "totalCases"), -1), {("$/summary/totalCases", "SCHEMA_minimum")}),
    (broken(("summary", "owner"), "x"), {("$/summary", "SCHEMA_additionalProperties")}),
    (broken(("extra",), 1), {("$", "SCHEMA_additionalProperties")}),
    (broken((*CASE, "caseId"), "case 1"), {(f"{J}/caseId", "SCHEMA_pattern")}),
    (broken((*CASE, "caseId"), ...), {(J, "SCHEMA_required")}),
    (broken((*CASE, "title"), "abc"), {(f"{J}/title", "SCHEMA_minLength")}),
    (broken((*CASE, "title"), "x" * 201), {(f"{J}/title", "SCHEMA_maxLength")}),
    (broken((*CASE, "title"), "     "), {(f"{AT}.title", "SEM_FIELD_REQUIRED")}),
    (broken((*CASE, "automationCandidate"), ...), {(J, "SCHEMA_required"), (f"{AT}.automationCandidate", "SEM_FIELD_REQUIRED")}),
    *[(broken((*CASE, name), "OTHER"), {(f"{J}/{name}", "SCHEMA_enum"), ("$", "SEMANTIC_PARSE")}) for name in ("caseType", "designMethod", "priority", "risk", "automationCandidate")],
    (broken((*CASE, "testData"), {"x": {"deep": 1}}), {(f"{J}/testData/x", "SCHEMA_anyOf")}),
    (broken((*CASE, "expectedOutcome"), ""), {(f"{J}/expectedOutcome", "SCHEMA_minLength")}),
    (broken((*CASE, "steps"), []), {(f"{J}/steps", "SCHEMA_minItems"), (f"{AT}.steps", "SEM_STEPS_EMPTY")}),
    (broken((*CASE, "odd"), 1), {(J, "SCHEMA_additionalProperties")}),
    (broken((*STEP, "order"), 5), {(f"{K}.order", "SEM_ORDER_SEQUENTIAL")}),
    (broken((*STEP, "order"), ...), {(f"{J}/steps/1", "SCHEMA_required"), (f"{K}.order", "SEM_FIELD_REQUIRED")}),
    (broken((*STEP, "action"), ...), {(f"{J}/steps/1", "SCHEMA_required"), (f"{K}.action", "SEM_FIELD_REQUIRED")}),
    (broken((*STEP, "action"), "HOVER"), {(f"{J}/steps/1/action", "SCHEMA_enum"), ("$", "SEMANTIC_PARSE")}),
    (broken((*STEP, "timeoutMs"), 99), {(f"{J}/steps/1/timeoutMs", "SCHEMA_minimum")}),
    (broken((*STEP, "timeoutMs"), 60_001), {(f"{J}/steps/1/timeoutMs", "SCHEMA_maximum")}),
    (broken((*STEP, "nested"), {}), {(f"{J}/steps/1", "SCHEMA_additionalProperties")}),
    (broken((*STEP, "target"), ...), {(f"{K}.target", "SEM_TARGET_REQUIRED")}),
    (broken((*STEP, "value"), " "), {(f"{K}.value", "SEM_VALUE_REQUIRED")}),
    (broken((*STEP, "target"), {"role": "x"}), {(f"{J}/steps/1/target", "SCHEMA_required"), (f"{K}.target.strategy", "SEM_FIELD_REQUIRED")}),
    (broken((*STEP, "target"), {"strategy": "ROLE"}), {(f"{K}.target.role", LOCATOR), (f"{K}.target.name", LOCATOR)}),
    (broken((*STEP, "target"), {"strategy": "ROLE", "role": "button"}), {(f"{K}.target.name", LOCATOR)}),
    (broken((*STEP, "target"), {"strategy": "TEXT"}), {(f"{K}.target.text", LOCATOR)}),
    (broken((*STEP, "target"), {"strategy": "LABEL"}), {(f"{K}.target.label", LOCATOR)}),
    (broken((*STEP, "target"), {"strategy": "TESTID", "testId": " "}), {(f"{K}.target.testId", LOCATOR)}),
    (broken((*STEP, "target"), {"strategy": "CSS"}), {(f"{K}.target.selector", LOCATOR)}),
    (broken((*STEP, "target"), {"strategy": "XPATH", "odd": 1}), {(f"{K}.target.xpath", LOCATOR), (f"{J}/steps/1/target", "SCHEMA_additionalProperties")}),
    (broken(("cases", 0, "steps", 0, "target"), {"strategy": "TEXT", "text": "x"}), {(f"{AT}.steps[0].target", "SEM_TARGET_FORBIDDEN_NAVIGATE")}),
    (broken(("cases", 0, "steps", 0, "url"), ""), {(f"{AT}.steps[0].url", "SEM_URL_REQUIRED_NAVIGATE")}),
    (broken(("cases", 0, "steps", 2, "target"), ...), {(f"{AT}.steps[2].target", "SEM_TARGET_REQUIRED")}),
    (broken((*CHECK, "kind"), ...), {(f"{J}/assertions/0", "SCHEMA_required"), (f"{AT}.assertions[0].kind", "SEM_FIELD_REQUIRED")}),
    (broken((*CHECK, "expected"), ...), {(f"{AT}.assertions[0].expected", "SEM_EXPECTED_REQUIRED")}),
    (broken((*CHECK, "target"), ...), {(f"{AT}.assertions[0].target", "SEM_TARGET_REQUIRED_ASSERTION")}),
    (broken(("cases", 0, "assertions", 1, "expected"), ...), {(f"{AT}.assertions[1].expected", "SEM_EXPECTED_REQUIRED")}),
]

UNREAD = ("$", "SEMANTIC_PARSE")
TYPES = [
    # a scalar of another type is read all the same, an object or array where a scalar belongs is not
    *[(broken(path, value), {(at, "SCHEMA_type"), *more}) for path, at, values in (
        (("generatedAt",), "$/generatedAt", ((5, ()), ([], (UNREAD,)))),
        (("sourceRequirementRef",), "$/sourceRequirementRef", ((True, ()), ({}, (UNREAD,)))),
        (("summary", "app"), "$/summary/app", ((5, ()), (None, ()), ({"a": 1}, (UNREAD,)))),
        (("summary", "page"), "$/summary/page", ((1.5, ()),)),
        (("summary", "testScope"), "$/summary/testScope", ((0, ()),)),
        (("summary", "totalCases"), "$/summary/totalCases", (("one", (UNREAD,)), (1.5, ()), ("1", ()), (True, (UNREAD,)), (None, (("$.summary.totalCases", "SEM_FIELD_REQUIRED"),)))),
        ((*CASE, "caseId"), f"{J}/caseId", ((7, ()),)),
        ((*CASE, "title"), f"{J}/title", ((12345, ()), ([], (UNREAD,)))),
        ((*CASE, "precondition"), f"{J}/precondition", (("x", (UNREAD,)),)),
        ((*CASE, "precondition"), f"{J}/precondition/1", ((["a", 1], ()),)),
        ((*CASE, "testData"), f"{J}/testData", (([], (UNREAD,)),)),
        ((*CASE, "expectedOutcome"), f"{J}/expectedOutcome", ((False, ()),)),
        ((*STEP, "order"), f"{J}/steps/1/order", (("2", ()), ("x", (UNREAD,)))),
        ((*STEP, "target"), f"{J}/steps/1/target", (("x", (UNREAD,)),)),
        ((*STEP, "target", "exact"), f"{J}/steps/1/target/exact", (("true", ()), ("yes", (UNREAD,)), (1, ()))),
        *(((*STEP, "target", n), f"{J}/steps/1/target/{n}", ((5, ()),)) for n in ("role", "name", "text", "label", "testId", "selector", "xpath")),
        *(((*STEP, n), f"{J}/steps/1/{n}", ((5, ()),)) for n in ("url", "value", "expectedResult")),
        ((*STEP, "timeoutMs"), f"{J}/steps/1/timeoutMs", (("x", (UNREAD,)), (100.5, ()))),
        ((*CHECK, "expected"), f"{J}/assertions/0/expected", ((5, ()),)),
        ((*CHECK, "negate"), f"{J}/assertions/0/negate", (("no", (UNREAD,)),)),
    ) for value, more in values],
    (broken(("summary", "totalCases"), 1.0), set()),
    (broken((*CASE, "title"), None), {(f"{J}/title", "SCHEMA_type"), (f"{AT}.title", "SEM_FIELD_REQUIRED")}),
    (broken((*STEP, "action"), 5), {(f"{J}/steps/1/action", "SCHEMA_type"), (f"{J}/steps/1/action", "SCHEMA_enum"), UNREAD}),
    (broken((*CASE, "testData"), {"a": "x", "b": 1, "c": True, "d": ["y"], "e": [1], "f/g": None}), {(f"{J}/testData/e", "SCHEMA_anyOf"), (f"{J}/testData/f/g", "SCHEMA_anyOf")}),
    (broken(("cases",), {}), {("$/cases", "SCHEMA_type"), UNREAD}),
    (broken(("cases", 0), "x"), {(J, "SCHEMA_type"), UNREAD}),
    (broken(("summary",), []), {("$/summary", "SCHEMA_type"), UNREAD}),
    ("[]", {("$", "SCHEMA_type"), UNREAD}),
    ("5", {("$", "SCHEMA_type"), UNREAD}),
    ("", {("$", "PARSE_ERROR")}),
    (None, {("$", "PARSE_ERROR")}),
]


def test_types_of_every_field(spark):
    docs = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(TYPES)], "doc_key long, raw string")
    found = {i: set() for i in range(len(TYPES))}
    for r in cases.violations(docs).collect():
        found[r.doc_key].add((r.path, r.code))
    for i, (raw, want) in enumerate(TYPES):
        assert found[i] == want, raw
    assert {r.doc_key for r in cases.adopt(docs).collect()} == {i for i, (_, want) in enumerate(TYPES) if not want}


def test_schemas_of_several_versions(spark):
    two = {"type": "object", "required": ["schemaVersion", "tags"], "properties": {"tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"$ref": "#/$defs/Tag"}}, "n": {"type": ["integer", "null"], "maximum": 3}, "m": {"enum": [1, True, None, "x"]}, "o": {"const": 2.5}},
           "additionalProperties": {"type": "string"}, "$defs": {"Tag": {"anyOf": [{"type": "string", "maxLength": 2}, {"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id"]}]}}}
    doc = lambda **more: json.dumps({"schemaVersion": "2.0", "tags": ["a"], **more})
    rows = [(doc(), set()), (doc(n=None, m=None, o=2.5, schemaVersion="2.0"), set()), (doc(n=4), {("$/n", "SCHEMA_maximum")}), (doc(n="x"), {("$/n", "SCHEMA_type")}), (doc(m=2), {("$/m", "SCHEMA_enum")}), (doc(m=True), set()), (doc(o=2), {("$/o", "SCHEMA_const")}),
            (doc(tags=[]), {("$/tags", "SCHEMA_minItems")}), (doc(tags=["a", "b", "c"]), {("$/tags", "SCHEMA_maxItems")}), (doc(tags=["abc", {"id": 1}]), {("$/tags/0", "SCHEMA_anyOf")}), (doc(tags=[{"id": "x"}]), {("$/tags/0", "SCHEMA_anyOf")}), (doc(more=1), {("$/more", "SCHEMA_type")}), (json.dumps(VALID), set())]
    docs = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "doc_key long, raw string")
    found = {i: set() for i in range(len(rows))}
    for r in cases.checked(docs, versions={**cases.VERSIONS, "2.0": two}).select("doc_key", F.inline("found")).collect():
        if not r.code.startswith("SEM"):
            found[r.doc_key].add((r.path, r.code))
    assert [found[i] for i in range(len(rows))] == [want for _, want in rows]
    for bad in ({"oneOf": []}, {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"x": {"$ref": "#/$defs/a"}}}}}, {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}}):
        with pytest.raises(ValueError):
            compile_schema(bad, "v")


def test_violations(spark):
    docs = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(BROKEN)], "doc_key long, raw string")
    found = {i: set() for i in range(len(BROKEN))}
    for r in cases.violations(docs).collect():
        found[r.doc_key].add((r.path, r.code))
    for i, (raw, want) in enumerate(BROKEN):
        assert found[i] == want, raw
    assert [r.doc_key for r in cases.adopt(docs).collect()] == [0]
    summary = cases.adoption_summary(docs).first()
    assert (summary.documents, summary.valid, summary.status) == (len(BROKEN), 1, "PARTIAL")


def test_single_cases_are_wrapped(spark):
    one = json.dumps(VALID["cases"][0])
    raws = [json.dumps({"cases": [VALID["cases"][0]]}), json.dumps({"cases": [{"title": "no id"}]}), json.dumps(VALID)]
    got = [json.loads(r[0]) for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(cases.auto_wrap(F.col("raw"))).collect()]
    assert got[0]["summary"] == {"app": "validation", "page": "validation", "totalCases": 1} and got[1:] == [json.loads(r) for r in raws[1:]]
    batch = spark.createDataFrame([(1, one), (2, one.replace("lent", ""))], "case_key long, case_raw string")
    assert {(r.case_key, r.caseId, r.valid) for r in cases.check_batch(batch).collect()} == {(1, "TC_7", True), (2, "TC_7", False)}
    saved = cases.saved_cases(batch, F.lit("tag")).first()
    assert (saved.knowledge, saved.type, saved.adoptionStatus, saved.caseId) == ("tag", "test_case", "PENDING", "TC_7")


def test_locators(spark):
    nodes = spark.createDataFrame([("p", 1, "r1", "textbox", "Mail", "m"), ("p", 2, "r2", "button", "Log in now", None), ("p", 3, "r3", "button", "Log in", None)], "page string, preorder int, ref string, role string, name string, test_id string")
    kind = "locator_id int, page string, strategy string, role string, name string, text string, label string, test_id string, exact boolean"
    rows = [(1, "p", "ROLE", "button", "log", None, None, None, False), (2, "p", "ROLE", "button", "Log in", None, None, None, True), (3, "p", "LABEL", None, None, None, "mail", None, None), (4, "p", "TESTID", None, None, None, None, "m", None), (5, "p", "CSS", None, None, None, None, None, None), (6, "p", "TEXT", None, None, "now", None, None, None), (7, "p", "LABEL", None, None, "MAIL", None, None, None), (8, "p", "ROLE", "Button", None, None, None, None, None)]
    got = {r.locator_id: r.ref for r in cases.resolve(nodes, spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: "r2", 2: "r3", 3: "r1", 4: "r1", 5: None, 6: "r2", 7: "r1", 8: None}


def test_upsert_keeps_the_first_date(spark):
    old = spark.createDataFrame([("a", 1, "x", 10), ("b", 1, "y", 10)], "k string, version int, hash string, created int")
    new = spark.createDataFrame([("a", 2, "z", 20), ("c", 1, "w", 20)], old.schema)
    got = sorted(tuple(r) for r in store.upsert(old, new, ["k"], "version", ["created"]).collect())
    assert got == [("a", 2, "z", 10), ("b", 1, "y", 10), ("c", 1, "w", 20)]


def test_stream_equals_batch_and_routes_failures(spark, tmp_path):
    rows = [(f"t{i}", "bad" if i % 4 == 0 else "ok", i % 5) for i in range(40)]
    kind = "task_id string, payload string, retry_count int"
    spark.createDataFrame(rows, kind).repartition(4).write.parquet(str(tmp_path / "in"))
    done, retry, dead = (str(tmp_path / x) for x in ("done", "retry", "dead"))
    work = lambda p: F.when(p == "bad", F.lit("e" * 3000))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), kind, files_per_trigger=2)
    ingest.run_available(stream, lambda df, i: ingest.process_batch(df, work, done, retry, dead, i), str(tmp_path / "check"))
    ids = lambda p: sorted(r.task_id for r in spark.read.parquet(p).collect())
    assert ids(done) == sorted(i for i, p, _ in rows if p == "ok")
    assert ids(retry) == sorted(i for i, p, n in rows if p == "bad" and n < 3)
    assert ids(dead) == sorted(i for i, p, n in rows if p == "bad" and n >= 3)
    assert max(len(r.error) for r in spark.read.parquet(dead).collect()) == ingest.ERROR_CHARS


def test_replay_resets_failed_tasks_only(spark):
    dead = spark.createDataFrame([("a", "e"), ("b", "e")], "task_id string, error string")
    tasks = spark.createDataFrame([("a", "FAILED"), ("b", "COMPLETED")], "task_id string, status string")
    again, reset = ingest.replay(dead, tasks)
    assert [tuple(r) for r in again.collect()] == [("a", 0)]
    assert {tuple(r) for r in reset.collect()} == {("a", "PENDING"), ("b", "COMPLETED")}


def test_documents(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>T</h1><script>x()</script><p>a &amp; b</p>")
    (tmp_path / "b.md").write_text("# x")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.html"].text == "T\na & b" and got["a.html"].content_type == "text/html"
    assert got["b.md"].text == "# x" and got["c.pdf"].error == "unsupported format: pdf" and got["c.pdf"].text is None


def test_jsonl(spark, tmp_path):
    good = {"query_id": "q1", "candidates": [{"text": "x"}, {"candidate_id": "c", "retrieval_score": 0.5, "rag_rank": 7}]}
    (tmp_path / "f.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps({"query_id": None}) + "\n")
    got = readers.frozen_candidates(readers.read_jsonl(spark, str(tmp_path / "f.jsonl"), readers.FROZEN)).orderBy("rag_rank").collect()
    assert [(len(r.candidate_id), r.score, r.rag_rank) for r in got] == [(64, 0.0, 1), (1, 0.5, 7)]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), readers.FROZEN).collect()


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .,。\n中|-#", max_size=400), st.integers(1, 9), st.integers(0, 3))
def test_fixed_chunks_are_the_longest_that_fit(text, most, overlap):
    want, start = [], 0
    while start < len(text):
        end = start + 1
        while end < len(text) and sp.count_tokens(text[start : end + 1]) <= most:
            end += 1
        if text[start:end].strip():
            want.append(text[start:end])
        if end == len(text):
            break
        start = max(start + 1, end - 2 * overlap)
    assert sp.fixed_chunks(text, most, overlap) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,。\n中|-#", max_size=400))
def test_splitters_end_and_keep_all_text(text):
    letters = sum(c in "ab中" for c in text)
    c = sp.SplitConfig(max_length=30, min_length=5, min_to_embed=0, chunk_tokens=10, keep_tokens=12, split_tokens=8, overlap_tokens=3)
    for chunks in (sp.semantic_chunks(text, c), sp.token_chunks(text, c), sp.paragraph_chunks(text, c), sp.etl_chunks(text, c)):
        assert sum(sum(y in "ab中" for y in x) for x in chunks) >= letters
    kept = lambda x: x.replace("\n", "").replace(" ", "")
    assert kept("".join(sp.token_chunks(text, c))) == kept(text) and all(sp.count_tokens(x) <= 10 for x in sp.token_chunks(text, c))
    assert kept("".join(sp.fixed_chunks(text, 5))) == kept(text)


def test_chunkers_take_linear_time():
    text = "some words of a sentence. " * 80_000
    assert len(sp.token_chunks(text)) > 300 and len(sp.fixed_chunks(text, 300, 20)) > 1_000 and len(sp.etl_chunks(text)) > 300


def test_table_chunks_repeat_the_header():
    table = "\n".join(["| a | b |", "| --- | --- |", *(f"| {i} | x |" for i in range(50))])
    chunks = sp.table_chunks(table, sp.SplitConfig(split_tokens=40, overlap_tokens=8))
    assert len(chunks) > 2 and all(x.startswith("| a | b |\n| --- | --- |\n") for x in chunks)
    assert {y for x in chunks for y in x.split("\n")} == set(table.split("\n"))


def test_markdown_chunks_have_their_path():
    got = sp.markdown_chunks("# A\nbody one\n### C\nbody two\n## B\nbody three")
    assert got == ["A\nbody one", "A > C\nbody two", "A > B\nbody three"]


def test_any_number_of_groups(spark, monkeypatch):
    rankings = spark.createDataFrame([(1, i % 3, 1, f"g{i}") for i in range(25)] + [(2, 0, 1, None)], "query_id long, candidate_id long, rank int, grp string")
    qrels = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (2, 0, 2), (3, 5, 3)], "query_id long, candidate_id long, grade int")
    whole = sorted(map(str, ev.metrics(rankings, qrels, group=["grp"]).collect()))
    assert len(whole) == 3 * 26 * len(ev.KS)
    monkeypatch.setattr(ev, "GROUPS", 4)
    assert sorted(map(str, ev.metrics(rankings, qrels, group=["grp"]).collect())) == whole


def test_results_by_text(spark):
    f = spark.createDataFrame([(1, 10, 1, "a", 0.9), (1, 11, 2, "b", 0.8), (1, 12, 3, "a", 0.7), (1, 13, 4, None, 0.6)], "query_id long, candidate_id long, rag_rank int, text string, score double")
    r = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.4), (1, "b", 0.1), (1, "zz", 1.0), (1, None, 1.0), (2, "a", 1.0)], "query_id long, text string, relevance double")
    assert sorted(tuple(x) for x in rerank.by_text(f, r).collect()) == [(1, 0, 0.4), (1, 1, 0.1), (1, 1, 0.5)]
    got = [(x.candidate_id, x.new_score) for x in rerank.index_mapped(f, rerank.by_text(f, r), 4).orderBy("new_rank").collect()]
    assert got == [(11, 0.5), (10, 0.4), (12, 0.0), (13, 0.0)]
