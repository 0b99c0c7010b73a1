import re
from collections import Counter

import corpus_pipeline as cp
from tessella.llm import language, near_duplicates as nd, privacy
from tessella.llm.mixing import source_targets

from .test_near_duplicates import brute


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "remove_personal_data", "mix_sources", "encode"] and len(rows) >= 200

    told = stage["language_id"](spark, docs, sf_dir)
    assert told.columns == docs.columns
    model = language.fit(docs)
    kept = [r for r in rows if (p := language.predict(model, r.text))[0] != "und" and p[1] >= language.MIN_MARGIN]
    assert Counter(told.collect()) == Counter(kept) and len(kept) > 0.95 * len(rows)

    one = stage["near_dedup"](spark, told, sf_dir)
    label = brute([r.text for r in kept])
    want = sorted(min((kept[i] for i in range(len(kept)) if label[i] == x), key=lambda r: r.doc_id).doc_id for x in set(label))
    got = sorted(r.doc_id for r in one.collect())
    assert got == want and one.columns == docs.columns

    safe = stage["remove_personal_data"](spark, one, sf_dir)
    before, after = {r.doc_id: r for r in one.collect()}, {r.doc_id: r for r in safe.collect()}
    assert before.keys() == after.keys() and safe.columns == docs.columns
    for i, r in after.items():
        spans = privacy.base_spans(before[i].text)
        assert (r == before[i]) if not spans else not any(s[0] == "email" for s in privacy.base_spans(r.text))
        assert r.n_chars == len(r.text)

    mixed = stage["mix_sources"](spark, safe, sf_dir)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = Counter()
    for r in after.values():
        sizes[r.source] += size(r.text)
    targets = {r.source: r for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert abs(sum(t.target for t in targets.values()) - sum(sizes.values())) < 1e-3
    times = Counter(r.doc_id for r in mixed.collect())
    assert all(int(targets[r.source].rate) <= times[i] <= min(3, int(targets[r.source].rate) + 1) for i, r in after.items())
    assert mixed.columns == docs.columns

    ids = stage["encode"](spark, mixed, sf_dir)
    assert Counter(r.doc_id for r in ids.collect()) == times


def test_odd_tables(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, "a b c", "en", None, 5), (1, None, None, "x", 0), (1, "", "en", "x", 0), (2, "the cat sat on the mat", "en", "x", 22), (2, "the cat sat on the mat", "en", "x", 22)], kind)
    for table in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, table, sf_dir)
            assert name == "encode" or out.columns == docs.columns
            out.collect()


def test_columns_of_any_name_keep_their_values(spark, sf_dir):
    names = ("copies", "kept", "score", "pii", "Rejected", "clean_text", "class_id", "mix_source", "near_key", "pii_key", "size", "taken")
    rows = [(i, f"the quick brown fox number {i} and the lazy dog write to a{i}@mail.example.com", "en", f"s{i % 3}", 70, *(f"{n}{i}" for n in names)) for i in range(12)]
    rows += [(20, "der schnelle braune fuchs und der faule hund", "de", "s0", 40, *(f"{n}20" for n in names))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names), name
