import random
import re

import numpy as np

from tessella.llm import near_duplicates as nd


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_equals_the_full_table():
    rng = random.Random(3)
    for _ in range(1500):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randrange(len(b) + 1), rng.randrange(4))
        most, d = rng.randrange(8), distance(a, b)
        assert nd.banded_distance(np.array(a, dtype=int), np.array(b, dtype=int), most) == (d if d <= most else None)


def test_sketch_keeps_order_and_occurrences():
    words = [f"w{i}" for i in range(400)]
    one = nd.sketch(nd.word_hashes(words))
    assert (one == nd.sketch(nd.word_hashes(words))).all()
    turned = nd.sketch(nd.word_hashes(words[200:] + words[:200]))
    assert 0 < (one == turned).sum() < nd.M
    assert len(nd.sketch(nd.word_hashes([]))) == 0
    assert len(set(nd.sketch(nd.word_hashes(words[:4])).tolist())) == 1


def words_apart(a, b):
    """Edit distance of two lists of words, by the full table, a row at a time."""
    names = {}
    x, y = (np.array([names.setdefault(w, len(names)) for w in s], dtype=int) for s in (a, b))
    place = np.arange(len(y) + 1)
    row = place.copy()
    for w in x:
        new = np.concatenate([[row[0] + 1], np.minimum(row[:-1] + (y != w), row[1:] + 1)])
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


def brute(texts, similarity=nd.SIMILARITY):
    """Classes over all pairs: texts are equal, or the edits between their words are few."""
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = find(i), find(j)
            if a != b:
                longer = max(len(words[i]), len(words[j]))
                near = longer and longer - min(len(words[i]), len(words[j])) <= 0.2 * longer and len(set(words[i]) & set(words[j])) and words_apart(words[i], words[j]) <= (1 - similarity) * longer + 1e-9
                if texts[i] == texts[j] or near:
                    label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([40, 90, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(7)):
            copy = list(base)
            for _ in range(max(1, len(copy) // 50)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts += [texts[-1]] * rng.randrange(3)
    shared = " ".join(word() for _ in range(60))
    texts += [" ".join(word() for _ in range(90)) + " " + shared for _ in range(25)]
    return texts


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in nd.mark(docs).collect()}
    want = brute(texts)
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(want))
    for i, r in got.items():
        assert r.class_size == want.count(want[i]) and r.kept == (r.class_id == i)
    assert sorted(r.doc_id for r in nd.deduplicate(docs).collect()) == sorted(set(want))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, None, "b"), (None, "one two three four five six", "c"), (9, "one two three four five six", "d"), (9, "one two three four five six", "d"), (4, "", "e"), (5, "", "f"), (6, "word", "g"), (7, "Word!", "h"), (8, "x " * 60_000, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id or 0, r.class_id, r.class_size, r._kept) for r in nd.mark(docs).collect())
    assert got == [(0, 9, 3, False), (1, 1, 1, True), (2, 2, 1, True), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 2, True), (7, 6, 2, False), (8, 8, 1, True), (9, 9, 3, True), (9, 9, 3, True)]
    left = nd.deduplicate(docs)
    assert left.columns == docs.columns and sorted((r.doc_id, r.kept) for r in left.collect()) == [(1, "a"), (2, "b"), (4, "e"), (6, "g"), (8, "i"), (9, "d")]
    assert nd.mark(docs.limit(0)).collect() == []


def assert_brute(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in nd.mark(docs).collect()} == dict(enumerate(brute(texts)))


def test_moved_and_repeated_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(200)]
        texts += [" ".join(base), " ".join(base[100:] + base[:100])]
        base = [word() for _ in range(200)]
        texts += [" ".join(base), " ".join(base + base[40:100])]
    assert_brute(spark, texts)


def test_copies_that_are_near_their_original_only(spark):
    """300 copies, a twelfth of whose words differ from the original, at a similarity that holds to the original alone."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(300):
        copy = list(base)
        for at in rng.sample(range(200), 16):
            copy[at] = word()
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = [r.class_id for r in nd.mark(docs, similarity=0.9).collect()]
    assert found.count(0) >= 0.9 * len(texts)


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    n = 120
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(300 + i, 350) for i in range(20)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = nd.components(spark.createDataFrame([(bytes([0, a // 256, a % 256]), bytes([0, b // 256, b % 256])) for a, b in edges], "a binary, b binary")).collect()
    found = {r.node[1] * 256 + r.node[2]: bytes(r.label) for r in got}
    assert found.keys() == label.keys()
    assert len(set(zip(found.values(), map(label.get, found), strict=True))) == len(set(found.values())) == len(set(label.values()))
    assert nd.components(spark.createDataFrame([], "a binary, b binary")).collect() == []


def template_texts(pairs):
    """Different texts on one long template, in pairs that share a little more: most of a pair's numbers are the template's."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    template = [word() for _ in range(150)]
    texts = []
    for _ in range(pairs):
        common = [word() for _ in range(15)]
        texts += [" ".join(template + common + [word() for _ in range(35)]) for _ in range(2)]
    return texts


def test_hundreds_of_different_texts_in_a_bucket(spark):
    assert_brute(spark, template_texts(100))


def test_large_buckets_are_divided_without_loss(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    assert_brute(spark, template_texts(50) + corpus())


def test_blocks_give_the_links_of_all_pairs():
    import pyarrow as pa

    words = [nd.word_hashes(nd.words_of(t)).astype("<u4").tobytes() for t in template_texts(10)]
    names = [b"%02d" % i for i in range(len(words))]
    rows = pa.table({"key": names, "label": names, "b": [i % 2 for i in range(len(words))], "words": words})
    found = [sorted(p) for low, high in ((0, 0), (0, 1), (1, 1)) for p in nd.block_links(rows.filter(pa.array([i % 2 in (low, high) for i in range(len(words))])), nd.SIMILARITY, low, high)]
    assert sorted(found) == [[names[i], names[i + 1]] for i in range(0, len(words), 2)]


def test_recall_on_the_documents(spark, sf_dir):
    """Every pair of the table's texts that is near by the full table is in one class, but for a tenth at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    rows = docs.collect()
    got = {r.doc_id: r.class_id for r in nd.mark(docs).collect()}
    want = brute([r.text for r in rows])
    together = [(rows[i].doc_id, rows[want[i]].doc_id) for i in range(len(rows)) if want[i] != i]
    assert len(together) > 5 and sum(got[a] == got[b] for a, b in together) >= 0.9 * len(together)
    place = {r.doc_id: want[i] for i, r in enumerate(rows)}
    assert all(place[a] == place[b] for a, b in got.items())


def edited(rng, words, share):
    """``words`` with a share of them replaced, dropped or followed by a new one."""
    out, at = [], set(rng.sample(range(len(words)), int(share * len(words))))
    for i, w in enumerate(words):
        kind = rng.randrange(3) if i in at else None
        new = "".join(rng.choices("abcdefgh", k=6))
        out += {None: [w], 0: [new], 1: [], 2: [w, new]}[kind]
    return out


def test_recall_by_share_of_edits():
    rng = random.Random(12)
    for share in (0.1, 0.15, 0.2):
        near = found = 0
        for _ in range(150):
            base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
            a, b = nd.word_hashes(base), nd.word_hashes(edited(rng, base, share))
            if nd.are_near(a, b):
                near += 1
                found += bool(set(nd.sketch(a).tolist()) & set(nd.sketch(b).tolist()))
        assert near > 20 and found >= 0.9 * near


def test_masks_of_the_band_equal_dense_ones(monkeypatch):
    rng = random.Random(4)
    cases = [([rng.randrange(5) for _ in range(60)], rng.randrange(1, 20)) for _ in range(40)]
    pairs = [(np.array(a), np.array(edited_numbers(rng, a)), most) for a, most in cases]
    dense = [nd.banded_distance(*p) for p in pairs]
    monkeypatch.setattr(nd, "DENSE", 0)
    assert [nd.banded_distance(*p) for p in pairs] == dense and any(d is not None for d in dense)


def edited_numbers(rng, a):
    return [x for x in (rng.choice([y, y, y, y, rng.randrange(5)]) for y in a) if rng.random() < 0.95]


def test_a_pair_of_very_long_texts():
    import tracemalloc

    rng = np.random.default_rng(5)
    a = (rng.zipf(1.3, 60_000) % 15_000).astype(np.uint32)
    b = a.copy()
    b[rng.choice(len(b), 3_000, replace=False)] = 2**31
    tracemalloc.start()
    assert nd.are_near(a, b)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20  # a mask per word as long as the text would take 100 MB


def test_length_classes_lose_nothing(spark, monkeypatch):
    """Large buckets of texts of many lengths on one template: only pairs of neighbouring classes can be near."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    template, texts = [word() for _ in range(30)], []
    for n in list(range(5, 60, 3)) * 2:
        own = [word() for _ in range(n)]
        texts += [" ".join(template + own), " ".join(template + own + [word() for _ in range((30 + n) // 6)])]
    assert_brute(spark, texts)
