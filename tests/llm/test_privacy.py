import hashlib
import random
import re

from tessella.llm import privacy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they are written, one by one."""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = digits(m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["@", ".", "-", " ", "a", "b.c", "x@y.z", "1", "23", "255", "256", "1.2.3.4", "+1", "+49 (0) 12-34.567", "4111 1111 1111 1111", "4111111111111111", "é", "\n", "％", "00.0.0.0", "+"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert privacy.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "a-" * 150_000 + "@"):
        privacy.base_spans(text)


def test_terms_that_disclose(spark):
    rng = random.Random(1)
    common = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(common, k=30))) for i in range(300)]
    for i in range(6):
        rows.append((1000 + i, f"{' '.join(rng.choices(common, k=12))} Zebulon writes to jo.x@mail.example.com {' '.join(rng.choices(common, k=12))} zebulon"))
    rows.append((2000, "Zebulon elsewhere"))
    rows.append((2001, "far away " * 100_000 + "jane.doe@mail.example.org"))
    rows += [(None, None), (3000, ""), (3000, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pii int").repartition(3)
    got = {r.doc_id: r for r in privacy.sanitise(docs).collect()}
    for i in range(6):
        r, text = got[1000 + i], dict(rows)[1000 + i]
        kinds = [s.kind for s in r._pii]
        assert kinds[0] == "email" and kinds.count("term") >= 2
        assert all(text[s.start : s.end].lower() in ("zebulon", "writes") for s in r._pii[1:])
        assert r.pii == 1 and "jo.x" not in r.clean_text and "ebulon" not in r.clean_text and "<EMAIL>" in r.clean_text
    # documents without the entity stay as they are
    assert all(got[i].clean_text == t and got[i]._pii == [] for i, t in rows if i is not None and not 1000 <= i < 1006 and i != 2001)
    assert got[None].clean_text is None
    assert privacy.sanitise(docs.limit(0)).collect() == []


def test_query_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = privacy.query(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = plain(docs[r.doc_id])
        said = privacy.joined(spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans.startswith(said)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in privacy.KINDS]
    assert any(r.spans for r in got)


def test_terms_are_counted_as_they_are_found(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"İstanbul office{i} jo.x@mail.example.com") for i in range(4)], "doc_id long, text string")
    terms = spark.createDataFrame([("İstanbul".lower(),)], "term string")
    for most in (privacy.BROADCAST_ROWS, 0):
        monkeypatch.setattr(privacy, "BROADCAST_ROWS", most)
        assert [tuple(r) for r in privacy.term_rows(docs, terms).collect()] == [("İstanbul".lower(), 4)]


def plain_terms(texts, window=privacy.WINDOW):
    """Terms and ratios of each text by the definition, over all pairs of entities and words."""
    import math

    word = re.compile(r"[^\W_]+")
    held, near = {}, {}
    for i, t in enumerate(texts):
        spans = privacy.protected_spans(t)
        words = [(m.group().lower(), m.start(), m.end()) for m in word.finditer(t)]
        free = lambda w, spans=spans: len(w[0]) >= 3 and not w[0].isdigit() and not any(a < w[2] and w[1] < b for _, a, b in spans)
        for kind, a, b in spans:
            e = privacy.entity_of(kind, t[a:b])
            held.setdefault(e, set()).add(i)
            for w in [w for w in words if w[2] <= a][-window:] + [w for w in words if w[1] >= b][:window]:
                if free(w):
                    near.setdefault((e, w[0]), set()).add(i)
    rows = lambda w: sum(w in {m.lower() for m in word.findall(t)} for t in texts)
    out = {}
    for (e, w), where in near.items():
        if len({texts[i] for i in held[e]}) >= privacy.MIN_TEXTS and len({texts[i] for i in where}) >= privacy.MIN_TEXTS:
            ratio = 1 - math.log2(rows(w) / len(where)) / math.log2(len(texts) / len(held[e]))
            if ratio >= privacy.GENERALISE:
                for i in held[e]:
                    if w in {m.group().lower() for m in word.finditer(texts[i])}:
                        out.setdefault(i, {})[w] = max(ratio, out.get(i, {}).get(w, 0))
    return out


def test_terms_equal_a_plain_version(spark):
    rng = random.Random(6)
    names = [f"name{c}x" for c in "abcdefgh"]
    common = [f"word{i}" for i in range(30)]
    texts = []
    for i in range(240):
        words = rng.choices(common, k=rng.randrange(3, 40))
        if i % 3 == 0:
            who = rng.randrange(8)
            words.insert(rng.randrange(len(words)), f"{names[who]} at n{who}@mail.example.com")
            if rng.random() < 0.3:
                words.insert(0, f"+49 30 1234567{rng.randrange(2)} {names[rng.randrange(8)]}")
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.row_text: dict(zip(r.terms, r.ratios, strict=True)) for r in privacy.disclosing_terms(docs).collect()}
    want = {hashlib.md5(texts[i].encode()).hexdigest(): terms for i, terms in plain_terms(texts).items()}
    assert len(want) > 20 and {k: v.keys() for k, v in got.items()} == {k: v.keys() for k, v in want.items()}
    assert all(abs(got[k][w] - r) < 1e-9 for k, v in want.items() for w, r in v.items())


def test_terms_become_classes_of_the_corpus(spark):
    """Of the beginnings of a term the longest that enough other rows share."""
    rows = [f"kestrelton flies to k.t@mail.example.com {i}" for i in range(6)] + [f"kestrelton {i}" for i in range(1)]
    rows += [f"kestrels and birds {i}" for i in range(40)] + [f"words without birds {i}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = privacy.sanitise(docs, generalise=0.8, remove=0.99).collect()
    clean = next(r.clean_text for r in found if r.doc_id == 0)
    assert "<kestre*>" in clean and "kestrelton" not in clean
    assert all(r.clean_text == r.text for r in found if r.doc_id >= 6)


def test_secrets_are_protected(spark):
    text = 'config token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and tokens of old'
    docs = spark.createDataFrame([(1, text), (2, "a token of thanks = yes")], "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.sanitise(docs).collect()}
    assert [text[s.start : s.end] for s in got[1].pii] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"] and "<SECRET>" in got[1].clean_text
    assert got[2].pii == [] and privacy.base_spans(text) == []


def test_many_entities_in_one_text_take_linear_time():
    text = " ".join(f"word{i} a{i}@mail.example.com" for i in range(40_000))
    spans = privacy.protected_spans(text)
    words = privacy.Words(text, spans)
    assert len(spans) == 40_000 and words.near(spans[5][1], spans[5][2], 4) == {"word5", "word6"}
    assert len(privacy.term_spans(text, {"word7": (1.0, "")}, spans)) == 1
