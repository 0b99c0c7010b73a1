"""The audit against its SQL, and against a plain version where blocks, chunks and sections are small."""

from collections import Counter

import numpy as np
import pytest

from tessella.llm import divergence
from verify_sql import compare


def plain_audit(rows, min_docs=3, top=200):
    """rows: (text, lang, source)."""
    import re

    lowered = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        held = Counter(w for d in mine for w in set(d[0]))
        kept = {w for w, n in held.items() if n >= min_docs}
        groups = {s: Counter(w for d in mine if d[2] == s for w in d[0] if w in kept) for s in {d[2] for d in mine}}
        whole = sum(groups.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        far = lambda c, q, w: (share(c, w) - share(q, w)) ** 2 // share(q, w)
        for s, c in groups.items():
            pair = [(o, sum(far(c, q, w) for w in kept)) for o, q in groups.items() if o != s]
            term = [(w, far(c, whole, w)) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, i + 1) for i, x in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def audited(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, `a.b` int")
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


def test_sql(spark, sf_dir):
    assert compare(spark, "op11", divergence.query, divergence.ORACLE_SQL, sf_dir) == ""


@pytest.mark.parametrize("block,chunk,section", [(2, 3, 2), (1, 1, 1), (64, 4096, 64), (3, 5, 1)])
def test_tiles_and_sections(spark, monkeypatch, block, chunk, section):
    monkeypatch.setattr(divergence, "SECTION", section)
    monkeypatch.setattr(divergence, "HELD", 20)
    rng = np.random.default_rng(7)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["É", "é", "Éa", "日本"]
    rows = [(" ".join(rng.choice(words[: rng.integers(5, 64)], rng.integers(0, 30))), "ab"[int(rng.integers(2))], f"s{int(rng.integers(9))}") for _ in range(80)]
    assert audited(spark, rows, block=block, chunk=chunk) == plain_audit(rows)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "empty"), ("A a B", "en", "x"), ("a", "en", "x"), ("a b", "en", None), ("b's", "en", "y"), ("b\x00b", "en", "y"), ("a " * 100_000, "en", "y")]
    rows += [("never", "fr", "x"), ("three", "fr", "y"), ("c", "de", "x"), ("c", "de", "x"), ("c", "de", "x"), ("c", "de", "z")]
    assert audited(spark, rows) == plain_audit(rows)
    assert audited(spark, rows[:1]) == []
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_ties_and_top(spark):
    rows = [(f"same {w}", "en", s) for s in "pq" for w in ("ä", "z", "b") for _ in range(3)] + [("rare", "en", "r")] * 3
    assert audited(spark, rows, top=2) == plain_audit(rows, top=2)


def test_large_counts():
    counts, totals = np.array([0, 5, 10**14]), np.array([10**15, 10**15 + 7, 3 * 10**15])
    assert divergence.scaled(counts, totals).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts.tolist(), totals.tolist())]
