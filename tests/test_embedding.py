"""Hashed runs of words against a plain version, search by another provider, and chunks as rows."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tessella.functions import splitters as sp
from tessella.operators import embedding

TEXTS = [(1, "The cat sat on the mat"), (2, "the cat sat on a mat"), (3, "Étude des oiseaux"), (4, None), (5, " .,! "), (6, "cat"), (6, "dog cat"), (None, "the the the"), (8, "der Hund und die Katze " * 300)]


def plain_grams(text, longest):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_vectors(dims, longest):
    held = Counter(g for _, t in TEXTS for g in set(plain_grams(t, longest)))
    weight = {g: 100 + int(math.floor(100 * math.log((len(TEXTS) + 1) / (n + 1)) + 0.5)) for g, n in held.items()}
    out = {}
    for key, text in TEXTS:
        v = out.setdefault(key, [0.0] * dims)
        for g in plain_grams(text, longest):
            code = hashlib.md5(g.encode()).hexdigest()
            v[int(code[:6], 16) % dims] += weight[g] if code[6] < "8" else -weight[g]
    return out


def test_vectors(spark):
    df = spark.createDataFrame(TEXTS, "`my.id` long, text string")
    for dims, longest in ((16, 2), (7, 3), (1, 1)):
        got = {r["my.id"]: r.vector for r in embedding.HashedGrams.fitted(df, "text", dims, longest).embed(df, "my.id", "text").collect()}
        assert got == plain_vectors(dims, longest)
    assert embedding.HashedGrams(8).embed(df.where("false"), "my.id", "text").count() == 0


class Lengths:
    """Another provider: a text's length and its number of spaces."""

    dims = 2

    def embed(self, texts, key, text):
        return texts.select(key, F.array(F.char_length(text).cast("double"), F.regexp_count(text, F.lit(" ")).cast("double")).alias("vector"))


def test_search_takes_any_provider(spark):
    corpus = spark.createDataFrame([(1, "aaaa", "x"), (2, "a a a a", "x"), (3, "bbbbbb", "y"), (4, "a b c d", "y")], "id long, text string, tag string")
    queries = spark.createDataFrame([(10, "c c c c", "x"), (11, "zzz", "y")], "query_id long, text string, tag string")
    got = [(r.query_id, r.id) for r in embedding.search(queries, corpus, Lengths(), 1, ["tag"]).orderBy("query_id").collect()]
    assert got == [(10, 2), (11, 3)]
    # the last is found although half of its words differ
    fitted = embedding.HashedGrams.fitted(corpus.union(spark.createDataFrame([(5, "one two three four", "y")], corpus.schema)), "text", 256)
    asked = spark.createDataFrame([(20, "ONE two, three!")], "query_id long, text string")
    everything = corpus.union(spark.createDataFrame([(5, "one two three four", "y")], corpus.schema))
    assert embedding.search(asked, everything, fitted, 1).first().id == 5


def test_chunks_leave_the_task_as_they_are_made(spark):
    rows = [(1, "word " * 2_000), (2, None), (3, ""), (3, "a b"), (None, "x" * 50)]
    df = spark.createDataFrame(rows, "`my.id` long, text string")
    got = [tuple(r) for r in sp.chunk_rows(df, "my.id", "text", sp.each_fixed, 16).collect()]
    assert got == [(k, n, c) for k, t in rows for n, c in enumerate(sp.fixed_chunks(t, 16) if t else [])]
    long = "Some words of a sentence. " * 2_000_000  # 52 MB
    made = sp.each_token_chunk(long, sp.SplitConfig(chunk_tokens=100))
    import tracemalloc

    first = next(made)
    tracemalloc.start()
    assert sum(1 for _, c in zip(range(2_000), made) if c.startswith("Some")) == 2_000 and len(first) < 500
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


def test_table_functions_in_sql(spark):
    sp.register(spark)
    text = "One sentence here. Another one follows it.\n\nA second paragraph, which is longer than the first one was. " * 20
    spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string").createOrReplaceTempView("chunk_texts")
    for call, want in (("fixed_chunks(t.text, 20, 3)", sp.fixed_chunks(text, 20, 3)), ("token_chunks(t.text, 30)", sp.token_chunks(text, sp.SplitConfig(chunk_tokens=30))), ("etl_chunks(t.text, 30)", sp.etl_chunks(text, sp.SplitConfig(chunk_tokens=30))), ("semantic_chunks(t.text, 120, 30, 10)", sp.semantic_chunks(text, sp.SplitConfig(max_length=120, min_length=30, overlap=10)))):
        got = spark.sql(f"SELECT t.id, c.* FROM chunk_texts t, LATERAL {call} c").collect()
        assert [(r.id, r.chunk_no, r.chunk) for r in sorted(got, key=lambda r: r.chunk_no)] == [(1, n, c) for n, c in enumerate(want)], call
    # each chunk opens with the end of the one before
    plain = sp.semantic_chunks(text, sp.SplitConfig(max_length=120, min_length=30))
    over = sp.semantic_chunks(text, sp.SplitConfig(max_length=120, min_length=30, overlap=10))
    assert over[0] == plain[0] and all(b == a[-10:] + c for a, b, c in zip(plain, over[1:], plain[1:]))
