import base64
import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tessella.llm import bpe  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a\x1cb  \x1d c", "x　y z  q\u0085r", "ÀÉ" * 400, "中文字符测试" * 100, "a" * 5000, " " * 3000 + "x", "\n\n  \t x", "😀😃" * 60, "it's we'll I'D", "0123456789" * 30, "<|endoftext|> hi", "́̀"]


def test_equals_the_library(library):
    rng = random.Random(1)
    noise = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x2000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(5000))
    texts = [*ODD, noise, *("".join(rng.choices("abc xyz,.'", k=rng.randrange(1, 90))) for _ in range(300))]
    ranks = bpe.load_ranks(PATH)
    for text, ids in zip(texts, bpe.encode_texts(texts, PATH, PATTERN), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert ranks.decode(ids.astype(np.int64)) == text.encode()


def test_one_tree_or_many(library):
    ranks = bpe.load_ranks(PATH)
    rng = random.Random(2)
    for _ in range(200):
        piece = bytes(rng.choices(b"thenaio ", k=rng.randrange(2, 64)))
        width = max(2, 1 << (len(piece) - 1).bit_length())
        assert ranks.encode_short([piece], width)[0] == ranks.encode_long(piece)


def test_query_form(spark, library):
    rows = [(1, t, "x") for t in ODD] + [(None, None, "y"), (1, "same", "z"), (1, "same", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, PATH, PATTERN)
    assert encoded.columns == ["doc_id", "ids"]
    got = sorted(map(tuple, bpe.digest(encoded, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sorted(map(tuple, bpe.round_trip(docs, PATH, PATTERN).collect()), key=str) == got
    clash = docs.withColumnRenamed("doc_id", "t")
    assert sorted(map(tuple, bpe.round_trip(clash, PATH, PATTERN, "t").collect()), key=str) == got
    back = bpe.decode(encoded, PATH).select("decoded").collect()
    assert sorted(bytes(r[0]) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode(docs.limit(0), PATH, PATTERN).collect() == []
