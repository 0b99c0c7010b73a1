import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tessella.llm import token_files as tf  # noqa: E402
from tessella.llm.common import scratch_path  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "Hello  World\nit's we'll 123 <|endoftext|>", "a\x1cb\u0085c d　e", "ÀÉ" * 100, "中文" * 50, "x" * 3000, " ́x İ Σας", "😀" * 9, "It's WE'LL don't, (foo)bar_baz--x9y10 ÄÖÜ ß ÿ × ÷ a×b ª º µm e\u0301 n\u0303o ﬁn Ǆ K", "".join(map(chr, range(0x21, 0x180))), "long " * 40_000 + "end"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_words_equal_whole_texts(library):
    for text, ids in zip(ODD, tf.encode_texts(ODD, PATH), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


def test_serialized_ids_come_back():
    for ids in ([], [0], [1, 65535, 2], [70000, 3]):
        assert tf.deserialize(tf.serialize(np.array(ids, dtype="<u4"))).tolist() == ids


def test_files(spark, library):
    rows = [(7, "b c"), (None, "n"), (3, None), (5, ""), (7, "a"), (None, None), (3, None), *((100 + i, f"word{i} the and of {i % 7}") for i in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = tf.write_token_files(docs, scratch_path(spark, "t"), PATH)
    got = tf.read_token_files(manifest).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    at, want = 0, sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    ids = np.array([*library.encode("word5 the and of 5", add_special_tokens=False).ids, 2], dtype="<u4")
    assert next(r.ids_crc32 for r in got if r.doc_id == 105) == zlib.crc32(ids.tobytes())
    f = tf.TokenFile(manifest.first().path)
    assert f.document(f.n - 1)[-1] == 2
    assert tf.read_token_files(tf.write_token_files(docs.limit(0), scratch_path(spark, "t"), PATH)).collect() == []


def test_special_tokens_as_in_a_plain_call(spark):
    plain = tokenizers.Tokenizer.from_file(PATH)
    texts = [*ODD, "<|endoftext|>", "a<|endoftext|>b <|startoftext|>c", "x <|endoftext|> y", "<|endoftext|><|endoftext|>\n\n<|startoftext|> it's", "<|ENDOFTEXT|> <|endoftext", "İ<|endoftext|>'s"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tf.encode_texts(texts, PATH)] == want and 49407 in want[-2] + want[-5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tf.read_token_files(tf.write_token_files(docs, scratch_path(spark, "t"), PATH)).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {i: zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes()) for i, ids in enumerate(want)}


def test_another_tokenizer_is_asked_for_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tf.splits_here(PATH) and not tf.splits_here(path)
    library = tokenizers.Tokenizer.from_file(path)
    assert [x.tolist() for x in tf.encode_texts(ODD, path)] == [library.encode(t, add_special_tokens=False).ids for t in ODD]
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = tf.read_token_files(tf.write_token_files(docs, scratch_path(spark, "t"), path, end_id=50256)).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 50256], dtype="<u4").tobytes()) for i, t in enumerate(ODD)}
