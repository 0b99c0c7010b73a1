from tessella.llm import language

ROWS = [(i, t, l) for i in range(120) for l, t in (("en", f"the quick brown fox and the lazy dog of number {i}"), ("fr", f"le renard brun et le chien paresseux de la maison {i}"))]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, l, "x") for i, (_, t, l) in enumerate(ROWS)], "doc_id long, text string, lang string, score string")
    model = language.fit(docs)
    assert set(model.languages) == {"en", "fr"}
    odd = spark.createDataFrame([(1, None), (None, "12 34 !!"), (3, ""), (4, "the quick brown fox and a dog"), (4, "the quick brown fox and a dog"), (5, "LE CHIEN DE LA MAISON " * 20_000), (6, "½ ² Ⅷ ٣")], "doc_id long, text string")
    got = [tuple(r) for r in language.identify(odd, model).select("text", "lang_pred", "rejected").collect()]
    assert [(g[1], g[2]) for g in got] == [("und", True)] * 3 + [("en", False)] * 2 + [("fr", False), ("und", True)]
    kept = docs.withColumnRenamed("lang", "Rejected")
    again = language.identify(kept, model)
    assert again.columns == ["doc_id", "text", "Rejected", "score", "lang_pred", "_score", "_rejected"] == kept.columns + language.added(kept)
    assert {(r.score, r.Rejected) for r in again.collect()} == {("x", "en"), ("x", "fr")}
    assert language.identify(odd.limit(0), model).count() == 0
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def test_copies_do_not_fill_the_sample(spark):
    # letters only, so that texts stay different after normalize(); 600 texts, and one text as often as half of them
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i * 7919 % 100_000:05d}")
    texts = [" ".join(word(150 * i + k) for k in range(150)) for i in range(600)]
    first = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(3, text) AS h").orderBy("h").first().text
    rows = [(t, "en") for t in texts] + [(first, "en")] * 500
    docs = spark.createDataFrame([(i * 5 + 1, t, l) for i, (t, l) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.dictionaries[0].count(language.normalize(first[: language.SAMPLE_CHARS])) == 1
    used = docs.distinct().where(~language.is_held_out(docs.doc_id)).select("text").distinct().count()
    assert len(model.dictionaries[0]) > 0.8 * min(used, language.SAMPLE_DOCS) * 800


def plain_prediction(model, text):
    """Every block of the whole text against every dictionary, with a compressor of its own."""
    import unicodedata

    import zstandard

    kept = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    raw = " ".join(kept.split()).encode()
    if not raw:
        return "und", 0.0
    sizes = []
    for content in model.dictionaries:
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(language.LEVEL, source_size=language.BLOCK_BYTES, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        shared.precompute_compress(compression_params=p)
        sizes.append(sum(len(zstandard.ZstdCompressor(compression_params=p, dict_data=shared).compress(raw[i : i + language.BLOCK_BYTES])) for i in range(0, len(raw), language.BLOCK_BYTES)))
    first, second = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))[:2]
    return model.languages[first], (sizes[second] - sizes[first]) / sizes[second]


def test_equals_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language.identify(docs.select("doc_id", "text"), model).collect():
        assert (r.lang_pred, r.score) == plain_prediction(model, texts[r.doc_id])


def test_ties_go_to_the_language_with_most_documents(spark):
    rows = [(i, "lorem ipsum dolor", "aa" if i % 3 else "bb") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("aa", "bb") and language.predict(model, "dolor ipsum") == ("aa", 0.0)
