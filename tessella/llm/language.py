"""Language identification by compression.

Each language has a raw-content Zstandard dictionary from labelled documents. The whole text, lower-cased letters and single
spaces, is compressed with each of them; the language with the smallest result wins, and a narrow margin rejects the document.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import fresh, passage

#: The dictionaries are built from so many different labelled texts of each language, the least by a hash, and a
#: passage of each, so many characters from a place that a hash gives. This bounds the model; predictions read whole texts.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 1_000
#: A text is compressed in blocks, so that the dictionary and not the text's own beginning predicts all of it.
BLOCK_BYTES = 4_096
LEVEL = 6
#: A document is rejected if the best language saves less than this share against the second.
MIN_MARGIN = 0.002
UNKNOWN = "und"

_words = re.compile(r"[^\W\d_]+").findall


def normalize(text: str) -> bytes:
    """The text's letters in lower case, with one space for whatever else stands between two of them."""
    words = _words(text.lower())
    if not "".join(words).isalpha():  # numerals that are no digits count as word characters, but are no letters
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return " ".join(words).encode("utf-8", "replace")


@dataclass(frozen=True)
class Model:
    """Languages, those with most labelled documents first, which wins ties, and their dictionaries."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def is_held_out(doc_id) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learns from rows that are not held out and have both a text and a language."""
    labelled = docs.where(~is_held_out(F.col(doc_id)) & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(3), F.col(text)).alias("h"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # copies are one text, by language and hash with partial sums; of a common language only a hash range of different
    # texts goes on, which holds about three times SAMPLE_DOCS of them
    distinct = {r["lang"]: r["n"] for r in labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names, shares = list(distinct), [min(1.0, 3 * SAMPLE_DOCS / n) for n in distinct.values()]
    last = F.element_at(F.array(*[F.lit(min(2**63 - 1, -(2**63) + int(2**64 * s))) for s in shares]), F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int")) if counts else F.lit(0)
    few = labelled.where(F.col("h") <= last).groupBy("lang", "h").agg(F.min(passage("text", SAMPLE_CHARS, 5)).alias("text"))
    least = few.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("i") <= SAMPLE_DOCS)
    parts: dict[str, list[bytes]] = {}
    for r in least.orderBy("lang", "i").toLocalIterator():
        share = normalize(r["text"])
        if share:
            parts.setdefault(r["lang"], []).append(share)
    names = sorted(parts, key=lambda x: (-counts[x], x))
    return Model(tuple(names), tuple(b" ".join(parts[x]) for x in names))


@functools.lru_cache(maxsize=4)
def _compressors(model: Model):
    out = []
    for raw in model.dictionaries:
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK_BYTES, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        out.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress)
    return out


def predict(model: Model, text: str | None) -> tuple[str, float]:
    """Language and margin: the share of the second smallest size that the smallest saves."""
    raw = normalize(text or "")
    if not raw or not model.languages:
        return UNKNOWN, 0.0
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    sizes = [sum(len(f(b)) for b in blocks) for f in _compressors(model)]
    if len(sizes) == 1:
        return model.languages[0], 1.0
    order = np.argsort(sizes, kind="stable")
    best, second = sizes[order[0]], sizes[order[1]]
    return model.languages[order[0]], (second - best) / second


def added(docs: DataFrame) -> list[str]:
    """The names of the columns that ``identify`` adds."""
    return fresh(docs, "lang_pred", "score", "rejected")


def identify(docs: DataFrame, model: Model, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected``.

    A text that is null or has no letter is ``und`` with score 0 and rejected, as is every text if nothing was
    learned. Ties go to the language with most labelled documents. Rows are independent of each other: copies agree,
    and an empty table gives an empty one. Texts of any length are read whole. Columns of ``docs`` stay; a new column whose
    name is taken gets an underscore before it (``added``).
    """
    new = added(docs)
    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(new, (StringType(), DoubleType(), BooleanType()), strict=True)]])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_DOCS * SAMPLE_CHARS for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                got = [predict(shared.value, t.as_py()) for t in batch.column(text)]
                cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == UNKNOWN or g[1] < min_margin for g in got])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
