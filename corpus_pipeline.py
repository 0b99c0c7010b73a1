"""From raw documents to token ids: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, language, mixing, near_duplicates, privacy
from tessella.llm.common import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with their own columns; the others go.

    Null and empty texts and those without letters go. Copies share their fate, texts of any length are read whole, and an
    empty table gives an empty one. Columns of any name stay as they are.
    """
    rejected = language.added(docs)[2]
    found = language.identify(docs, language.fit(docs))
    return found.where(~F.col(rejected)).select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id (nulls last), one of it if it repeats.

    Null texts are no copies of each other, empty ones are. Columns of any name stay as they are.
    """
    return near_duplicates.deduplicate(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with entities and disclosing terms masked; ``n_chars`` follows where the text changed.

    Null and empty texts stay as they are, equal texts stay equal, and columns of any other name are not touched.
    """
    clean, pii = privacy.added(docs)
    found = privacy.sanitise(docs)
    columns = {"text": F.col(clean), "n_chars": F.when(F.size(pii) > 0, F.char_length(clean).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, 0 to 3 times.

    A null source is a source of its own; documents without words are taken by the same draw. Columns of any name stay.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, number of token ids, and digests of the ids and of the bytes decoded from them.

    A null text has no ids. Copies that the mixture repeats are encoded as often.
    """
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("remove_personal_data", remove_personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL can express neither the compression classifier nor the sketches; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
