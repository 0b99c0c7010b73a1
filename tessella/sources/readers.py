"""Readers and writers: JSON lines with schemas, documents of several formats, reports."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CANDIDATE = "struct<candidate_id: string, source_chunk_id: string, document_id: string, text: string, retrieval_score: double, rag_rank: int>"
EVAL_QUERY = f"query_id string, query string, rag_tag string, query_type string, query_type_tags array<string>, candidates array<{CANDIDATE}>, ground_truth array<struct<candidate_id: string, source_chunk_id: string, document_id: string, relevance: int, annotation_source: string, annotation_version: string, annotation_date: string, annotation_notes: string>>"
FROZEN = f"query_id string, query string, rag_tag string, experiment_id string, candidate_pipeline string, mmr_lambda double, candidate_k int, candidates array<{CANDIDATE}>"
RERANK_RESULT = "experiment_id string, dataset_version string, retrieval_version string, candidate_pipeline string, mmr_lambda double, candidate_k int, top_n int, reranker string, jev_model string, jev_prompt_version string, score_strategy string, query_id string, reranker_runtime_name string, ranking array<struct<new_rank: int, original_rank: int, candidate_id: string, score: double>>, scores_by_candidate_id map<string,double>"
# Endings and content types.
TYPES = (("pdf", "application/pdf"), ("doc", "application/msword"), ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("md", "text/markdown"), ("txt", "text/plain"), ("html", "text/html"), ("json", "application/json"))
# Content types by the first bytes of a file, in hexadecimal.
SIGNATURES = (
    ("application/pdf", "255044462D"), ("application/msword", "D0CF11E0A1B11AE1"), ("application/rtf", "7B5C727466"), ("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"),
    ("image/gif", "474946383761"), ("image/gif", "474946383961"), ("application/gzip", "1F8B"), ("application/x-7z-compressed", "377ABCAF271C"), ("application/postscript", "25215053"),
)
ZIP = "504B0304"
#: Beginnings of text formats, in lower case, after white space.
TEXT_SIGNATURES = (("text/html", ("<!doctype html", "<html", "<head", "<body")), ("application/xml", ("<?xml",)))
TEXT_ENDINGS = ("md", "txt", "html", "json")
#: So many bytes are looked at.
HEAD = 4_096
SUPPORTED = ("md", "txt", "html")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with ``file`` and ``line`` (from 1): file, line, value.

    Each task numbers its lines as it reads them; where a split begins in that order, and in its file, comes from one row per
    split. Lines are neither sorted nor shuffled.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    counts = raw.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "split", (before - F.col("first") + 1).alias("offset"))
    return raw.join(F.broadcast(starts), ["file", "split"]).select("file", (F.col("offset") + F.col("place")).alias("line"), "value")


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line with ``file`` and ``line``; blank lines are skipped, a line that is no such object fails the job and
    is named by its file and number."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("file", "line", F.inline(F.array(F.struct(read.alias("r")))))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    said = F.concat(F.lit("bad line "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    checked = rows.select("file", "line", F.when(bad, F.raise_error(said)).otherwise(F.col("r")).alias("r"))
    return checked.select("file", "line", "r.*").drop("_bad")


def last_lines(rows: DataFrame, by: str) -> DataFrame:
    """Of rows with the same ``by`` the last line, files in the order of their names; rows without it are left out."""
    rest = [c for c in rows.columns if c != by]
    last = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.max_by(F.struct(*rest), F.struct("file", "line")).alias("r"))
    return last.select(by, "r.*")


def rerank_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of rerankers in long form: query_id, reranker, new_rank, original_rank, candidate_id, score.

    Of a repeated query the last line counts; a missing name is ``unknown``, missing ranks and scores are 0.
    """
    one = last_lines(strict_jsonl(spark, path, RERANK_RESULT), "query_id")
    x = one.select("query_id", F.coalesce("reranker_runtime_name", F.lit("unknown")).alias("reranker"), F.explode("ranking").alias("r"))
    or0 = lambda c: F.coalesce(f"r.{c}", F.lit(0))
    return x.select("query_id", "reranker", or0("new_rank").alias("new_rank"), or0("original_rank").alias("original_rank"), "r.candidate_id", or0("score").cast("double").alias("score"))


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """``by`` keeps the strategies apart in folders of their own."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def frozen_candidates(sets: DataFrame) -> DataFrame:
    """Long form of frozen sets: queries without id or candidates are skipped, missing scores are 0 and ranks their place.

    Of repeated queries the last line counts, where the sets have a ``file`` and ``line`` (``strict_jsonl``); else the set that is the
    largest by its text.
    """
    latest = F.struct("file", "line") if {"file", "line"} <= set(sets.columns) else F.to_json("candidates")
    ok = sets.where(F.col("query_id").isNotNull() & (F.coalesce(F.size("candidates"), F.lit(0)) > 0))
    one = ok.groupBy("query_id").agg(F.max_by("candidates", latest).alias("candidates"))
    x = one.select("query_id", F.posexplode("candidates").alias("i", "c"))
    return x.select("query_id", F.coalesce("c.candidate_id", F.sha2(F.coalesce("c.text", F.lit("")), 256)).alias("candidate_id"), "c.text", F.coalesce("c.retrieval_score", F.lit(0.0)).alias("score"), F.coalesce("c.rag_rank", F.col("i") + 1).alias("rag_rank"))


def qrels_of(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("ground_truth").alias("g")).select("query_id", "g.candidate_id", F.col("g.relevance").alias("grade"))


def invalid_queries(queries: DataFrame) -> DataFrame:
    """Rows that break a rule, with its name: blank ids, grades outside 0 to 3, ranks under 1."""
    x = queries.select(
        "query_id",
        F.filter(
            F.array(
                F.when(F.col("query_id").isNull() | (F.trim("query_id") == ""), "query_id"),
                F.when(F.exists("ground_truth", lambda g: ~F.coalesce(g["relevance"].between(0, 3), F.lit(False))), "relevance"),
                F.when(F.exists("candidates", lambda c: F.coalesce(c["rag_rank"], F.lit(1)) < 1), "rag_rank"),
            ),
            lambda r: r.isNotNull(),
        ).alias("rules"),
    )
    return x.select("query_id", F.explode("rules").alias("rule"))


def sniffed_type(content: Column, name: Column) -> Column:
    """The content type by a file's first bytes, whatever its ending says; of several signatures the longest counts.

    Archives are documents if they hold a word processor's part, else what their ending says of them. Text that no
    signature matches is what its ending says if that is a text format, else plain text; other bytes are octet-stream. Null bytes have no
    type, empty ones are plain text.
    """
    ending = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    head = F.substring(content, 1, HEAD)
    size = F.octet_length(head)
    # the last character of the head may be cut
    valid = F.is_valid_utf8(head.cast("string"))
    for cut in (1, 2, 3):
        valid = valid | ((size == HEAD) & F.is_valid_utf8(F.substring(head, 1, HEAD - cut).cast("string")))
    is_text = valid & ~F.contains(head, F.unhex(F.lit("00")))
    bare = F.when(F.startswith(head, F.unhex(F.lit("EFBBBF"))), F.substring(head, 4, HEAD)).otherwise(head)
    begins = F.when(is_text, F.lower(F.regexp_replace(F.substring(bare, 1, 1_024).cast("string"), r"^\s+", "")))
    by_ending = F.lit("text/plain")
    for e, t in TYPES:
        if e in TEXT_ENDINGS:
            by_ending = F.when(ending == e, t).otherwise(by_ending)
    out = F.when(is_text, by_ending).otherwise("application/octet-stream")
    for t, beginnings in TEXT_SIGNATURES:
        for b in beginnings:
            out = F.when(F.coalesce(F.startswith(begins, F.lit(b)), F.lit(False)), t).otherwise(out)
    zipped = F.when(F.contains(head, F.lit("word/").cast("binary")) | (ending == "docx"), dict(TYPES)["docx"]).otherwise("application/zip")
    out = F.when(F.startswith(head, F.unhex(F.lit(ZIP))), zipped).otherwise(out)
    for t, mark in sorted(SIGNATURES, key=lambda x: len(x[1])):
        out = F.when(F.startswith(head, F.unhex(F.lit(mark))), t).otherwise(out)
    return F.when(content.isNotNull(), out)


def content_type(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("application/octet-stream")
    for e, t in TYPES:
        out = F.when(ending == e, t).otherwise(out)
    return out


class _Text(HTMLParser):
    """A page's text: block elements end lines, scripts and styles are left out."""

    BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 br table section article ul ol nav header footer title".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def extract_html(html: pd.Series) -> pd.Series:
    return html.map(html_text)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as documents: path, content type, text, size, hash, and an error for formats that aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    raw = F.when(ending.isin(*SUPPORTED), F.try_validate_utf8(F.col("content").cast("string")))
    text = F.when(ending == "html", extract_html(raw)).otherwise(raw)
    error = F.when(~ending.isin(*SUPPORTED), F.concat(F.lit("unsupported format: "), ending)).when(raw.isNull(), "not UTF-8")
    return files.select("path", content_type(F.col("path")).alias("content_type"), text.alias("text"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), error.alias("error"))


def table_rows(tables: DataFrame) -> DataFrame:
    """Extracted tables (table_id, rows: arrays of cells): white space collapsed, rows without any text dropped, numbered on."""
    clean = F.transform("rows", lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    kept = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    return tables.select("table_id", F.posexplode(kept).alias("row_no", "cells"))
