"""Splitters that need a running buffer, as small functions on one text, as Arrow UDFs to an array of chunks, as rows of chunks that
leave a task as they are made, and as table functions for SQL.

Every splitter goes forward and ends: the next chunk starts after the last one's start.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType

_CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_PARAGRAPH, _SENTENCE, _CLAUSE = (re.compile(p) for p in (r"(?<=\n\n)", r"(?<=[。！？.!?])", r"(?<=[，,；;])"))
_HEADER = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
_RULE = re.compile(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")


@dataclass(frozen=True)
class SplitConfig:
    """Sizes in characters for the semantic and Markdown splitters, in tokens for the others."""

    max_length: int = 500
    min_length: int = 50
    min_to_embed: int = 5
    overlap: int = 0
    chunk_tokens: int = 1000
    keep_tokens: int = 500
    split_tokens: int = 300
    overlap_tokens: int = 100


def count_tokens(text: str) -> int:
    """A CJK character is a token, any other word a quarter of its characters, rounded up."""
    n = len(_CJK.findall(text))
    return n + sum(-(-len(w) // 4) for w in _CJK.sub(" ", text).split())


def _parts(pattern: re.Pattern, text: str) -> list[str]:
    return [p.strip() for p in pattern.split(text) if p.strip()]


def merge_small(parts: list[str], most: int, least: int, joiner: str = "\n\n") -> list[str]:
    """Greedy: parts are joined while they fit; a last one under ``least`` goes to the one before."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(p) <= most:
            out[-1] += joiner + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least:
        out[-2:] = [out[-2] + joiner + out[-1]]
    return out


def with_overlap(chunks: list[str], overlap: int) -> list[str]:
    """Each chunk after the end of the original chunk before it."""
    return chunks if overlap <= 0 else [c if i == 0 else chunks[i - 1][-overlap:] + c for i, c in enumerate(chunks)]


def semantic_chunks(text: str, c: SplitConfig = SplitConfig()) -> list[str]:
    clean = re.sub(r"\n[ \t]+\n", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    parts = [x for p in _parts(_PARAGRAPH, clean) for x in ([p] if len(p) <= c.max_length else [y for s in _parts(_SENTENCE, p) for y in ([s] if len(s) <= c.max_length else _parts(_CLAUSE, s))])]
    return with_overlap([x for x in merge_small(parts, c.max_length, c.min_length) if len(x) >= c.min_to_embed], c.overlap)


def markdown_chunks(text: str, c: SplitConfig = SplitConfig()) -> list[str]:
    """``header > path`` on the first line, then the body under it; bodies over the limit are split at paragraphs and sentences."""
    out, path, at, heads = [], [], 0, list(_HEADER.finditer(text))
    sections = [("", text[: heads[0].start()] if heads else text)]
    for i, h in enumerate(heads):
        level = len(h.group(1))
        path = [(n, t) for n, t in path if n < level] + [(level, h.group(2).strip())]
        end = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        sections.append((" > ".join(t for _, t in path), text[h.end() : end]))
    for name, body in sections:
        for x in semantic_chunks(body, c):
            out.append(f"{name}\n{x}" if name else x)
        at += 1
    return out


_TOKEN = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\s㐀-䶿一-鿿豈-﫿]+")


def end_of(text: str, start: int, most: int) -> int:
    """The last place up to which ``text`` from ``start`` on has at most ``most`` tokens: one scan over what is taken."""
    for m in _TOKEN.finditer(text, start):
        need = 1 if _CJK.match(m.group()) else -(-(m.end() - m.start()) // 4)
        if need > most:
            return m.start() + 4 * most if need > 1 else m.start()
        most -= need
    return len(text)


def each_fixed(text: str, most: int, overlap: int = 0) -> Iterator[str]:
    """The longest pieces of at most ``most`` tokens, each starting ``2 * overlap`` characters before the last one's end."""
    start = 0
    while start < len(text):
        end = max(start + 1, end_of(text, start, most))
        if text[start:end].strip():
            yield text[start:end]
        if end >= len(text):
            break
        start = max(start + 1, end - 2 * overlap)


def fixed_chunks(text: str, most: int, overlap: int = 0) -> list[str]:
    return list(each_fixed(text, most, overlap))


def pack(parts: list[str], most: int, overlap: int = 0, joiner: str = "") -> list[str]:
    """Greedy packing of parts up to ``most`` tokens; the last parts within ``overlap`` tokens open the next chunk."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for p in parts:
        n = count_tokens(p)
        if held and size + n > most:
            out.append(joiner.join(held))
            tail, kept = [], 0
            for x in reversed(held):
                k = count_tokens(x)
                if kept + k > overlap or kept + k + n > most:
                    break
                tail.insert(0, x)
                kept += k
            held, size = tail, kept
        held.append(p)
        size += n
    if held:
        out.append(joiner.join(held))
    return out


_SENTENCE_END = re.compile(r"[.?!。！？\n]")
_BLANK = re.compile(r"\s*")


def each_token_chunk(text: str, c: SplitConfig = SplitConfig()) -> Iterator[str]:
    """Whole words up to ``chunk_tokens``; a chunk ends at the last sentence's end after ``min_length`` characters if it has one."""
    text = text.strip()
    start = 0
    while start < len(text):
        end = max(start + 1, end_of(text, start, c.chunk_tokens))
        if end < len(text):
            ends = [m.end() for m in _SENTENCE_END.finditer(text, start, end) if m.end() - start > c.min_length]
            blank = text.rfind(" ", start + 1, end)
            end = ends[-1] if ends else blank if blank > start else end
        piece = text[start:end].strip()
        if len(piece) >= c.min_to_embed:
            yield piece
        start = _BLANK.match(text, end).end()


def token_chunks(text: str, c: SplitConfig = SplitConfig()) -> list[str]:
    return list(each_token_chunk(text, c))


def _after(text: str, marks: str) -> Iterator[str]:
    """The pieces of a text that end after one of the marks, one at a time."""
    start = 0
    for m in re.finditer(f"[{marks}]", text):
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


def each_etl_chunk(text: str, c: SplitConfig = SplitConfig()) -> Iterator[str]:
    """Pieces after line ends and full stops are gathered to blocks of five times ``chunk_tokens`` characters, then cut by tokens."""
    block, size = [], 0
    for piece in (p.strip() for p in _after(text, "\n。")):
        if piece:
            block.append(piece)
            size += len(piece) + 2
            if size >= 5 * c.chunk_tokens:
                yield from each_token_chunk("\n\n".join(block), c)
                block, size = [], 0
    if block:
        yield from each_token_chunk("\n\n".join(block), c)


def etl_chunks(text: str, c: SplitConfig = SplitConfig()) -> list[str]:
    return list(each_etl_chunk(text, c))


def is_row(line: str) -> bool:
    t = line.strip()
    return bool(t) and (t.startswith("|") or t.endswith("|")) and t.strip("|") != ""


def table_chunks(table: str, c: SplitConfig = SplitConfig()) -> list[str]:
    """A table's rows in chunks, each under the header and rule again."""
    lines = [x for x in table.split("\n") if x.strip()]
    head = lines[:2] if len(lines) > 1 and _RULE.match(lines[1]) else lines[:1]
    room = max(1, c.split_tokens - sum(map(count_tokens, head)))
    return ["\n".join([*head, x]) for x in pack(lines[len(head) :], room, min(c.overlap_tokens, room // 2), "\n")] or ["\n".join(head)]


def paragraph_chunks(text: str, c: SplitConfig = SplitConfig()) -> list[str]:
    """Lines filtered, tables kept together, short blocks kept, others by sentences, long sentences at a fixed size."""
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if not x.strip().isdigit() and "�" not in x]
    out, block, in_table = [], [], False

    def close() -> None:
        body = "\n".join(block).strip()
        block.clear()
        if not body:
            return
        rows = body.split("\n")
        if in_table and len(rows) > 1 and any(map(_RULE.match, rows)):
            out.extend([body] if count_tokens(body) <= c.keep_tokens else table_chunks(body, c))
        elif count_tokens(body) <= c.keep_tokens:
            out.append(body)
        else:
            parts = [y for s in _parts(re.compile(r"(?<=[。！？.?!])\s*"), body) for y in ([s] if count_tokens(s) <= c.split_tokens else fixed_chunks(s, c.split_tokens, c.overlap_tokens // 4))]
            out.extend(pack(parts, c.split_tokens, c.overlap_tokens, " "))

    for x in lines:
        if not x.strip() or is_row(x) != in_table:
            close()
            in_table = is_row(x)
        if x.strip():
            block.append(x)
    close()
    return out


def splitter(f: Callable[..., list[str]], *args) -> Callable[[Column], Column]:
    """The splitter as an Arrow UDF from a text to an array of chunks; null gives no chunks."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(t, *args) if isinstance(t, str) else [])

    return run


#: Chunks are handed on when they hold so many characters, or so many of them are there.
HAND_ON, HAND_ON_ROWS = 1 << 20, 4_096


def chunk_rows(texts: DataFrame, key: str, text: str, each: Callable[..., Iterable[str]], *args) -> DataFrame:
    """A row per chunk: ``key``, ``chunk_no`` (from 0) and ``chunk``, in the order of the text.

    Chunks leave the task as they are made: a text of any length takes its own size and one batch of chunks. A null text has
    none; rows with equal keys have chunks each.
    """
    kind = texts.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType
    schema = StructType([StructField("key", kind), StructField("chunk_no", LongType()), StructField("chunk", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            at: list[int] = []
            numbers: list[int] = []
            chunks: list[str] = []
            size = 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64()), pa.array(chunks, pa.string())], names=schema.names)  # noqa: B023

            for i, t in enumerate(batch.column(1)):
                for n, chunk in enumerate(each(t.as_py(), *args) if t.is_valid else ()):
                    at.append(i)
                    numbers.append(n)
                    chunks.append(chunk)
                    size += len(chunk)
                    if size >= HAND_ON or len(at) >= HAND_ON_ROWS:
                        yield out()
                        at, numbers, chunks, size = [], [], [], 0
            if at:
                yield out()

    return texts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def _table_function(each: Callable[..., Iterable[str]]):
    """A table function of a text and some whole numbers; null gives no rows."""

    class Chunks:
        def eval(self, text: str, *numbers: int):
            if text is not None:
                for n, chunk in enumerate(each(text, *numbers)):
                    yield n, chunk

    return udtf(Chunks, returnType="chunk_no int, chunk string")


def register(spark: SparkSession) -> None:
    """The splitters for SQL: ``SELECT t.id, c.* FROM t, LATERAL fixed_chunks(t.text, 256, 0) c``, and likewise token_chunks(text, tokens),
    etl_chunks(text, tokens) and semantic_chunks(text, longest, shortest, overlap)."""
    spark.udtf.register("fixed_chunks", _table_function(each_fixed))
    spark.udtf.register("token_chunks", _table_function(lambda t, n: each_token_chunk(t, SplitConfig(chunk_tokens=n))))
    spark.udtf.register("etl_chunks", _table_function(lambda t, n: each_etl_chunk(t, SplitConfig(chunk_tokens=n))))
    spark.udtf.register("semantic_chunks", _table_function(lambda t, most, least, over: semantic_chunks(t, SplitConfig(max_length=most, min_length=least, overlap=over))))
