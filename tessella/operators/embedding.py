"""Texts to vectors by a provider, and search from texts.

A provider is anything with ``dims`` and ``embed``. The one here needs no model: runs of one and two words are hashed to a place and
a sign, and weighted by how few texts of a corpus hold them, so vectors are the same on every machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .retrieval import knn

#: What is between words.
NO_WORD = r"[^\p{L}\p{N}]+"
#: Bytes of the texts, and of the vectors, that a task holds.
BLOCK_BYTES = 16 << 20
#: Runs that are hashed at once.
HASHED = 100_000


class Embedder(Protocol):
    """``embed`` gives each row of ``texts`` its vector: the column ``key`` and ``vector`` (array of ``dims`` doubles)."""

    dims: int

    def embed(self, texts: DataFrame, key: str, text: str) -> DataFrame: ...


def _weight(texts: int, df: Column) -> Column:
    return (F.lit(100) + F.round(100 * F.log(F.lit(float(texts + 1)) / (df + 1)))).cast("long")


def _in_blocks(texts: DataFrame, key: str, text: str, dims: int) -> tuple[DataFrame, int]:
    """``block``, ``key`` and ``words`` (lower case, a blank between) of each text, and how many texts there are. A block is a task's work."""
    rows = texts.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size // BLOCK_BYTES), -(-n * 8 * dims // BLOCK_BYTES), min(2 * texts.sparkSession.sparkContext.defaultParallelism, size >> 20))
    block = F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int")
    return rows.select(block.alias("block"), "key", F.regexp_replace(F.lower("text"), NO_WORD, " ").alias("words")), n


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _levels(words: pa.ChunkedArray, longest: int) -> list[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For runs of 1, 2 ... ``longest`` words the different ones, in an order that the words alone give, and of each occurrence its
    text's place and its run's."""
    numbers, pieces = _Numbers(), []
    for chunk in words.chunks:
        for text in chunk:
            w = text.as_py().split()
            pieces.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
    known = sorted(numbers)
    rank = np.empty(len(known), np.int64)
    rank[np.fromiter(map(numbers.__getitem__, known), np.int64, len(known))] = np.arange(len(known))
    word = rank[np.concatenate(pieces)] if pieces else np.empty(0, np.int64)
    of = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(x) for x in pieces])
    names = pa.array(known, pa.large_string())
    out, at, run, said = [(names, of, word)], np.arange(len(word)), word, names
    several, blank = max(1, len(known)), pa.scalar(" ", pa.large_string())
    for n in range(2, longest + 1):
        same = (at + n - 1 < len(word)) & (of[np.minimum(at + n - 1, len(word) - 1)] == of[at])
        at, run = at[same], run[same]
        different, run = np.unique(run * several + word[at + n - 1], return_inverse=True)
        said = pc.binary_join_element_wise(said.take(pa.array(different // several)), names.take(pa.array(different % several)), blank)
        out.append((said, of[at], run))
    return out


def _held(blocks: DataFrame, longest: int) -> DataFrame:
    """Each block's different runs: ``gram``, ``block``, ``place`` (the run's number in the block) and ``df``, how many of its texts hold it."""

    def run(table: pa.Table) -> pa.Table:
        grams, df = [], []
        for said, of, gram in _levels(table.column("words"), longest):
            grams.append(said.cast(pa.string()))
            pairs = np.unique(of.astype(np.int64) * max(1, len(said)) + gram)
            df.append(np.bincount(pairs % max(1, len(said)), minlength=len(said)).astype(np.int64))
        n = sum(map(len, df))
        block = pa.array(np.full(n, table.column("block")[0].as_py(), np.int32))
        return pa.table([pa.chunked_array(grams, pa.string()), block, pa.array(np.arange(n, dtype=np.int32)), pa.array(np.concatenate(df))], names=["gram", "block", "place", "df"])

    return blocks.groupBy("block").applyInArrow(run, "gram string, block int, place int, df long")


def _embedded(blocks: DataFrame, weights: DataFrame, other: int, dims: int, longest: int, key: str) -> DataFrame:
    """The vectors of each key's texts; ``weights``: block, place and weight of runs, those without have the weight ``other``."""

    def run(table: pa.Table, weighed: pa.Table) -> pa.Table:
        levels = _levels(table.column("words"), longest)
        weight = np.full(sum(len(said) for said, _, _ in levels), other, np.int64)
        weight[weighed.column("place").to_numpy()] = weighed.column("weight").to_numpy()
        x, before = np.zeros(len(table) * dims), 0
        for said, of, gram in levels:
            raw, signed = said.cast(pa.large_binary()), weight[before : before + len(said)]
            before += len(said)
            digests = [b"".join([hashlib.md5(g).digest() for g in raw[i : i + HASHED].to_pylist()]) for i in range(0, len(raw), HASHED)]
            code = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)[:, :4].astype(np.int64)
            at, signed = (code[:, 0] << 16 | code[:, 1] << 8 | code[:, 2]) % dims, np.where(code[:, 3] < 0x80, signed, -signed)
            # whole numbers, so that sums do not depend on their order
            x += np.bincount(of.astype(np.int64) * dims + at[gram], weights=signed[gram], minlength=len(x))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dims, dtype=np.int32)), pa.array(x))
        return pa.table([table.column("key"), lists], names=["key", "vector"])

    kind = StructType([StructField("key", blocks.schema["key"].dataType), StructField("vector", ArrayType(DoubleType()))])
    parts = blocks.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(run, kind)
    # rows with equal keys may be in several blocks
    all_ = parts.groupBy("key").agg(F.collect_list("vector").alias("v"))
    total = F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), F.col("v")[0], lambda s, y: F.zip_with(s, y, lambda p, q: p + q))
    return all_.select(F.col("key").alias(key), F.when(F.size("v") == 1, F.col("v")[0]).otherwise(total).alias("vector"))


def document_frequencies(corpus: DataFrame, text: str, longest: int = 2) -> DataFrame:
    """``gram`` and ``weight``: 100 + 100 ln((n + 1) / (df + 1)), rounded; n texts, df of which hold the run."""
    blocks, n = _in_blocks(corpus, text, text, 1)
    return _held(blocks, longest).groupBy("gram").agg(F.sum("df").alias("df")).select("gram", _weight(n, F.col("df")).alias("weight"))


@dataclass(frozen=True)
class HashedGrams:
    """Signed feature hashing. ``weights`` (gram, weight) may be None; a run that it lacks has the weight ``unknown``.

    A task takes the runs of a block of texts apart and counts them; only a block's different runs are shuffled.
    """

    dims: int = 64
    longest: int = 2
    weights: DataFrame | None = None
    unknown: int = 100

    @classmethod
    def fitted(cls, corpus: DataFrame, text: str, dims: int = 64, longest: int = 2) -> HashedGrams:
        return cls(dims, longest, document_frequencies(corpus, text, longest))

    def embed(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """Each row's vector; texts without words have a zero vector. Rows with equal keys have one vector, of all their words."""
        blocks, _ = _in_blocks(texts, key, text, self.dims)
        if self.weights is None:
            weighed = texts.sparkSession.createDataFrame([], "block int, place int, weight long")
        else:
            weighed = _held(blocks, self.longest).join(self.weights, "gram").select("block", "place", F.col("weight").cast("long").alias("weight"))
        return _embedded(blocks, weighed, self.unknown, self.dims, self.longest, key)

    @classmethod
    def embed_corpus(cls, corpus: DataFrame, key: str, text: str, dims: int = 64, longest: int = 2) -> DataFrame:
        """The same as fitting on a corpus and embedding its own texts, without a table of weights: runs that a single text holds, by far
        the most, have one weight and stay where they are."""
        blocks, n = _in_blocks(corpus, key, text, dims)
        df = F.sum("df").over(Window.partitionBy("gram"))
        weighed = _held(blocks, longest).withColumn("df", df).where("df > 1").select("block", "place", _weight(n, F.col("df")).alias("weight"))
        once = corpus.sparkSession.range(1).select(_weight(n, F.lit(1))).first()[0]
        return _embedded(blocks, weighed, once, dims, longest, key)


def search(queries: DataFrame, corpus: DataFrame, embedder: Embedder, k: int, on: Sequence[str] = ()) -> DataFrame:
    """Each query text's k nearest texts: ``query_id``, ``id``, ``score`` and ``rank``, as ``knn`` gives them.

    ``queries``: query_id, text and the columns ``on``; ``corpus``: id, text and ``on``.
    """
    side = lambda df, key: embedder.embed(df, key, "text").join(df.select(key, *on), key) if on else embedder.embed(df, key, "text")
    asked = side(queries, "query_id").withColumnRenamed("vector", "q")
    return knn(asked, side(corpus, "id"), k, on)
