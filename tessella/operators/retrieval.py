"""Vector search by cosine over blocks, and what is built on it: filters, several queries, deduplication, mean scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the corpus in a block at most, queries that are compared with it at once, and bytes of a block's vectors at most.
BLOCK, QUERY_BLOCK, BLOCK_BYTES = 65_536, 512, 32 << 20
#: Where there are fewer blocks than task slots, a block has so many rows at least.
LEAST = 4_096
#: Rows of a matrix product, and pairs that are scored at once.
TILE, CHUNK = 8_192, 1 << 15
#: Tasks that the blocks of all tags are dealt to at most.
MOST_PARTS = 10_000


def metadata_filter(values: dict[str, object]) -> Column:
    """All columns equal to their values; null stands for the empty string. Built from columns, never from strings."""
    out = F.lit(True)
    for name, value in values.items():
        out = out & (F.col(name) == F.lit("" if value is None else value))
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def is_usable(vector: Column) -> Column:
    """Neither null nor empty nor all zero."""
    return F.coalesce((F.size(vector) > 0) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    return np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)


def _tile(u: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, unit: np.ndarray, single: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for some queries of length 1: places of the queries, ids and scores. ``ids`` ascend.

    Products of single precision leave out what can't be among the best, by a bound on their error; the rest is scored in double precision.
    """
    # a query of zeros has the score 0 everywhere, without error, so later rows can't pass its best ones
    slack = np.where(u.any(axis=1), (u.shape[1] + 8) * 2.0**-23 + 1e-9, 0.0)
    u32, least = u.astype(np.float32), np.full(len(u), -np.inf)
    at, found, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for lo in range(0, len(ids), TILE):
        s = u32 @ single[lo : lo + TILE].T
        first = least == -np.inf
        bound = (least - slack).astype(np.float32)
        if first.any() and s.shape[1] > k + 1:  # one more, as the query itself may be among them
            bound[first] = np.partition(s[first], s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - 2 * slack[first]
        bound = np.where(first, np.nextafter(bound, np.float32(-np.inf)), bound)
        hits = np.flatnonzero(s > bound[:, None])
        row, col = hits // s.shape[1], hits % s.shape[1] + lo
        new = ids[col] != q_ids[row]
        row, col = row[new], col[new]
        if not len(row):
            continue
        exact = np.concatenate([np.einsum("ij,ij->i", u[row[i : i + CHUNK]], unit[col[i : i + CHUNK]]) for i in range(0, len(row), CHUNK)])
        at, found, scores = np.concatenate([at, row]), np.concatenate([found, ids[col]]), np.concatenate([scores, np.round(exact, 9)])
        order = np.lexsort((found, -scores, at))
        at, found, scores = at[order], found[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < k
        last = keep & (place == k - 1)
        least[at[last]] = scores[last]
        at, found, scores = at[keep], found[keep], scores[keep]
    return at, found, scores


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows by ``block``, in each block those of the corpus before the queries: the block is held, the queries pass by."""
    block, pieces, held = None, [], None
    for batch in batches:
        names, asked = batch.column("block"), batch.column("asked").to_numpy(zero_copy_only=False)
        codes = names.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(asked.astype(np.int8)) != 0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if (name := names[lo].as_py()) != block:
                block, pieces, held = name, [], None
            part = batch.slice(lo, hi - lo)
            ids, vectors = part.column("id").to_numpy(), part.column("vector")
            if not asked[lo]:
                pieces.append((ids.copy(), _matrix(vectors).copy()))
                continue
            if held is None:
                unit = _unit(np.concatenate([m for _, m in pieces])) if pieces else np.empty((0, 0))
                held, pieces = (np.concatenate([i for i, _ in pieces]) if pieces else np.empty(0, np.int64), unit, unit.astype(np.float32)), []
            for i in range(0, len(ids) if len(held[0]) else 0, QUERY_BLOCK):
                some = ids[i : i + QUERY_BLOCK]
                at, found, scores = _tile(_unit(_matrix(vectors.slice(i, QUERY_BLOCK))), some, *held, k)
                yield pa.RecordBatch.from_arrays([pa.array(some[at]), pa.array(found), pa.array(scores)], names=["query_id", "id", "score"])


def knn(queries: DataFrame, corpus: DataFrame, k: int, on: Sequence[str] = ()) -> DataFrame:
    """Each query's k best rows: ``query_id``, ``id``, ``score`` (cosine, 9 decimals) and ``rank`` (from 1, ties by id).

    ``queries`` has query_id, q and the columns ``on``, ``corpus`` id, vector and ``on``; a row is compared with the
    queries of equal ``on``, itself left out. A task holds a block of the corpus, bounded in bytes, and the queries of its tag pass by it in
    batches; a large tag has many blocks. Each block keeps k rows per query; a window merges them. Both tables are read
    more than once, so what is dear to compute should be written first.
    """
    on, spark = list(on), corpus.sparkSession
    rows, asked = corpus.where(F.col("vector").isNotNull()), queries.where(F.col("q").isNotNull())
    n, fit = F.count(F.lit(1)), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.max(F.size("vector")), F.lit(1)))))
    blocks = F.greatest(F.ceil(n / F.greatest(fit, F.lit(1))), F.least(F.lit(2 * spark.sparkContext.defaultParallelism), F.floor(n / LEAST)), F.lit(1)).cast("long").alias("blocks")
    if on:
        sizes = rows.groupBy(*on).agg(blocks)
        total = sizes.agg(F.sum("blocks")).first()[0] or 1
        rows, asked = rows.join(sizes, on), asked.join(sizes, on)
    else:
        total = rows.agg(blocks).first()[0]
        rows, asked = rows.withColumn("blocks", F.lit(total)), asked.withColumn("blocks", F.lit(total))
    parts = min(total, MOST_PARTS)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")))
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.pmod(F.xxhash64(*on) + F.col("b") if on else F.col("b"), F.lit(parts)).cast("int").alias("task")
    side = lambda df, is_query, key, vector: df.select(task, F.to_json(F.struct(*on, "b")).alias("block"), F.lit(is_query).alias("asked"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    both = side(rows, False, "id", "vector").union(side(asked, True, "query_id", "q"))
    dealt = both.repartitionById(parts, F.col("task")).sortWithinPartitions("block", "asked", "id").drop("task")
    found = dealt.mapInArrow(lambda batches: _search(batches, k), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dedup_texts(hits: DataFrame, k: int) -> DataFrame:
    """Of each request the first k different texts, by query and rank of their first hit; no new sort by score.

    ``hits``: request, pos, rank, content.
    """
    first = hits.groupBy("request", F.sha2("content", 256).alias("content_hash")).agg(F.min(F.struct("pos", "rank")).alias("seen"))
    place = F.row_number().over(Window.partitionBy("request").orderBy("seen.pos", "seen.rank"))
    return first.withColumn("place", place).where(F.col("place") <= k).select("request", "content_hash", "place")


def mean_scores(hits: DataFrame, missing: str = "skip") -> DataFrame:
    """Of each request every different text with the mean score over the queries that found it, best first.

    ``missing='zero'`` divides by the number of the request's queries instead. Not cut to k.
    """
    by = hits.groupBy("request", F.sha2("content", 256).alias("content_hash"))
    score = F.avg("score") if missing == "skip" else F.sum("score") / F.max("queries")
    out = by.agg(F.round(score, 6).alias("score"), F.count(F.lit(1)).alias("hits"), F.min(F.struct("pos", "rank")).alias("seen"))
    return out.select("request", "content_hash", "score", "hits", F.col("seen.pos").alias("first_pos"), F.col("seen.rank").alias("first_rank"))


def keep_best(hits: DataFrame, k: int) -> DataFrame:
    """Of each request the k best documents, each with its best score."""
    best = hits.groupBy("request", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def best_chunk_per_document(hits: DataFrame, document: str, k: int) -> DataFrame:
    """Keeps the best scored chunk of each document, then k documents of each request."""
    w = Window.partitionBy("request", document).orderBy(F.desc("score"), "id")
    one = hits.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id"))
    return one.withColumn("place", place).where(F.col("place") <= k)
