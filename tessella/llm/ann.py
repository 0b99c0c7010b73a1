"""Approximate nearest neighbours by collision counting.

A block's vectors are projected on LINES random lines, one sorted array each, which are written with the block. A query expands a
window around its own projection in every array at once. The first windows hold a small share of the block; they are doubled
step by step (virtual rehashing), and only the new ends are counted. Vectors that fall into the windows of at least
THRESHOLD of the lines are verified: their exact inner product is computed. A query stops once a vector as near as its
current k-th best would have been verified with probability CONFIDENCE, and its last windows are no wider than that.

Largest inner product becomes nearest Euclidean distance by one more component: sqrt(max norm² - norm²), 0 for queries.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .vectors import best, best_of_blocks, usable

K = 20
LINES = 24
THRESHOLD = 0.6
CONFIDENCE = 0.95
#: The share of a block in a query's first windows, and the factor of the widths from one step to the next.
FIRST, GROWTH = 0.02, 2.0
SEED = 11
#: Queries whose windows are looked up together.
TOGETHER = 64


@functools.lru_cache(maxsize=4)
def needed_widths(lines: int, least: int, confidence: float) -> float:
    """Half-width over distance at which at least ``least`` of ``lines`` windows hold a vector with that confidence."""
    lo, hi = 0.0, 8.0
    for _ in range(60):
        z = (lo + hi) / 2
        p = math.erf(z / math.sqrt(2))
        tail = sum(math.comb(lines, i) * p**i * (1 - p) ** (lines - i) for i in range(least, lines + 1))
        lo, hi = (z, hi) if tail < confidence else (lo, z)
    return hi


def directions(dims: int, lines: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((lines, dims + 1))


def indexed(block: dict[str, np.ndarray], lines: int = LINES) -> dict[str, np.ndarray]:
    """Adds the sorted projections, the vectors' places in their order, and the largest squared norm."""
    vectors = block["vectors"]
    d = vectors.shape[1]
    normal = directions(d, lines)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    top = norms.max()
    projected = vectors @ normal[:, :d].T + np.sqrt(np.maximum(top - norms, 0))[:, None] * normal[:, d]
    order = np.argsort(projected, axis=0).astype(np.int32)
    return block | {"order": np.ascontiguousarray(order.T), "values": np.ascontiguousarray(np.take_along_axis(projected, order, axis=0).T), "top": np.array(top)}


def search(block: dict[str, np.ndarray], q_rows: np.ndarray, queries: np.ndarray, k: int, threshold: float = THRESHOLD, confidence: float = CONFIDENCE, verified: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each query's best k of the block. The numbers of verified vectors are appended to ``verified``."""
    rows, vectors, order, values, top = block["rows"], block["vectors"], block["order"], block["values"], float(block["top"])
    (n, d), lines = vectors.shape, len(order)
    least = math.ceil(threshold * lines)
    need = needed_widths(lines, least, confidence)
    normal = directions(d, lines)
    radius = math.sqrt(top)
    lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    scaled = queries * (radius / lengths)[:, None]  # the order of inner products stays
    reach = max(1, int(FIRST * n / 2))
    for start in range(0, len(queries), TOGETHER):
        centre = scaled[start : start + TOGETHER] @ normal[:, :d].T
        size = len(centre)
        middle = np.stack([values[j].searchsorted(centre[:, j]) for j in range(lines)], axis=1)
        ends = [np.take_along_axis(values.T, np.clip(middle + r, 0, n - 1), axis=0) for r in (-reach, reach)]
        half = np.maximum(np.median(ends[1] - ends[0], axis=1) / 2, 1e-9 * radius)
        low, high = middle.copy(), middle.copy()
        counts, seen = np.zeros((size, n), dtype=np.int16), np.zeros((size, n), dtype=bool)
        scores, places = [np.empty(0)] * size, [np.empty(0, dtype=np.int64)] * size
        open_ = np.arange(size)
        while len(open_):
            new_low, new_high = low.copy(), high.copy()
            for j in range(lines):
                new_low[open_, j] = np.minimum(low[open_, j], values[j].searchsorted(centre[open_, j] - half[open_], "left"))
                new_high[open_, j] = np.maximum(high[open_, j], values[j].searchsorted(centre[open_, j] + half[open_], "right"))
            still = []
            for i in open_.tolist():
                a, b, c, e = new_low[i].tolist(), low[i].tolist(), high[i].tolist(), new_high[i].tolist()
                parts = [order[j, a[j] : b[j]] for j in range(lines)] + [order[j, c[j] : e[j]] for j in range(lines)]
                counts[i] += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
                fresh = np.flatnonzero((counts[i] >= least) & ~seen[i])
                if len(fresh):
                    seen[i, fresh] = True
                    fresh = fresh[rows[fresh] != q_rows[start + i]]
                    places[i] = np.concatenate([places[i], fresh])
                    scores[i] = np.concatenate([scores[i], vectors[fresh] @ queries[start + i]])
                    if len(scores[i]) > k:
                        keep = best(block["ids"][places[i]], scores[i], k)
                        places[i], scores[i] = places[i][keep], scores[i][keep]
                if seen[i].all():
                    continue
                wider = half[i] * GROWTH
                if len(scores[i]) >= k:
                    # the distance of the k-th best in the lifted space
                    kth = scores[i].min() * radius / lengths[start + i]
                    enough = need * math.sqrt(max(0.0, 2 * top - 2 * kth))
                    if half[i] >= enough:
                        continue
                    wider = min(wider, enough)
                half[i] = wider
                still.append(i)
            low, high, open_ = new_low, new_high, np.array(still, dtype=np.int64)
        for i in range(size):
            found = places[i][best(block["ids"][places[i]], scores[i], k)]
            if verified is not None:
                verified.append(int(seen[i].sum()))
            if len(found):
                # as the plain sum over components, from the first to the last
                yield np.full(len(found), start + i), found, np.array([float(np.dot(vectors[p], queries[start + i])) for p in found.tolist()])


def nearest(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's k nearest by inner product among all other vectors: query_id, rank, vec_id, score.

    Queries are the ids divisible by 20. See ``usable`` for the rows that take part; fewer than k candidates give all,
    and an empty table none. The expected recall is at least CONFIDENCE. How many vectors are verified depends on the data: a
    few per cent where near neighbours are much nearer than the rest, most of them where all are about as far away.
    """
    return best_of_blocks(usable(vectors, False, vec_id, embedding), indexed, search, k, "double", 12 * LINES)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
