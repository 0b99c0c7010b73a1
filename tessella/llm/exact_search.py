"""Exact top-k search over sparse integer rows.

Term-at-a-time and exhaustive: a block's rows are turned into one list of postings (row, weight) per component. A query's
non-zero components scatter their weight times the postings' weights into a dense array of scores; partition selection
takes the best k of the array, and the blocks' bests are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .vectors import best, best_of_blocks, usable

K = 20
SCALE = 64
#: Queries whose score arrays are filled together.
TOGETHER = 32


def search(block: dict[str, np.ndarray], q_rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    query = np.floor(queries * SCALE)
    # int32 where no sum can leave its range, else int64
    base = block.setdefault("weights", np.floor(block["vectors"] * SCALE))
    most = np.abs(base).max(initial=0) * np.abs(query).max(initial=0) * base.shape[1]
    kind = np.int32 if most < 2**31 else np.int64
    query, postings = query.astype(kind), block.get(kind)
    if postings is None:  # made once for all queries that meet the block
        postings = block[kind] = []
        for t in range(base.shape[1]):
            column = base[:, t].astype(kind)
            rows = np.flatnonzero(column)
            # a list that names nearly every row is kept as a full column
            postings.append((slice(None), column) if 2 * len(rows) > len(base) else (rows, column[rows]))
    for start in range(0, len(query), TOGETHER):
        part = query[start : start + TOGETHER]
        scores = np.zeros((len(part), len(base)), dtype=kind)
        for t, (rows, weights) in enumerate(postings):
            for i in np.flatnonzero(part[:, t]).tolist():
                scores[i, rows] += part[i, t] * weights
        for i in range(len(part)):
            other = np.flatnonzero(block["rows"] != q_rows[start + i])
            own = scores[i][other].astype(np.int64)
            at = best(block["ids"][other], own, k)
            if len(at):
                yield np.full(len(at), start + i), other[at], own[at]


def top_k(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's k highest scores among all other rows: query_id, rank, vec_id, score (long).

    A component x counts as floor(64 * x). Queries are the ids divisible by 20. See ``usable`` for the rows that take
    part (zero rows do); fewer than k candidates give all, and an empty table none. Sums beyond 64 bits wrap.
    """
    return best_of_blocks(usable(vectors, True, vec_id, embedding), lambda block: block, search, k, "long")


ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, c.n AS m, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
