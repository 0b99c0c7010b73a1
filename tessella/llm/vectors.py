"""Vector tables in blocks: what the two vector searches share.

Candidates are packed into blocks of bounded memory, each with its index, which is built once. Queries are packed into
smaller blocks and written to the shared folder. A task owns a block of candidates and reads the blocks of queries one after the
other, so no vector is shuffled for a pair of blocks. Each block gives its own best k of a query; a window merges them.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import memory_share, running_totals, save_table, scratch_path, small

#: Rows in a block of queries, and in a block of candidates at least.
QUERIES, LEAST = 4_096, 1_024
#: A block of candidates takes a SHARE-th of the heap of a task slot, within limits, at ROOM times the bytes of its vectors.
SHARE, LEAST_BYTES, MOST_BYTES, ROOM = 8, 32 << 20, 1 << 30, 3
#: The stated query set: ids divisible by this.
EVERY = 20

#: From the arrays of a block (``ids``, ``rows``, ``vectors``) to all those that a search in it needs.
Index = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]
#: From a block's index, queries' rows and vectors and k to query numbers, places in the block, and scores, of equal length.
Search = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def usable(vectors: DataFrame, zero_too: bool, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``row`` (a number of its own), ``id`` and ``vector`` of the rows that take part.

    Rows without an id, without a vector or with an empty one, or with a null or non-finite component are left out; zero
    vectors stay if ``zero_too``. Vectors of different lengths have no inner product: each length is searched by itself.
    Rows with equal ids all stay: each is a row of its own. Other columns, whatever their names, are not read.
    """
    x = F.col("vector")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, bad))
    if not zero_too:
        rows = rows.where(F.exists(x, lambda v: v != 0))
    # numbered as they are written: from then on each row has its number
    return save_table(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector"), "vectors")


def pack(rows: DataFrame, blocks: DataFrame, index: Index, path: str) -> DataFrame:
    """Writes one row per block: its number and its arrays as bytes. ``blocks`` (d, first, blocks) gives the blocks of each
    length of vectors; rows go to them by a hash of their number."""
    total = blocks.agg(F.coalesce(F.sum("blocks"), F.lit(1)).cast("int")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).sort_by("row")
            ids = t.column("id").to_numpy()
            vectors = np.asarray(t.column("vector").combine_chunks().flatten()).reshape(len(ids), -1)
            out = io.BytesIO()
            np.savez(out, **index({"ids": ids, "rows": t.column("row").to_numpy(), "vectors": vectors}))
            yield pa.RecordBatch.from_arrays([pa.array([t.column("block")[0].as_py()], pa.int32()), pa.array([out.getvalue()], pa.large_binary()).cast(pa.binary())], names=["block", "data"])

    placed = rows.withColumn("d", F.size("vector")).join(small(blocks), "d")
    placed = placed.select("row", "id", "vector", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).cast("int").alias("block")).repartitionById(total, F.col("block"))
    placed.mapInArrow(run, "block int, data binary").write.option("compression", "none").parquet(path)
    return rows.sparkSession.read.schema("block int, data binary").parquet(path)


def arrays(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {name: f[name] for name in f.files}


def blocks_at(path: str) -> Iterator[dict[str, np.ndarray]]:
    """The blocks of a written table, one in memory at a time. Only files of committed tasks are in the folder."""
    fs, base = pafs.FileSystem.from_uri(path)
    for file in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet")):
        with fs.open_input_file(file) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1, columns=["data"]):
                for data in batch.column("data"):
                    yield arrays(data.as_buffer())


def best_of_blocks(rows: DataFrame, index: Index, search: Search, k: int, kind: str, index_bytes: int = 0) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's k best; ties go to the smaller id.

    ``index_bytes``: what a row takes in a block besides its vector, ids and number.

    Candidates of a query are all rows but its own. Query rows with equal ids have a ranking each.
    """
    spark = rows.sparkSession
    room = memory_share(spark, SHARE, LEAST_BYTES, MOST_BYTES)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % EVERY == 0).alias("q"))
    fits = F.greatest(F.lit(LEAST), F.floor(F.lit(room) / (ROOM * (8 * F.col("d") + 16 + index_bytes))))
    blocks = F.greatest(F.ceil(F.col("n") / fits), F.least(F.lit(2 * spark.sparkContext.defaultParallelism), F.floor(F.col("n") / LEAST)), F.lit(1))
    sizes = save_table(sizes.select("d", blocks.cast("long").alias("blocks"), F.when(F.col("q") > 0, F.ceil(F.col("q") / QUERIES)).otherwise(0).cast("long").alias("q")), "vector-sizes")
    # one row per length of vectors
    dealt = lambda n: save_table(running_totals(sizes.select("d", F.col(n).alias("blocks")).where("blocks > 0"), [F.col("d")], "blocks", "first"), "vector-blocks")
    own = dealt("blocks")
    candidates = pack(rows, own, index, scratch_path(spark, "candidate-blocks"))
    path = scratch_path(spark, "query-blocks")
    pack(rows.where(F.col("id") % EVERY == 0), dealt("q"), lambda block: block, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                base = arrays(data.as_buffer())
                for query in blocks_at(path):
                    if query["vectors"].shape[1] != base["vectors"].shape[1]:
                        continue
                    for q, at, scores in search(base, query["rows"], query["vectors"], k):
                        columns = (query["ids"][q], query["rows"][q], base["ids"][at], base["rows"][at], scores)
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["query_id", "query_row", "vec_id", "vec_row", "score"])

    total = own.agg(F.coalesce(F.sum("blocks"), F.lit(1)).cast("int")).first()[0]
    found = candidates.repartitionById(total, F.col("block")).mapInArrow(run, f"query_id long, query_row long, vec_id long, vec_row long, score {kind}")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    # the rank limit is applied before the exchange as well
    merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties by smaller id: partition selection, then a sort of k."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
