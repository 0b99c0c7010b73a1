"""Global shuffle of a corpus into shards.

Two passes. The first scatters rows uniformly into memory-sized buckets by a seeded hash. The second shuffles each
bucket in memory (Fisher-Yates) and writes it. The buckets, one after the other, are the global random order;
shards are equal ranges of it, so their row counts are at most one apart (law ``rows``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import batches_of, fresh, map_columns, memory_share, running_totals, save_table, small

SEED = 7_919
#: A bucket is one task's memory in the second pass: it takes a SHARE-th of the heap of a task slot on average, within limits.
SHARE, LEAST_BYTES, MOST_BYTES = 24, 16 << 20, 512 << 20
#: Rows that are the same in id and text are numbered where there are more of them than this, and so scatter as others do.
REPEATS = 100
#: Rows count as so many bytes each besides their text.
ROW_BYTES = 64


def text_bytes(text):
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _shuffle_bucket(hash_column: str, bucket_column: str, seed: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        # string offsets have 32 bits; a bucket may be larger than planned if many rows are the same
        table = table.cast(pa.schema([pa.field(f.name, pa.large_string() if pa.types.is_string(f.type) else pa.large_binary() if pa.types.is_binary(f.type) else f.type) for f in table.schema]))
        bucket = table.column(bucket_column)[0].as_py()
        # rows arrive in any order: sorted first, so that a retried task gives the same shuffle
        order = np.argsort(table.column(hash_column).to_numpy(), kind="stable").tolist()
        last = np.arange(len(order) - 1, 0, -1)
        picks = np.random.default_rng([seed, bucket]).integers(0, last + 1) if len(last) else last
        for i, j in zip(last.tolist(), picks.tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
        start = 0
        for at in range(0, len(order), rows):
            part = table.take(pa.array(order[at : at + rows])).combine_chunks()
            narrow = pa.schema([pa.field(f.name, pa.string() if pa.types.is_large_string(f.type) else pa.binary() if pa.types.is_large_binary(f.type) else f.type) for f in part.schema])
            part = part.drop_columns([hash_column]).cast(pa.schema([f for f in narrow if f.name != hash_column]))
            place = pa.array(np.arange(start, start + part.num_rows, dtype=np.int64))
            start += part.num_rows
            part = part.append_column("place", place)
            yield from batches_of(part.rename_columns([f"c{i}" for i in range(part.num_columns)]), rows)

    return run


def shuffle_into_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), written in shuffled order.

    Law ``rows``: the shards' row counts are at most one apart. Row p of the n rows in shuffled order goes to shard
    floor(p * shards / n). The hash is over id and text, so copies with different ids scatter; up to REPEATS rows that are the
    same in both (nulls included) share a bucket, in any order, more of them are hashed with a number of their own. A text of
    any length is in one bucket. An empty table gives an empty one. Columns of ``docs`` stay; if one is
    named ``shard`` or ``slot``, the new one gets an underscore before it.
    """
    spark = docs.sparkSession
    h, b, b2, place, begin, shard, slot = fresh(docs, "scatter", "bucket", "bucket_key", "place", "bucket_start", "shard", "slot")
    bucket_bytes = bucket_bytes or memory_share(spark, SHARE, LEAST_BYTES, MOST_BYTES)
    total = docs.agg(F.coalesce(F.sum(text_bytes(F.col(f"`{text}`")) + ROW_BYTES), F.lit(0)).alias("b")).first()["b"]
    buckets = max(1, -(-total // bucket_bytes))
    # pass 1: the exchange spills to the executors' disks; each partition is one bucket
    hashed = docs.withColumn(h, F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    often = save_table(hashed.groupBy(h).count().where(F.col("count") > REPEATS).select(h), "shard-repeats")
    if often.limit(1).count():
        # written first, so that a task that runs again gives each row the number it had
        same = save_table(hashed.join(small(often), h, "left_semi"), "shard-same").withColumn(h, F.xxhash64(F.lit(seed), F.col(h), F.monotonically_increasing_id()))
        order = [F.col(f"`{c}`") for c in hashed.columns]
        hashed = hashed.join(small(often), h, "left_anti").select(*order).union(same.select(*order))
    scattered = hashed.withColumn(b, F.pmod(F.col(h), F.lit(buckets)).cast("int")).repartitionById(buckets, F.col(b))
    schema = StructType([*docs.schema.fields, StructField(b, IntegerType()), StructField(place, LongType())])
    # pass 2: one bucket in memory per task
    shuffled = save_table(map_columns(scattered, _shuffle_bucket(*(f"c{scattered.columns.index(x)}" for x in (h, b)), seed, 2_000), schema), "shards")
    counts = save_table(shuffled.groupBy(b).agg(F.count(F.lit(1)).alias("in_bucket")), "shard-counts")
    n = counts.agg(F.coalesce(F.sum("in_bucket"), F.lit(0)).alias("n")).first()["n"]
    # one row per bucket
    starts = save_table(running_totals(counts, [F.col(b)], "in_bucket", begin), "shard-starts").select(F.col(b).alias(b2), begin)
    joined = shuffled.join(small(starts), F.col(b) == F.col(b2))
    p = f"(`{begin}` + `{place}`)"
    joined = joined.withColumn(shard, F.expr(f"CAST({p} * {shards} DIV {max(n, 1)} AS INT)"))
    first = f"(CAST(`{shard}` AS BIGINT) * {n} + {shards - 1}) DIV {shards}"
    return joined.withColumn(slot, F.expr(f"CAST({p} - {first} AS BIGINT)")).select(*[F.col(f"`{c}`") for c in docs.columns], shard, slot)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return shuffle_into_shards(docs, 16).select(
        "doc_id",
        text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
