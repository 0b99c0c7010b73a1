"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A table of at most so many rows is broadcast after its rows were counted; a larger one is shuffled.
BROADCAST_ROWS = 200_000

#: A maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``; only where that is unset and the master is local (tests) a temporary folder is taken.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
            base = spark.sparkContext.getCheckpointDir()
    return base if ":" in base.split("/")[0] else f"file://{base}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back.

    This cuts the lineage: a lost executor costs the tasks that it ran, not the stages before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcast if it has at most ``rows`` rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name, a column name that ``df`` does not use yet (case-insensitively)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_columns(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``df.mapInArrow``, for columns of any name: ``run`` sees them as c0, c1, ..., and its own by place too."""
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, plain).toDF(*schema.names)


def running_totals(df: DataFrame, by: list[Column], value: str, start: str) -> DataFrame:
    """Adds ``start``: the sum of ``value`` over the rows before, in the order of ``by``.

    ``df`` is a small written table with one row per file, bucket or group, never one per document.
    """
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(start, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


def hash_sample(df: DataFrame, rows: int, h: str = "h") -> list:
    """At most ``rows`` rows that differ in column ``h``, a hash, the least by it, on the driver.

    A hash range that holds about twice as many different ones is filtered first, so tasks do not each send ``rows`` rows,
    and however often a row is repeated it counts once.
    """
    n = df.select(h).distinct().count()
    if n > 4 * rows:
        df = df.where(F.col(h) < F.lit(-(2**63) + int(2**64 * (2 * rows / n))))
    first = [F.min(F.struct(*[c for c in df.columns if c != h])).alias("_")]
    return df.groupBy(h).agg(*first).select(h, "_.*").orderBy(h).limit(rows).collect()


def passage(text: str, chars: int, seed: int) -> Column:
    """So many characters of a text, from a place that a hash of it gives; a shorter text is taken whole."""
    last = F.greatest(F.char_length(text) - chars, F.lit(0)) + 1
    return F.substr(F.col(text), (F.pmod(F.xxhash64(F.lit(seed), F.col(text)), last) + 1).cast("int"), F.lit(chars))


def memory_share(spark: SparkSession, part: int, least: int, most: int) -> int:
    """Bytes: one of ``part`` parts of the heap that a task slot has, within limits."""
    def size(value: str) -> int:
        unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(value.strip().lower().rstrip("b")[-1], 0)
        return int(float(value.lower().strip().rstrip("bkmgt"))) << unit

    conf = spark.sparkContext.getConf()
    return min(most, max(least, size(conf.get("spark.executor.memory", "1g")) // int(conf.get("spark.executor.cores", "2")) // part))


def batches_of(table: pa.Table, rows: int) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=max(1, rows))
