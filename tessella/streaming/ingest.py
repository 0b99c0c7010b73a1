"""Continuous ingest: idempotent writes, bounded retry, dead letters, replay, back-off.

A message log is read as a file stream. Attempts are appended to a log table, so a message's state is an aggregate of
the log, and a batch that runs twice changes nothing: its rows are keyed and its folder is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MAX_RETRIES, BACKOFF_MS, ERROR_CHARS = 3, 1_000, 2_000


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def dedup_stream(messages: DataFrame, key: str, event_time: str, late: str) -> DataFrame:
    """First message of each key, with state bounded by the watermark."""
    return messages.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes all that is there, batch by batch, and stops."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_batch(path: str, by: str = "batch") -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own; a repeated batch replaces it."""

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{by}={batch}")

    return sink


def terminal_state(attempts: DataFrame) -> DataFrame:
    """Of a log of attempts (task_id, retry, ok, error): tries made, COMPLETED or FAILED, and whether it is a dead letter.

    A message is tried until it succeeds, at most MAX_RETRIES times after the first; attempts after the first success don't count.
    """
    first_ok = F.min(F.when(F.col("ok"), F.col("retry")))
    agg = attempts.where(F.col("retry") <= MAX_RETRIES).groupBy("task_id").agg(first_ok.alias("first_ok"), F.max("retry").alias("last"), F.max_by("error", "retry").alias("error"))
    ok = F.col("first_ok").isNotNull()
    return agg.select("task_id", F.when(ok, F.col("first_ok") + 1).otherwise(F.col("last") + 1).cast("int").alias("tries"), F.when(ok, "COMPLETED").when(F.col("last") >= MAX_RETRIES, "FAILED").otherwise("PROCESSING").alias("status"), (~ok & (F.col("last") >= MAX_RETRIES)).alias("dead"), F.when(ok, None).otherwise(F.substring("error", 1, ERROR_CHARS)).alias("error"))


def next_attempt(failed_at: Column, retry: Column, step_ms: int = BACKOFF_MS) -> Column:
    """Linear back-off: one step more with each retry."""
    return F.timestamp_micros(F.unix_micros(failed_at) + (retry + 1) * (step_ms * 1_000))


def admit(messages: DataFrame, tasks: DataFrame, skip: tuple[str, ...] = ("COMPLETED", "FAILED")) -> DataFrame:
    """Messages whose task exists and is not finished; each task once."""
    open_ = tasks.where(~F.col("status").isin(*skip)).select("task_id")
    return messages.join(open_, "task_id", "left_semi").dropDuplicates(["task_id"])


def process_batch(batch: DataFrame, work: Callable[[Column], Column], done: str, retry: str, dead: str, batch_id: int) -> None:
    """One micro-batch: ``work`` gives an error or null per row; rows go to done, retry or dead letters, and only there."""
    tried = batch.withColumn("error", work(F.col("payload"))).persist()
    try:
        tried.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{done}/batch={batch_id}")
        again = tried.where(F.col("error").isNotNull() & (F.col("retry_count") < MAX_RETRIES))
        again.drop("error").withColumn("retry_count", F.col("retry_count") + 1).write.mode("overwrite").parquet(f"{retry}/batch={batch_id}")
        lost = tried.where(F.col("error").isNotNull() & (F.col("retry_count") >= MAX_RETRIES))
        lost.withColumn("error", F.substring("error", 1, ERROR_CHARS)).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
    finally:
        tried.unpersist()


def replay(dead: DataFrame, tasks: DataFrame, ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages to send again with retry 0, and the tasks with those set to PENDING first; only FAILED tasks are replayed."""
    chosen = dead if ids is None else dead.where(F.col("task_id").isin(*ids))
    failed = tasks.where(F.col("status") == "FAILED").select("task_id")
    again = chosen.join(failed, "task_id", "left_semi").dropDuplicates(["task_id"])
    reset = tasks.join(again.select("task_id", F.lit(True).alias("again")), "task_id", "left").withColumn("status", F.when(F.coalesce("again", F.lit(False)), "PENDING").otherwise(F.col("status"))).drop("again")
    return again.drop("error").withColumn("retry_count", F.lit(0)), reset


def dead_letter_stats(dead: DataFrame, recent: int = 5) -> tuple[int, DataFrame]:
    return dead.count(), dead.orderBy(F.desc("failed_at"), "task_id").limit(recent)


def reingest(stored: DataFrame, incoming: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A new snapshot of chunks: those of changed documents are replaced, others stay."""
    return stored.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(chunk(incoming))


def new_records(texts: DataFrame, record: Callable[[Column], Column]) -> DataFrame:
    """Of cumulative texts (conv_id, turn, text), each conversation's records once, with their place."""
    whole = texts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return whole.select("conv_id", F.posexplode(record(F.array_join(F.col("t.text"), ""))).alias("place", "record"))
