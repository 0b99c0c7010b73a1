"""Changes to tables as new snapshots: upsert, status update, delete, change detection, events to state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.generated import content_hash

STATUSES = ("PENDING", "ADOPTED", "REJECTED")


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], order: str, kept: Sequence[str] = ()) -> DataFrame:
    """Last write wins by key; columns ``kept`` keep the first value they had. One shuffle, one aggregate with partial maxima."""
    both = table.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("turn", order)).alias("r"), *[F.min_by(c, F.struct("turn", order)).alias(f"first_{c}") for c in kept])
    return last.select(*keys, *[F.col(f"first_{c}").alias(c) if c in kept else F.col(f"r.{c}").alias(c) for c in rest])


def set_status(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Status and reason from ``updates`` (knowledge, id, new_status, reason), for test cases only; others stay."""
    u = updates.dropDuplicates(["knowledge", "id"])
    both = chunks.join(u, ["knowledge", "id"], "left")
    hit = F.col("new_status").isNotNull() & (F.col("type") == "test_case")
    return both.withColumn("status", F.when(hit, F.col("new_status")).otherwise(F.col("status"))).withColumn("reject_reason", F.when(hit & (F.col("reason") != ""), F.col("reason"))).drop("new_status", "reason")


def delete_by(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def default_status(raw: Column) -> Column:
    """PENDING where a status is missing or unknown."""
    return F.when(F.upper(raw).isin(*STATUSES), F.upper(raw)).otherwise("PENDING")


def changed(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming documents whose content hash is new or differs from the stored one."""
    own = incoming.withColumn("new_hash", content_hash(F.col("content")))
    both = own.join(stored.select(*keys, F.col("content_hash").alias("old_hash")), list(keys), "left")
    return both.where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("new_hash"))).withColumn("change", F.when(F.col("old_hash").isNull(), "new").otherwise("changed"))


def latest_state(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A log of events to the state of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def fill_first(existing: Column, now: Column) -> Column:
    return F.coalesce(existing, now)


def without_mirror(cases: DataFrame, mirror: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases that have no row in the mirror, whatever its tag."""
    return cases.join(mirror.select(key).distinct(), key, "left_anti")


def exact_duplicates(chunks: DataFrame) -> DataFrame:
    """Hashes that several chunks share, with the least id; only hashes and ids are shuffled."""
    return chunks.select("id", content_hash(F.col("content")).alias("content_hash")).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def adoption_stats(cases: DataFrame, by: Sequence[str] = ("knowledge",)) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    pending = F.count_if(F.col("status").isNull() | (F.col("status") == "PENDING"))
    counts = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), count("ADOPTED").alias("adopted"), count("REJECTED").alias("rejected"), pending.alias("pending"))
    return counts.withColumn("adoption_rate", F.when(F.col("total") > 0, F.floor(F.col("adopted") / F.col("total") * 100 + 0.5)).otherwise(0).cast("int"))


def tags(chunks: DataFrame) -> DataFrame:
    return chunks.select("knowledge").distinct()


def newest(table: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    return table.withColumn("i", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("i") <= n).drop("i")
