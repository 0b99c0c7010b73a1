"""Mixing sources to target weights.

Tokens are aggregated per source, each source gets a target share and from it a repetition rate, and each
document is emitted floor(rate) times plus one more copy with probability equal to the rate's fraction. The
draw is a hash of seed, id and text, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, save_table, small

SEED = 20_240_229
#: A document is taken three times at most, so a source's target stops at three times its size.
MOST_COPIES = 3
#: By the rank of the source's name.
CYCLE = (1, 2, 3)


def word_count(text):
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", most: int = MOST_COPIES) -> DataFrame:
    """``sizes``: a row per source with ``source`` and ``source_size``. Adds ``weight``, ``target`` and ``rate``.

    Targets share the sum of all sizes by weight. A target stops at ``most`` times its source's size; the excess is
    shared again by weight among the others, until none is above. In closed form: a source stops at its
    limit if limit / weight is below the level, and sorted by limit / weight the level is the first one,
    (total - limits before) / (weights from here on), that does not exceed the own ratio; from there on the levels fall, so it is the largest.
    One row per source goes through the windows, documents never do.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "n")
    ranked = (
        sizes.withColumn("n", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), ((F.col("n") - 1) % len(CYCLE) + 1).cast("int")).cast("long"))
        .withColumn("ratio", F.col("source_size") * F.lit(float(most)) / F.col("weight"))
        .withColumn("limit_", F.col("source_size") * most)
        .withColumn("limits_before", F.coalesce(F.sum("limit_").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level_", (F.col("total") - F.col("limits_before")).cast("double") / F.col("weights_left"))
        .withColumn("level", F.max(F.when(F.col("level_") <= F.col("ratio"), F.col("level_"))).over(Window.partitionBy()))
    )
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("limit_").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return (
        ranked.withColumn("target", target)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select(source, "source_size", "weight", "target", "rate")
    )


def draw(doc_id, text, seed: int = SEED):
    """A number from [0, 1): the first 52 bits of an MD5 over seed, id and the text's MD5 (null: empty)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` (copies * size).

    Nulls: a null text has size 0; a null source is a source of its own, the last; a null id draws as the empty
    string, the text still tells such documents apart. Repeated rows draw alike. An empty table gives an empty one.
    Columns of ``docs`` stay; a new column whose name is taken gets an underscore before it.
    """
    return _planned(docs, doc_id, text, source, seed, most)[0]


def _planned(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, most: int) -> tuple[DataFrame, str]:
    """The plan, and the name of its column of copies."""
    names = ("size", "source_size", "target", "rate", "copies", "taken")
    size, source_size, target, rate, copies, taken, key = fresh(docs, *names, "mix_source")
    words = word_count(F.col(f"`{text}`"))
    # partial sums in the map tasks: a source with a third of all rows sends one row per task
    sums = docs.select(F.col(f"`{source}`").alias("source"), words.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = save_table(source_targets(save_table(sums, "mix-sizes"), "source", most), "mix-targets")
    targets = targets.select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate))
    planned = docs.withColumn(size, words).join(small(targets), F.col(f"`{source}`").eqNullSafe(F.col(key)), "left").drop(key)
    whole = F.floor(rate)
    n = whole + F.when(draw(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed) < F.col(rate) - whole, 1).otherwise(0)
    planned = planned.withColumn(copies, n.cast("int"))
    return planned.withColumn(taken, F.col(copies) * F.col(size)), copies


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, most: int = MOST_COPIES) -> DataFrame:
    """The mixture itself: the rows and columns of ``docs``, each as often as ``mix_plan`` says."""
    plan, copies = _planned(docs, doc_id, text, source, seed, most)
    (n,) = fresh(plan, "mix_copy")
    return plan.where(F.col(copies) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[f"`{c}`" for c in docs.columns])


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM s
), w AS (
  SELECT *, (n - 1) % 3 + 1 AS weight, source_size * {float(MOST_COPIES)} / ((n - 1) % 3 + 1) AS ratio, source_size * {MOST_COPIES} AS limit_ FROM r
), l AS (
  SELECT *, coalesce(sum(limit_) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS limits_before,
    sum(weight) OVER (ORDER BY ratio, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left, sum(source_size) OVER () AS total FROM w
), v AS (
  SELECT *, CAST(total - limits_before AS DOUBLE) / CAST(weights_left AS DOUBLE) AS level_ FROM l
), t AS (
  SELECT *, max(level_) FILTER (WHERE level_ <= ratio) OVER () AS level FROM v
), g AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN CAST(limit_ AS DOUBLE) ELSE level * weight END AS target FROM t
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || md5(coalesce(d.text, ''))), 1, 13)) AS BIGINT) / {float(16**13)!r} AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
