"""The engine's tables as views over the star schema, with the same views in SQL.

``chunks``, ``vectors``, ``attempts``, ``case_lines``, ``frozen`` and the rest name what the operators work on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieval import knn

#: Candidates kept for each query of an evaluation, and the stated query set: every id divisible by EVERY.
CANDIDATE_K, EVERY = 30, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: knowledge tag, type and adoption status as columns of their own, so filters reach the files."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "ADOPTED").when(F.col("quality") == 0, "REJECTED").otherwise("PENDING")
    kind = F.when(F.col("lang") == "en", "knowledge").otherwise("test_case")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("knowledge"), kind.alias("type"), status.alias("status"))


CHUNKS = """chunks AS (
  SELECT d.doc_id AS id, d.text AS content, d.source AS knowledge, CASE WHEN d.lang = 'en' THEN 'knowledge' ELSE 'test_case' END AS type,
    CASE l.quality WHEN 1 THEN 'ADOPTED' WHEN 0 THEN 'REJECTED' ELSE 'PENDING' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by id; the label is the tag that a search filters by."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("tag"))


VECTORS = f"""{CHUNKS}, vectors AS (
  SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS vector, e.label AS tag, c.content, c.type, c.status
  FROM embeddings e LEFT JOIN chunks c ON c.id = e.vec_id)"""

COSINE = """coalesce(list_sum(list_transform(list_zip(q.vector, d.vector), lambda p: p[1] * p[2]))
    / nullif(sqrt(list_sum(list_transform(q.vector, lambda x: x * x))) * sqrt(list_sum(list_transform(d.vector, lambda x: x * x))), 0), 0)"""


def queries_of(v: DataFrame) -> DataFrame:
    """Each query belongs to a request of up to five and has its place in it."""
    return v.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("q"), "tag", F.floor(F.col("id") / 100).cast("long").alias("request"), (F.col("id") % 100 / EVERY).cast("int").alias("pos"))


def hits_sql(k: int, where: str = "TRUE", name: str = "hits") -> str:
    """Each query's k best of its own tag, itself left out."""
    return f"""{name} AS (
  SELECT q.id AS query_id, q.id // 100 AS request, CAST(q.id % 100 / {EVERY} AS INTEGER) AS pos, d.id, d.content, round({COSINE}, 9) AS score,
    CAST(row_number() OVER (PARTITION BY q.id ORDER BY round({COSINE}, 9) DESC, d.id) AS INTEGER) AS rank
  FROM vectors q JOIN vectors d ON q.tag = d.tag AND q.id <> d.id WHERE q.id % {EVERY} = 0 AND ({where}) QUALIFY rank <= {k})"""


def hits(spark: SparkSession, sf_dir: str, k: int, where=None) -> DataFrame:
    """``query_id``, ``id``, ``score`` and ``rank`` of the k best of the query's tag. Chunks are met only to filter by them."""
    v = embeddings(spark, sf_dir)
    corpus = v if where is None else v.join(chunks(spark, sf_dir).select("id", "type", "status"), "id", "left").where(where)
    return knn(queries_of(v).select("query_id", "q", "tag"), corpus.select("id", "vector", "tag"), k, on=["tag"])


def frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen candidates of every query over all tags, with a grade by the labels' distance (0 to 3)."""
    v = embeddings(spark, sf_dir)
    top = knn(v.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("q")), v.select("id", "vector"), CANDIDATE_K)
    tags = v.select("id", "tag")
    graded = top.join(tags, "id").join(tags.select(F.col("id").alias("query_id"), F.col("tag").alias("q_tag")), "query_id")
    gap = F.abs(F.col("tag") - F.col("q_tag"))
    return graded.select("query_id", F.col("id").alias("candidate_id"), "score", F.col("rank").alias("rag_rank"), F.greatest(F.lit(3) - gap, F.lit(0)).cast("int").alias("grade"))


FROZEN = f"""vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label AS tag FROM embeddings), frozen AS (
  SELECT q.id AS query_id, d.id AS candidate_id, round({COSINE}, 9) AS score,
    CAST(row_number() OVER (PARTITION BY q.id ORDER BY round({COSINE}, 9) DESC, d.id) AS INTEGER) AS rag_rank,
    CAST(greatest(3 - abs(d.tag - q.tag), 0) AS INTEGER) AS grade
  FROM vectors q JOIN vectors d ON q.id <> d.id WHERE q.id % {EVERY} = 0 QUALIFY rag_rank <= {CANDIDATE_K})"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: a run is a user, a case an event type, numbered by time."""
    order = Window.partitionBy("run_id", "case_id").orderBy("created_at", "event_id")
    outcome = F.when(F.col("value") < 30, "FAILED").when(F.col("value") < 35, "BLOCKED").otherwise("PASSED")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("case_id"), "event_id", F.col("ts").alias("created_at"), outcome.alias("outcome"), F.nullif(F.floor(F.col("value")).cast("int"), F.lit(0)).alias("duration_ms"), F.get_json_object("props", "$.k").cast("int").alias("retry"))
    return e.withColumn("attempt_number", F.row_number().over(order))


ATTEMPTS = """attempts AS (
  SELECT user_id AS run_id, event_type AS case_id, event_id, ts AS created_at,
    CASE WHEN value < 30 THEN 'FAILED' WHEN value < 35 THEN 'BLOCKED' ELSE 'PASSED' END AS outcome,
    nullif(CAST(floor(value) AS INTEGER), 0) AS duration_ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS retry,
    CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS attempt_number FROM events)"""


def case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attempts, for scale: a run is an order, a case a part."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("case_id"), F.col("l_linenumber").alias("attempt_number"),
        F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_returnflag") == "A", "BLOCKED").otherwise("PASSED").alias("outcome"),
    )


CASE_LINES = """case_lines AS (
  SELECT l_orderkey AS run_id, l_partkey AS case_id, l_linenumber AS attempt_number,
    CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'BLOCKED' ELSE 'PASSED' END AS outcome FROM lineitem)"""
