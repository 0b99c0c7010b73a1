"""Reranking of candidates: pass-through, scores, judges, results by index, maximal marginal relevance, two stages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import case_text

EXTERNAL_MOST, OVERFETCH, LAMBDA = 20, 3, 0.5
# Fixed value: the version of the judge's prompt, a part of its cache's keys.
PROMPT_VERSION = "v1"


def by_order(candidates: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """New ranks by ``order`` within a query, cut to n."""
    out = candidates.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out if n is None else out.where(F.col("new_rank") <= n)


def passthrough(candidates: DataFrame, n: int | None = None) -> DataFrame:
    return by_order(candidates, [F.col("rag_rank")], n)


def degraded(candidates: DataFrame, n: int, name: str = "external_degraded") -> DataFrame:
    """What stands in for a scorer that fails: the retrieval score."""
    return by_order(candidates, [F.desc("score"), F.col("rag_rank")], n).withColumn("reranker", F.lit(name))


def judged(candidates: DataFrame, score: str, n: int | None = None) -> DataFrame:
    return by_order(candidates, [F.desc(score), F.col("candidate_id")], n)


def index_mapped(candidates: DataFrame, results: DataFrame, n: int) -> DataFrame:
    """Ranks by an external scorer's results (query_id, index from 0, relevance).

    Results whose index is of no candidate drop; a missing score is 0; candidates without a result follow with score 0
    in their old order. Of several results for a candidate the best counts.
    """
    r = results.groupBy("query_id", "index").agg(F.max(F.coalesce("relevance", F.lit(0.0))).alias("relevance"))
    keyed = candidates.withColumn("index", F.col("rag_rank") - 1)
    both = keyed.join(r, ["query_id", "index"], "left").withColumn("padded", F.col("relevance").isNull())
    out = both.withColumn("new_score", F.coalesce("relevance", F.lit(0.0)))
    return by_order(out, [F.col("padded"), F.desc("new_score"), F.col("rag_rank")], n).drop("index", "relevance")


def by_text(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Results that name a document by its text instead of its index (query_id, text, relevance) as results by index.

    A text is its query's first candidate with just this text; results of other texts, and null texts, drop.
    """
    first = candidates.where(F.col("text").isNotNull()).groupBy("query_id", F.sha2("text", 256).alias("said")).agg((F.min("rag_rank") - 1).alias("index"))
    asked = results.where(F.col("text").isNotNull()).select("query_id", F.sha2("text", 256).alias("said"), "relevance")
    return asked.join(first, ["query_id", "said"]).select("query_id", "index", "relevance")


def _letters(text: str | None) -> frozenset[str]:
    return frozenset(c for c in (text or "").lower() if c.isalpha() or c.isdecimal())


def jaccard(a: str | None, b: str | None, sets: tuple[frozenset, frozenset] | None = None) -> float:
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    x, y = sets or (_letters(a), _letters(b))
    return len(x & y) / len(x | y) if x or y else 0.0


def mmr_order(texts: list[str | None], scores: list[float], k: int, lam: float = LAMBDA, first: str = "best") -> list[int]:
    """Places in the order of choice: relevance less likeness to what is chosen; ties go to the earlier place."""
    n = len(texts)
    if n <= k:
        return list(range(n))
    sets = [_letters(t) for t in texts]
    start = max(range(n), key=lambda i: (scores[i], -i)) if first == "best" else 0
    chosen, like = [start], [jaccard(texts[i], texts[start], (sets[i], sets[start])) for i in range(n)]
    left = [i for i in range(n) if i != start]
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (lam * scores[i] - (1 - lam) * like[i], -i))
        chosen.append(best)
        left.remove(best)
        like = [max(like[i], jaccard(texts[i], texts[best], (sets[i], sets[best]))) for i in range(n)]
    return chosen


def mmr(candidates: DataFrame, k: int, lam: float = LAMBDA, first: str = "best", json_aware: bool = False) -> DataFrame:
    """Greedy choice per query over its bounded candidates (a few times k): query_id, candidate_id, score, new_rank."""
    text = case_text(F.col("text")) if json_aware else F.col("text")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("rag_rank").reset_index(drop=True)
        order = mmr_order(g["text"].where(g["text"].notna(), None).tolist(), g["score"].tolist(), k, lam, first)
        out = g.loc[order, ["query_id", "candidate_id", "score"]]
        out["new_rank"] = range(1, len(out) + 1)
        return out

    return candidates.select("query_id", "candidate_id", "rag_rank", "score", text.alias("text")).groupBy("query_id").applyInPandas(choose, "query_id long, candidate_id long, score double, new_rank int")


def two_stage(candidates: DataFrame, external: DataFrame | None, n: int, lam: float = LAMBDA) -> DataFrame:
    """3n candidates by score, n of them by MMR, then an external scorer's order of those (none for a query: MMR's). The scorer is
    given the first EXTERNAL_MOST of them; what it says of others doesn't count.

    ``external``: query_id, candidate_id, relevance.
    """
    wide = by_order(candidates, [F.desc("score"), F.col("rag_rank")], OVERFETCH * n).drop("new_rank")
    diverse = mmr(wide, n, lam)
    if external is None:
        return diverse.withColumn("reranker", F.lit("mmr"))
    both = diverse.withColumnRenamed("new_rank", "mmr_rank").join(external.select("query_id", "candidate_id", "relevance"), ["query_id", "candidate_id"], "left")
    both = both.withColumn("relevance", F.when(F.col("mmr_rank") <= EXTERNAL_MOST, F.col("relevance")))
    any_ = F.max("relevance").over(Window.partitionBy("query_id"))
    ranked = by_order(both, [F.desc(F.coalesce("relevance", F.lit(-1.0))), F.col("mmr_rank")], n)
    return ranked.withColumn("reranker", F.when(any_.isNull(), "mmr").otherwise("external")).select("query_id", "candidate_id", "score", "new_rank", "reranker")


def cache_key(query: Column, candidate_id: Column, model: Column, version: str = PROMPT_VERSION) -> Column:
    """The key of a judgement in the cache: a hash of all that it depends on; nulls count as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (query, candidate_id, model)]
    return F.sha2(F.concat_ws("|", *parts, F.lit(version)), 256)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` (query, candidate_id, model, ...) with ``body`` and ``hit``; a body that is no JSON object is a miss.

    ``cache``: key, body, written_at. Of several bodies with a key the last written counts.
    """
    last = cache.groupBy("key").agg(F.max_by("body", F.struct("written_at", "body")).alias("body"))
    keyed = requests.withColumn("key", cache_key(F.col("query"), F.col("candidate_id"), F.col("model")))
    hit = F.json_object_keys("body").isNotNull()
    return keyed.join(last, "key", "left").withColumn("hit", hit).withColumn("body", F.when(hit, F.col("body")))


def cache_rows(judged: DataFrame) -> DataFrame:
    """What is appended to the cache for new judgements (query, candidate_id, model, body, written_at)."""
    return judged.select(cache_key(F.col("query"), F.col("candidate_id"), F.col("model")).alias("key"), "body", "written_at")


def cache_rate(looked_up: DataFrame) -> DataFrame:
    """One row: hits, misses and their rate, 0 without requests."""
    counts = looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return counts.withColumn("hit_rate", F.when(total > 0, F.col("hits") / total).otherwise(0.0))
