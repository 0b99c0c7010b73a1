"""Ranking metrics on long tables: ``rankings`` (query_id, candidate_id, rank, ...) and ``qrels`` (query_id, candidate_id, grade).

A grade of 2 or more is relevant. All metrics of all K come from one join and one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
RELEVANT, HIGHLY = 2, 3
#: Compared groups that a row holds.
GROUPS = 1_000


def graded(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """Rankings with grades; ``labelled`` tells a missing label from a grade of 0."""
    q = qrels.select("query_id", "candidate_id", F.col("grade").alias("label"))
    return rankings.join(q, ["query_id", "candidate_id"], "left").withColumn("labelled", F.col("label").isNotNull()).withColumn("grade", F.coalesce("label", F.lit(0))).drop("label")


def label_totals(qrels: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Per query: relevant and highly relevant labels, and the ideal gain at each K over all labels."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "candidate_id"))
    gain = F.col("grade") / F.log2(F.col("i") + 1.0)
    ideal = [F.sum(F.when((F.col("i") <= k) & (F.col("grade") > 0), gain).otherwise(0.0)).alias(f"idcg_{k}") for k in ks]
    return qrels.withColumn("i", place).groupBy("query_id").agg(F.count_if(F.col("grade") >= RELEVANT).alias("relevant"), F.count_if(F.col("grade") >= HIGHLY).alias("highly"), *ideal)


def metrics(rankings: DataFrame, qrels: DataFrame, ks: Sequence[int] = KS, group: Sequence[str] = ()) -> DataFrame:
    """Per query (and ``group``) and K: recall, precision, MRR, nDCG, false positive and negative rates and counts.

    Gains are linear. Without relevant labels recall, nDCG and the false negative rate are 0; an empty ranking has 0 everywhere
    (queries of ``qrels`` that no group ranks get a row as well). Unlabelled items are no false positives.
    """
    group = list(group)
    g = graded(rankings, qrels)
    base = label_totals(qrels, ks)
    if group:
        # each query meets every group; groups are dealt to rows of about GROUPS of them, whatever their number
        groups = rankings.select(*group).distinct()
        blocks = max(1, -(-groups.count() // GROUPS))
        packed = groups.select(F.pmod(F.xxhash64(*group), F.lit(blocks)).alias("group_block"), F.struct(*group).alias("group")).groupBy("group_block").agg(F.collect_list("group").alias("groups"))
        dealt = base.withColumn("group_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        base = dealt.join(packed, "group_block").select(*base.columns, F.inline("groups"))
    hit, top = F.col("grade") >= RELEVANT, lambda k: F.col("rank") <= k
    aggs = [F.count(F.lit(1)).alias("length")]
    for k in ks:
        aggs += [
            F.count_if(top(k) & hit).alias(f"hits_{k}"),
            F.min(F.when(top(k) & hit, F.col("rank"))).alias(f"first_{k}"),
            F.sum(F.when(top(k), F.col("grade") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}"),
            F.count_if(top(k) & F.col("labelled") & (F.col("grade") == 0)).alias(f"fp_{k}"),
            F.count_if(top(k) & (F.col("grade") >= HIGHLY)).alias(f"high_{k}"),
        ]
    counted = g.groupBy("query_id", *group).agg(*aggs)
    wide = base.join(counted, ["query_id", *group], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per_k = []
    for k in ks:
        length = F.least(F.lit(k), zero("length"))
        per_k.append(
            F.struct(
                F.lit(k).alias("k"),
                ratio(zero(f"hits_{k}"), F.col("relevant")).alias("recall"),
                ratio(zero(f"hits_{k}"), length).alias("precision"),
                F.coalesce(F.lit(1.0).cast("double") / F.col(f"first_{k}"), F.lit(0.0)).alias("mrr"),
                ratio(F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)), F.col(f"idcg_{k}")).alias("ndcg"),
                zero(f"fp_{k}").cast("long").alias("fp_count"),
                ratio(zero(f"fp_{k}"), length).alias("fp_rate"),
                (F.col("highly") - zero(f"high_{k}")).cast("long").alias("fn_count"),
                ratio(F.col("highly") - zero(f"high_{k}"), F.col("highly")).alias("fn_rate"),
            )
        )
    return wide.select("query_id", *group, F.inline(F.array(*per_k)))


def drop_rate(rankings: DataFrame, frozen: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
    """Per query the share of the frozen relevant candidates that the ranking lost (all of it, or its first k)."""
    have = frozen.join(qrels.where(F.col("grade") >= RELEVANT), ["query_id", "candidate_id"], "left").select("query_id", "candidate_id", F.col("grade").isNotNull().alias("relevant"))
    ranked = rankings.where(F.lit(True) if k is None else F.col("rank") <= k).select("query_id", "candidate_id", F.lit(True).alias("ranked")).distinct()
    both = have.join(ranked, ["query_id", "candidate_id"], "left")
    n, kept = F.count_if(F.col("relevant")), F.count_if(F.col("relevant") & F.coalesce("ranked", F.lit(False)))
    return both.groupBy("query_id").agg(F.when(n > 0, 1.0 - kept / n).otherwise(0.0).alias("drop_rate"))


def retrieval_failures(frozen: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per frozen query whether no relevant candidate was retrieved at all."""
    g = frozen.join(qrels, ["query_id", "candidate_id"], "left")
    return g.groupBy("query_id").agg((F.coalesce(F.max("grade"), F.lit(0)) < RELEVANT).alias("retrieval_failure"))


def macro(per_query: DataFrame, failures: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Means per group and K over queries without retrieval failure, 4 decimals, and how many those are."""
    ok = per_query.join(failures.where(~F.col("retrieval_failure")).select("query_id"), "query_id", "left_semi")
    names = ["recall", "precision", "mrr", "ndcg", "fp_rate", "fn_rate"]
    return ok.groupBy(*group, "k").agg(*[F.round(F.avg(n), 4).alias(n) for n in names], F.count(F.lit(1)).alias("queries"))


def error_classes(rankings: DataFrame, qrels: DataFrame, failures: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """How two groups of ``rankings`` (column ``grp``) compare query by query, every class counted."""
    hit = graded(rankings.where(F.col("grp").isin(a, b)), qrels).groupBy("query_id").agg(
        F.coalesce(F.bool_or((F.col("grp") == a) & (F.col("rank") <= k) & (F.col("grade") >= RELEVANT)), F.lit(False)).alias("a_ok"),
        F.coalesce(F.bool_or((F.col("grp") == b) & (F.col("rank") <= k) & (F.col("grade") >= RELEVANT)), F.lit(False)).alias("b_ok"),
    )
    a_ok, b_ok = F.coalesce("a_ok", F.lit(False)), F.coalesce("b_ok", F.lit(False))
    kind = F.when(F.col("retrieval_failure"), "retrieval_failure").when(a_ok & b_ok, "both_success").when(~a_ok & ~b_ok, "both_failure").when(a_ok, "a_only").otherwise("b_only")
    counts = failures.join(hit, "query_id", "left").select(kind.alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("queries"))
    names = counts.sparkSession.createDataFrame([(c,) for c in ("retrieval_failure", "both_success", "both_failure", "reranking_failure_only", "a_only", "b_only")], "name string")
    source = F.when(F.col("name") == "reranking_failure_only", "both_failure").otherwise(F.col("name"))
    return names.join(counts, source == F.col("class"), "left").select(F.col("name").alias("class"), F.coalesce("queries", F.lit(0)).cast("long").alias("queries"))


def rejection_rate(rankings: DataFrame, threshold: float) -> DataFrame:
    """Share of queries whose best score is below the threshold."""
    best = rankings.groupBy("query_id").agg(F.max("score").alias("best"))
    return best.agg(F.round(F.avg((F.col("best") < threshold).cast("int")), 6).alias("rejection_rate"), F.count(F.lit(1)).alias("queries"))


def markdown_report(macro_by_group: DataFrame, errors: DataFrame, environment: dict[str, str], by_type: DataFrame | None = None) -> str:
    """The report's text; only the small aggregated tables reach the driver."""
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"

    def matrix(rows, cols) -> list[str]:
        return [line(cols), line(["---"] * len(cols)), *[line([r[c] if r[c] is not None else "—" for c in cols]) for r in rows]]

    out = ["# Reranker evaluation", "", "## Environment", "", *matrix([{"key": k, "value": v} for k, v in environment.items()], ["key", "value"])]
    names = ["recall", "precision", "mrr", "ndcg", "fp_rate", "fn_rate"]
    long = macro_by_group.select("grp", "k", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))
    wide = long.withColumn("metric", F.concat_ws("@", "metric", "k")).groupBy("metric").pivot("grp").agg(F.first("value")).orderBy("metric")
    out += ["", "## Metrics", "", *matrix(wide.collect(), wide.columns), "", "## Errors", "", *matrix(errors.orderBy("class").collect(), errors.columns)]
    if by_type is not None:
        out += ["", "## By query type", "", *matrix(by_type.orderBy(*by_type.columns[:2]).collect(), by_type.columns)]
    return "\n".join(out) + "\n"
