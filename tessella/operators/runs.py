"""Test runs: latest attempts, roll-ups, status and reports, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("run_id", "case_id")
# Fixed values.
CONTENT_TYPES = ("image/png", "image/jpeg", "image/jpg", "application/json", "text/plain")
ARTIFACT_TYPES = ("SCREENSHOT", "DOM", "A11Y", "CONSOLE", "NETWORK", "TRACE", "OTHER")
MAX_ARTIFACT = 50 << 20


def latest(attempts: DataFrame, *more: str) -> DataFrame:
    """The last attempt of each case of each run, by number and then outcome: an aggregate with partial maxima, no sort."""
    cols = ["attempt_number", "outcome", *more]
    return attempts.groupBy(*KEYS).agg(F.max_by(F.struct(*cols), F.struct("attempt_number", "outcome")).alias("a"), F.count(F.lit(1)).alias("n_attempts")).select(*KEYS, "a.*", "n_attempts")


def number_attempts(new: DataFrame, existing: DataFrame, order: list[Column]) -> DataFrame:
    """Numbers new attempts on from each case's largest number."""
    before = existing.groupBy(*KEYS).agg(F.max("attempt_number").alias("last"))
    i = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))
    return new.join(before, list(KEYS), "left").withColumn("attempt_number", i + F.coalesce("last", F.lit(0))).drop("last")


def rollup(attempts: DataFrame) -> DataFrame:
    """Counts of latest outcomes per run: the latest of each case, then the counts, in one pass each."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return latest(attempts).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_cases"), count("PASSED").alias("passed"), count("FAILED").alias("failed"), count("BLOCKED").alias("blocked"))


def overall_outcome() -> Column:
    """FAIL with any failure, PASS if only passed, ERROR with any blocked case, UNKNOWN without a case."""
    failed, passed, blocked = F.col("failed"), F.col("passed"), F.col("blocked")
    return F.when(failed > 0, "FAIL").when((passed > 0) & (blocked == 0), "PASS").when(blocked > 0, "ERROR").otherwise("UNKNOWN")


def new_run(key: Column) -> list[Column]:
    """A run's id, from a key that is its own, and its counters."""
    zero = [F.lit(0).alias(c) for c in ("passed", "failed", "blocked")]
    return [F.concat(F.lit("run-"), F.substring(F.sha2(key, 256), 1, 12)).alias("run_id"), F.lit("PENDING").alias("status"), *zero]


def run_times(updates: DataFrame, key: str = "run_id") -> DataFrame:
    """``started_at`` and ``completed_at`` of each run from its updates (key, at, status): the first of each stays.

    A run starts with its first RUNNING or COMPLETED and ends with its first COMPLETED.
    """
    first = lambda *states: F.min(F.when(F.col("status").isin(*states), F.col("at")))
    return updates.groupBy(key).agg(first("RUNNING", "COMPLETED").alias("started_at"), first("COMPLETED").alias("completed_at"))


def run_status(total: Column, variant: str = "recorded") -> Column:
    """RUNNING until every case has an attempt; then FAILED if none passed, else COMPLETED. ``executor`` never fails."""
    done = F.col("n_cases") >= total
    bad = F.lit(False) if variant == "executor" else (F.col("failed") + F.col("blocked")) == total
    return F.when(~done, "RUNNING").when(bad, "FAILED").otherwise("COMPLETED")


def case_outcome(steps: Column, assertions: Column) -> Column:
    """PASSED if all steps and assertions passed; both are arrays with a field ``passed``."""
    ok = lambda x: x["passed"]
    return F.when(F.forall(steps, ok) & F.forall(assertions, ok), "PASSED").otherwise("FAILED")


def first_failure(steps: Column) -> Column:
    return F.try_element_at(F.filter(steps, lambda s: ~s["passed"]), F.lit(1))["message"]


def history(attempts: DataFrame) -> DataFrame:
    """Attempts of each case in order."""
    return attempts.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("attempt_number", "outcome"))).alias("history"))


def report(runs: DataFrame, attempts: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Run, case, latest attempt and latest diagnosis of it: two joins instead of a query per case."""
    newest = diagnoses.groupBy(*KEYS, "attempt_number").agg(F.max_by(F.struct("category", "summary"), "diagnosis_id").alias("d"))
    flat = runs.join(latest(attempts, "duration_ms"), "run_id", "left").join(newest, [*KEYS, "attempt_number"], "left")
    return flat.select(*runs.columns, "case_id", "attempt_number", "outcome", "duration_ms", "n_attempts", F.col("d.category").alias("category"), F.col("d.summary").alias("summary"))


def validate_artifact(size: Column, content_type: Column) -> Column:
    """Why an artifact is refused; null if it is not."""
    return F.when(size > MAX_ARTIFACT, "too large").when(~content_type.isin(*CONTENT_TYPES) | content_type.isNull(), "content type not allowed")


def artifact_type(name: Column) -> Column:
    return F.when(F.upper(name).isin(*ARTIFACT_TYPES), F.upper(name)).otherwise("OTHER")


def artifact_path(run_id: Column, case_id: Column, attempt: Column, artifact_id: Column) -> Column:
    """Made from ids only; a file's own name is never part of it."""
    safe = lambda c: F.regexp_replace(c.cast("string"), r"[^A-Za-z0-9_-]", "_")
    return F.concat_ws("/", safe(run_id), safe(case_id), F.coalesce(attempt, F.lit(0)).cast("string"), safe(artifact_id))


def admit_cases(requested: DataFrame, cases: DataFrame) -> DataFrame:
    """For each requested case why it can't run: missing, not adopted, or not a web case; null if it can."""
    found = requested.join(cases.select("case_id", "status", "case_type"), "case_id", "left")
    why = F.when(F.col("status").isNull(), "missing").when(F.col("status") != "ADOPTED", "not adopted").when(F.col("case_type") != "WEB_FUNCTIONAL", "not a web case")
    return found.withColumn("refused", why)
