"""Report attempts: at most three tries per audit identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .hashes import identity_hash


def evaluate_attempts(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(attempts, rejects)`` of ``submissions(audit_id, claim_id, freeze_hash,
    cutoff, seq, max_attempts, valid, report_hash)``.

    Submissions of one identity are taken in ``seq`` order. The first usable one
    fixes the budget; later ones with another budget, or after the identity is
    COMPLETE or exhausted, are rejected and do not consume a try.
    """
    s = submissions.withColumn("identity", identity_hash(F.col("audit_id"), F.col("claim_id"), F.col("freeze_hash"), F.col("cutoff")))
    in_range = F.coalesce(F.col("max_attempts").between(1, 3), F.lit(False))
    # Submissions without an identity belong to no history and must not meet in one window.
    nameless = s.filter("identity IS NULL").withColumn("reason", F.when(~in_range, "attempt limit is not 1, 2 or 3").otherwise("report without identity"))
    s = s.filter("identity IS NOT NULL").withColumn("_usable", in_range)
    w = W.partitionBy("identity").orderBy("seq")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_budget", F.first(F.when(F.col("_usable"), F.col("max_attempts")), ignorenulls=True).over(upto))
    s = s.withColumn("_same", F.col("_usable") & (F.col("max_attempts") == F.col("_budget")))
    s = s.withColumn("attempt", F.count_if("_same").over(upto)).withColumn("_done", F.coalesce(F.bool_or(F.col("_same") & F.col("valid")).over(before), F.lit(False)))
    reason = (
        F.when(~in_range, "attempt limit is not 1, 2 or 3")
        .when(F.col("_done") | (F.col("attempt") > F.col("_budget")) | (~F.col("_same") & (F.col("attempt") >= F.col("_budget"))), "attempt after a final one")
        .when(~F.col("_same"), "attempt limit differs from the first one")
    )
    s = s.withColumn("reason", reason)
    last = F.col("attempt") == F.col("_budget")
    ok = s.filter("reason IS NULL").withColumns(
        {
            "status": F.when(F.col("valid"), "COMPLETE").when(last, "PARTIAL").otherwise("RETRY_REQUIRED"),
            "retry_exhausted": ~F.col("valid") & last,
            "conclusion_cap": F.when(F.col("valid"), "NONE").otherwise("INCONCLUSIVE"),
            "next_action": F.when(F.col("valid"), "EXPORT_MACHINE_BOUND_REPORT").when(last, "DISCLOSE_RETRY_EXHAUSTION_AND_RETURN_INCONCLUSIVE").otherwise("REPAIR_FROM_VALIDATION_ERRORS"),
        }
    )
    drop = ["_usable", "_budget", "_same", "_done"]
    return ok.drop(*drop, "reason"), s.filter("reason IS NOT NULL").drop(*drop, "attempt").unionByName(nameless)


def history_violations(history: DataFrame) -> DataFrame:
    """Identities whose stored history is not 1..n, continues after a valid try, or exceeds its budget.

    ``history(identity, attempt, valid, max_attempts)``.
    """
    per = history.groupBy("identity").agg(
        F.count("*").alias("n"), F.count_distinct("attempt").alias("d"), F.min("attempt").alias("lo"), F.max("attempt").alias("hi"),
        F.min(F.when(F.col("valid"), F.col("attempt"))).alias("won"), F.min("max_attempts").alias("b0"), F.max("max_attempts").alias("b1"),
    )
    reasons = F.array_compact(
        F.array(
            F.when((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")), "attempts are not numbered in order"),
            F.when(F.col("won") < F.col("hi"), "attempt after a final one"),
            F.when(F.col("b0") != F.col("b1"), "attempt limit differs from the first one"),
            F.when(F.col("hi") > F.col("b1"), "no attempts are left"),
        )
    )
    return per.select("identity", F.explode(reasons).alias("reason"))
