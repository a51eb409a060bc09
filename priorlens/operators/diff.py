"""What changed between two snapshots of the same audits, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAPER_FIELDS = ("title", "doi", "arxiv_id", "providers", "dates", "references")
VERDICT_FIELDS = ("classification", "novelty_risk", "search_coverage", "evidence_confidence")


def diff_papers(before: DataFrame, after: DataFrame, fields: tuple[str, ...] = PAPER_FIELDS) -> DataFrame:
    """``(audit_id, id, change, fields)`` with change ADDED, REMOVED or CHANGED."""
    key = ["audit_id", "id"]
    a = before.select(*key, F.struct(*fields).alias("a"))
    b = after.select(*key, F.struct(*fields).alias("b"))
    both = a.join(b, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(F.size(changed) > 0, "CHANGED")
    out = both.select(*key, change.alias("change"), F.when(change == "CHANGED", changed).alias("fields"))
    return out.filter("change IS NOT NULL")


def diff_queries(before: DataFrame, after: DataFrame) -> DataFrame:
    key = ["audit_id", "query_id"]
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("ADDED")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("REMOVED")))


def diff_verdicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per audit and verdict field that differs."""
    def long(df: DataFrame, side: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(side)) for f in VERDICT_FIELDS])
        return df.select("audit_id", F.explode(pairs).alias("p")).select("audit_id", "p.*")

    both = long(before, "before").join(long(after, "after"), ["audit_id", "field"], "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def change_causes(audits: DataFrame, papers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Literature changes outrank reasoning changes."""
    lit = papers.select("audit_id").distinct().withColumn("_lit", F.lit(True))
    rea = verdicts.select("audit_id").distinct().withColumn("_rea", F.lit(True))
    out = audits.select("audit_id").join(lit, "audit_id", "left").join(rea, "audit_id", "left")
    cause = F.when(F.col("_lit").isNotNull(), "LITERATURE_SNAPSHOT_CHANGE").when(F.col("_rea").isNotNull(), "MODEL_OR_REASONING_CHANGE").otherwise("NO_MATERIAL_CHANGE")
    return out.select("audit_id", cause.alias("change_cause"))
