"""Retrieval and audit metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_cases(gold: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold and prediction rows of the same case, and the cases only one side has."""
    both = gold.join(predictions, "case_id")
    a, b = gold.select("case_id"), predictions.select("case_id")
    lost = a.join(b, "case_id", "left_anti").withColumn("side", F.lit("gold")).unionByName(b.join(a, "case_id", "left_anti").withColumn("side", F.lit("prediction")))
    return both, lost.withColumn("reason", F.lit("cases of annotations and predictions differ"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))


def recall_at_k(cases: DataFrame, k: int = 5, gold: str = "bibliography_absent_gold", ranked: str = "ranked_papers") -> DataFrame:
    """Micro-averaged recall of gold works among the first ``k`` ranked ones."""
    g = F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    hit = F.size(F.array_intersect(g, F.slice(F.coalesce(ranked, F.array().cast("array<string>")), 1, k)))
    return cases.agg(_share(F.sum(hit), F.sum(F.size(g))).alias("recall"))


def mean_reciprocal_rank(cases: DataFrame, gold: str = "gold", ranked: str = "ranked_papers") -> DataFrame:
    """Mean of 1 / rank of the first gold work; a case without a hit counts as 0."""
    first = F.array_min(F.filter(F.transform(ranked, lambda p: F.when(F.array_contains(gold, p), F.array_position(ranked, p))), lambda n: n.isNotNull()))
    return cases.agg(F.coalesce(F.avg(F.coalesce(1.0 / first, F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def ranked_recall_at_k(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Recall@k from long tables ``ranked(case_id, rank, paper_id)`` and ``gold(case_id, paper_id)``."""
    g = gold.select("case_id", "paper_id").distinct()
    hits = g.join(ranked.filter(F.col("rank") <= k).select("case_id", "paper_id"), ["case_id", "paper_id"], "left_semi")
    return g.agg(F.count("*").alias("g")).crossJoin(hits.agg(F.count("*").alias("h"))).select(_share(F.col("h"), F.col("g")).alias("recall"))


def ranked_mrr(cases: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """MRR from long tables; ``cases(case_id)`` fixes the denominator."""
    hit = ranked.join(gold.select("case_id", "paper_id").distinct(), ["case_id", "paper_id"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("r"))
    return cases.select("case_id").join(hit, "case_id", "left").agg(F.coalesce(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def temporal_leakage(verdict_papers: DataFrame) -> DataFrame:
    leaked = F.count_if(~F.col("cutoff_status").eqNullSafe(F.lit("ELIGIBLE")))
    return verdict_papers.agg(_share(leaked, F.count("*")).alias("leakage"))


def set_recall(predicted: DataFrame, gold: DataFrame, column: str = "paper_ids") -> DataFrame:
    """Share of distinct gold sets that were predicted, order ignored."""
    def sets(df: DataFrame) -> DataFrame:
        return df.select(F.array_sort(F.array_distinct(column)).alias("s")).distinct()

    g = sets(gold)
    hit = g.join(sets(predicted), "s", "left_semi")
    return g.agg(F.count("*").alias("g")).crossJoin(hit.agg(F.count("*").alias("h"))).select(_share(F.col("h"), F.col("g")).alias("set_recall"))


def supported_claim_rate(claims: DataFrame) -> DataFrame:
    supported = F.count_if(F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) > 0)
    return claims.agg(_share(supported, F.count("*")).alias("supported_rate"))
