"""Search protocol coverage: BROAD, MODERATE or NARROW with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PRIMARY_PROVIDERS, REQUIRED_FAMILIES, SATURATING_STOPS

SCOPE = "PROTOCOL_EXECUTION_NOT_RECALL"


def _listed(items: Column) -> Column:
    quoted = F.transform(items, lambda i: F.concat(F.lit("'"), i, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _reason(when: Column, text: str, items: Column | None = None) -> Column:
    return F.when(when, F.lit(text) if items is None else F.concat(F.lit(text + ": "), _listed(items)))


def derive_coverage(audits: DataFrame, runs: DataFrame, obligations: DataFrame) -> DataFrame:
    """``(audit_id, level, scope, successful_providers, successful_families, reasons)``.

    ``audits(audit_id, saturated)``; ``runs`` are search-run rows;
    ``obligations(audit_id, id, status)``. Two group-bys, one row per audit.
    """
    ok = F.col("status") == "ok"
    provider = F.replace(F.col("provider"), F.lit("semantic_scholar"), F.lit("semantic-scholar"))

    def ids(cond: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(cond, F.col("query_id"))))

    incomplete_row = (
        F.col("returned_count").isNull() | F.col("truncated").isNull() | F.col("pagination").isNull() | F.col("corpus").isNull() | F.col("saturation_stop_reason").isNull()
    )
    stopped = F.coalesce(F.col("saturation_stop_reason").isin(*SATURATING_STOPS), F.lit(False))
    per = runs.groupBy("audit_id").agg(
        F.count("*").alias("n"),
        F.collect_set(F.when(ok & (provider != ""), provider)).alias("tried"),
        F.collect_set(F.when(ok & (F.col("family") != ""), F.col("family"))).alias("families"),
        ids(~ok).alias("failed"),
        ids(F.coalesce("truncated", F.lit(False))).alias("cut"),
        ids(ok & ~stopped).alias("unsaturated"),
        ids(incomplete_row).alias("bare"),
        ids(ok & (F.col("provider") == "openalex") & ~F.coalesce(F.col("corpus") == "all", F.lit(False))).alias("partial_corpus"),
    )
    open_items = obligations.filter(~F.col("status").eqNullSafe(F.lit("COMPLETE"))).groupBy("audit_id").agg(F.array_sort(F.collect_list("id")).alias("open"))
    none = F.array().cast("array<string>")
    row = audits.select("audit_id", "saturated").join(per, "audit_id", "left").join(open_items, "audit_id", "left")
    for c in ("tried", "families", "failed", "cut", "unsaturated", "bare", "partial_corpus", "open"):
        row = row.withColumn(c, F.coalesce(c, none))
    primary = F.array(*[F.lit(p) for p in PRIMARY_PROVIDERS])
    required = F.array(*[F.lit(f) for f in REQUIRED_FAMILIES])
    row = row.withColumns(
        {
            "providers": F.array_sort(F.array_intersect("tried", primary)),
            "foreign": F.array_sort(F.array_except("tried", primary)),
            "missing": F.array_sort(F.array_except(required, F.col("families"))),
            "families": F.array_sort("families"),
        }
    )

    def some(c: str) -> Column:
        return F.size(c) > 0

    # The reasons are part of the output that audits are compared with.
    reasons = F.array_compact(
        F.array(
            _reason(F.size("providers") < 2, "fewer than two providers completed a query"),
            _reason(some("foreign"), "unsupported primary search providers", F.col("foreign")),
            _reason(some("missing"), "missing successful query families", F.col("missing")),
            _reason(some("failed"), "failed query runs", F.col("failed")),
            _reason(some("cut"), "truncated query runs", F.col("cut")),
            _reason(some("unsaturated"), "query runs lack a saturation stop", F.col("unsaturated")),
            _reason(some("open"), "incomplete search obligations", F.col("open")),
            _reason(some("bare"), "SearchRun metadata missing", F.col("bare")),
            _reason(some("partial_corpus"), "OpenAlex did not search corpus=all", F.col("partial_corpus")),
            _reason(~F.coalesce("saturated", F.lit(False)), "search saturation was not established"),
        )
    )
    row = row.withColumn("reasons", reasons)
    level = (
        F.when((F.size("reasons") == 0) & (F.col("n") > 0), "BROAD")
        .when((F.size("providers") >= 2) & (F.size("families") >= 3) & ~some("bare"), "MODERATE")
        .otherwise("NARROW")
    )
    return row.select(
        "audit_id", level.alias("level"), F.lit(SCOPE).alias("scope"), F.col("providers").alias("successful_providers"),
        F.col("families").alias("successful_families"), "reasons",
    )
