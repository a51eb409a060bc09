"""Audit invariants: every broken one becomes a row.

``violations(tables)`` returns ``(audit_id, rule, entity_id, detail)``. Each rule
is a small query over the section tables (see ``sources.reports``); rules that
recompute something share the result through one :class:`Context`. Audits whose
shape is broken (VAL-01) report only that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from . import document, evidence, expansions, prior_sets, search_log  # noqa: F401  (register the rules)
from .common import RULES, Context

RULES_AT_ONCE = 5


def violations(tables: dict[str, DataFrame], rules: list[str] | None = None, gate: bool = True) -> DataFrame:
    """All violations of the named rules (default: every rule).

    A few rules at a time make one plan, whose rows are stored: the recomputed
    sets and bridges are shared, and no plan grows with the number of rules.
    """
    context = Context(tables)
    names = sorted(RULES) if rules is None else sorted(rules)

    def found(name: str) -> DataFrame:
        return RULES[name](context).select("audit_id", F.lit(name).alias("rule"), F.col("entity_id").cast("string").alias("entity_id"), F.col("detail").cast("string").alias("detail"))

    def union(names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [found(n) for n in names])

    gated = gate and "VAL-01" in names
    rest = [n for n in names if not (gated and n == "VAL-01")]
    parts = [union(rest[i : i + RULES_AT_ONCE]) for i in range(0, len(rest), RULES_AT_ONCE)]
    parts = [cut_lineage(p) for p in parts] if len(parts) > 1 else parts
    if not gated:
        return reduce(DataFrame.unionByName, parts)
    shape = cut_lineage(found("VAL-01"))
    if not parts:
        return shape
    broken = shape.select("audit_id").distinct()
    return shape.unionByName(reduce(DataFrame.unionByName, parts).join(broken, "audit_id", "left_anti").select(*shape.columns))


def valid_audits(tables: dict[str, DataFrame]) -> DataFrame:
    """``(audit_id, valid, violation_count)`` for every audit."""
    n = violations(tables).groupBy("audit_id").agg(F.count("*").alias("violation_count"))
    out = tables["audits"].select("audit_id").join(n, "audit_id", "left").fillna(0, ["violation_count"])
    return out.withColumn("valid", F.col("violation_count") == 0)
