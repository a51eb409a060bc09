"""Shared pieces of the audit invariants."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from .. import bridges, setcover
from ..expansion import set_pairs

RULES: dict[str, Callable[["Context"], DataFrame]] = {}


def rule(name: str):
    def register(fn):
        RULES[name] = fn
        return fn

    return register


def strings(c: Column | str) -> Column:
    """The array, or an empty one."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


def blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def flags(df: DataFrame, entity: Column | str | None, *checks: tuple[Column, str]) -> DataFrame:
    """One violation row per failed check; all checks of a table in one pass."""
    key = F.lit(None) if entity is None else (F.col(entity) if isinstance(entity, str) else entity)
    found = F.array_compact(F.array(*[F.when(false_if_null(bad), F.lit(text)) for bad, text in checks]))
    return df.select("audit_id", key.cast("string").alias("entity_id"), F.explode(found).alias("detail"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def set_differences(submitted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows only one side has, with ``side`` MISSING or EXTRA."""
    s, e = submitted.select(*keys).distinct(), expected.select(*keys).distinct()
    return e.join(s, keys, "left_anti").withColumn("side", F.lit("MISSING")).unionByName(s.join(e, keys, "left_anti").withColumn("side", F.lit("EXTRA")))


# ------------------------------------------------------------------ date-times

_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def is_datetime(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$") & F.try_to_timestamp(c).isNotNull()


def before(a: Column | str, b: Column | str) -> Column:
    """``a`` earlier than ``b``; a value without a zone is read in the other's zone."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    both = a.rlike(_ZONE) & b.rlike(_ZONE)
    local = F.try_to_timestamp(F.regexp_replace(a, _ZONE, "")) < F.try_to_timestamp(F.regexp_replace(b, _ZONE, ""))
    return F.when(both, F.try_to_timestamp(a) < F.try_to_timestamp(b)).otherwise(local)


# ------------------------------------------------------------------ context


class Context:
    """Section tables plus everything that several rules recompute from them."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @cached_property
    def critical(self) -> DataFrame:
        return setcover.critical_facets(self.facets).select("audit_id", "facet_id")

    @cached_property
    def facet_kinds(self) -> DataFrame:
        return self.facets.select("audit_id", "facet_id", setcover.allowed_kinds(F.col("type")).alias("kinds")).dropDuplicates(["audit_id", "facet_id"])

    @cached_property
    def unique_papers(self) -> DataFrame:
        """One row per paper id; dates typed."""
        p = self.papers.dropDuplicates(["audit_id", "id"])
        return p.withColumn("earliest_public_date", F.try_to_date("earliest_public_date")).withColumn("cutoff", F.try_to_date("cutoff"))

    @cached_property
    def status(self) -> DataFrame:
        return self.unique_papers.select("audit_id", F.col("id").alias("paper_id"), "cutoff_status", "earliest_public_date")

    @cached_property
    def verified(self) -> DataFrame:
        return cut_lineage(setcover.verified_coverage(self.coverage, self.evidence.dropDuplicates(["audit_id", "id"]), self.facets.dropDuplicates(["audit_id", "facet_id"])))

    @cached_property
    def computed_sets(self) -> DataFrame:
        return cut_lineage(setcover.minimal_sets(self.facets, self.unique_papers, self.verified))

    @cached_property
    def computed_size(self) -> DataFrame:
        return self.computed_sets.groupBy("audit_id").agg(F.min("size").alias("computed_size"))

    @cached_property
    def edges(self) -> DataFrame:
        return self.unique_papers.select("audit_id", F.col("id").alias("source_id"), F.explode("references").alias("target_raw"))

    @cached_property
    def recomputed_bridges(self) -> DataFrame:
        pairs = set_pairs(self.computed_sets).select("audit_id", F.col("a").alias("paper_a"), F.col("b").alias("paper_b"))
        return cut_lineage(bridges.find_bridges(pairs, self.unique_papers, self.edges, self.audits.select("audit_id", "high_citation_threshold")))

    @cached_property
    def incomplete_pairs(self) -> DataFrame:
        from ..expansion import expansion_obligations

        return cut_lineage(expansion_obligations(self.computed_sets, self.expansions))

    @cached_property
    def has_gaps(self) -> DataFrame:
        return self.gaps.groupBy("audit_id").agg(F.count("*").alias("gap_count"))

    def audits_with(self, *sides: DataFrame) -> DataFrame:
        out = self.audits
        for side in sides:
            out = out.join(side, "audit_id", "left")
        return out


def expand(df: DataFrame, column: str, name: str, *keep: str) -> DataFrame:
    return df.select("audit_id", *keep, F.explode(column).alias(name))
