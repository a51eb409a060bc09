"""Verdict class per claim, without expanding every minimal set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bridges import bridge_links
from .setcover import MAX_SIZE, Mask, full_masks, minimum_sizes, paper_masks


def connected_support(sizes: DataFrame, masks: DataFrame, full: DataFrame, bridges: DataFrame) -> DataFrame:
    """Strongest connection over all minimal sets: ``(audit_id, support)`` rows.

    Starts from the bridges instead of the sets. Two works: their masks must
    cover the claim. Three works: two links share a hub; neighbours of a hub are
    reduced to distinct masks first, so a hub with very many neighbours costs no
    more than the number of masks. Masks of a smallest set always differ, so
    distinct masks imply distinct works.
    """
    links = bridge_links(bridges)
    target = sizes.join(full.select("audit_id", "full"), "audit_id")
    of = masks.select("audit_id", "paper_id", "mask")
    ends = links.join(of.select("audit_id", F.col("paper_id").alias("a"), F.col("mask").alias("mask_a")), ["audit_id", "a"]).join(
        of.select("audit_id", F.col("paper_id").alias("b"), F.col("mask").alias("mask_b")), ["audit_id", "b"]
    )
    ends = cut_lineage(ends)  # only links between useful candidates are left
    plain = ends.filter(F.size("endpoints") == 2)
    two = plain.join(target.filter("size = 2"), "audit_id").filter(Mask.union(F.col("mask_a"), F.col("mask_b")) == F.col("full")).select("audit_id", "support")

    half = plain.select("audit_id", "support", F.col("a").alias("hub"), F.col("mask_a").alias("hub_mask"), F.col("mask_b").alias("mask")).unionByName(
        plain.select("audit_id", "support", F.col("b").alias("hub"), F.col("mask_b").alias("hub_mask"), F.col("mask_a").alias("mask"))
    )
    half = half.join(target.filter("size = 3"), "audit_id").select("audit_id", "support", "hub", "hub_mask", "mask", "full").distinct()
    pair = half.join(half.select("audit_id", "support", "hub", F.col("mask").alias("other")), ["audit_id", "support", "hub"])
    three = pair.filter(Mask.union(Mask.union(F.col("hub_mask"), F.col("mask")), F.col("other")) == F.col("full")).select("audit_id", "support")

    # a three-work bridge shows up as its three pairs, with all masks known
    wide = ends.filter(F.size("endpoints") == 3).groupBy("audit_id", "support", "endpoints").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(Mask.union(F.col("mask_a"), F.col("mask_b")))))).alias("m"), F.count("*").alias("n")
    ).filter("n = 3")
    wide = wide.join(target.filter("size = 3"), "audit_id").filter("m = full").select("audit_id", "support")
    return two.unionByName(three).unionByName(wide).distinct()


def classify(audits: DataFrame, facets: DataFrame, papers: DataFrame, coverage: DataFrame, bridges: DataFrame, strict: bool = True, max_size: int = MAX_SIZE) -> DataFrame:
    """``(audit_id, size, classification)`` for every row of ``audits``.

    ``audits`` may carry ``unresolved``; such claims stay INCONCLUSIVE.
    """
    masks = paper_masks(facets, papers, coverage, strict)
    full = full_masks(facets)
    sizes = cut_lineage(minimum_sizes(masks.select("audit_id", "mask").distinct(), full, ["audit_id"], max_size))
    support = connected_support(sizes, masks, full, bridges).groupBy("audit_id").agg(F.bool_or(F.col("support") == "TEXTUAL").alias("textual"))
    unresolved = F.coalesce(F.col("unresolved"), F.lit(False)) if "unresolved" in audits.columns else F.lit(False)
    row = audits.select("audit_id", unresolved.alias("_u")).join(sizes, "audit_id", "left").join(support, "audit_id", "left")
    label = (
        F.when(F.col("_u"), "INCONCLUSIVE")
        .when(F.col("size").isNull(), "RESIDUAL_NOVELTY")
        .when(F.col("size") == 1, "DIRECT_PRECEDENT")
        .when(F.col("textual"), "STRONG_COMPOSITION_RISK")
        .when(F.col("textual").isNotNull(), "PLAUSIBLE_COMPOSITION_RISK")
        .otherwise("FRAGMENTED_PRECEDENT")
    )
    explanation = F.when(
        F.col("size").isNull(),
        F.lit(f"No qualifying evidence-bound prior set of size {max_size} or smaller was found. This does not assess larger combinations."),
    )
    return row.select(
        "audit_id", F.col("size").cast("bigint").alias("size"), label.alias("classification"), explanation.alias("no_result_explanation"),
        F.lit(max_size).alias("search_bound"), F.lit(False).alias("larger_combinations_assessed"),
    )
