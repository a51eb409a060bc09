"""Whole-record normalisation (one projection, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..schemas import AUTHORS, PAPER_TYPES, RAW_EXTRA_TYPES, shaped


def _known(c: Column) -> Column:
    return F.when(c != "", c)


def _external(*keys: str) -> Column:
    return F.coalesce(*[_known(F.try_element_at("external_ids", F.lit(k))) for k in keys])


def normalize_papers(records: DataFrame, provider: str | None = None, exact: bool = False) -> DataFrame:
    """Provider-neutral paper records.

    ``exact`` switches identifier and title folding to full NFKC (Arrow function).
    The version parsed from the identifier wins over a supplied one (>= 1).
    """
    raw = shaped(records, {**PAPER_TYPES, **RAW_EXTRA_TYPES})
    arxiv = ids.arxiv_parts(F.coalesce(_known(F.col("arxiv_id")), _external("ArXiv", "arxiv")), exact)
    raw = raw.withColumn("_arxiv", arxiv)
    supplied = F.when(F.col("arxiv_version") >= 1, F.col("arxiv_version"))
    providers = ids.distinct_strings(F.col("providers"))
    provider_ids = F.coalesce(F.col("provider_ids"), F.create_map().cast("map<string,string>"))
    record_id = F.coalesce(_known(F.col("id")), _known(F.col("paper_id")), F.lit(""))
    if provider:
        providers = F.array_union(providers, F.array(F.lit(provider)))
        own = F.when(
            (record_id != "") & ~F.map_contains_key(provider_ids, F.lit(provider)),
            F.map_concat(provider_ids, F.create_map(F.lit(provider), record_id)),
        )
        provider_ids = F.coalesce(own, provider_ids)
    out = raw.select(
        "audit_id",
        "ordinal",
        record_id.alias("id"),
        text.squeeze(F.coalesce("title", F.lit(""))).alias("title"),
        text.title_key("title", exact).alias("title_normalized"),
        "abstract",
        ids.clean_names(F.col("authors")).cast(AUTHORS).alias("authors"),
        "year",
        "venue",
        ids.doi_key(F.coalesce(_known(F.col("doi")), _external("DOI", "doi")), exact).alias("doi"),
        F.col("_arxiv.base").alias("arxiv_id"),
        F.coalesce(F.col("_arxiv.version"), supplied).alias("arxiv_version"),
        F.coalesce("arxiv_latest_version_verified", F.lit(False)).alias("arxiv_latest_version_verified"),
        F.coalesce("arxiv_versions", F.array().cast(PAPER_TYPES["arxiv_versions"])).alias("arxiv_versions"),
        "url",
        providers.alias("providers"),
        provider_ids.alias("provider_ids"),
        F.coalesce("dates", F.array().cast(PAPER_TYPES["dates"])).alias("dates"),
        ids.distinct_strings(F.col("references")).alias("references"),
        ids.distinct_strings(F.col("found_by_query_ids")).alias("found_by_query_ids"),
        "citation_count",
        "open_access",
        ids.distinct_strings(F.col("fulltext_urls")).alias("fulltext_urls"),
        F.coalesce("raw_provenance", F.array().cast(PAPER_TYPES["raw_provenance"])).alias("raw_provenance"),
        "cluster_id",
    )
    key = ids.canonical_key(F.col("doi"), F.col("arxiv_id"), F.col("title"), F.col("authors"), F.col("year"))
    out = out.withColumn("canonical_key", key)
    out = out.withColumn("cluster_id", F.coalesce(_known(F.col("cluster_id")), F.col("canonical_key")))
    return out.select(*PAPER_TYPES)
