"""Identifier checks against an authority and bibliography matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import title_key


def verify_identifiers(papers: DataFrame, authority: DataFrame, outages: DataFrame) -> DataFrame:
    """One check row per identifier of every paper.

    ``authority(type, identifier, resolved_identifier)`` holds what the DOI and
    arXiv registries answer; ``outages(type, identifier)`` the lookups that
    failed. An identifier nobody knows counts as a failed lookup.
    """
    wanted = papers.select(
        "audit_id", F.col("id").alias("paper_id"),
        F.explode(F.array(F.struct(F.lit("DOI").alias("type"), ids.doi_key("doi").alias("identifier")), F.struct(F.lit("ARXIV").alias("type"), ids.arxiv_key("arxiv_id").alias("identifier")))).alias("i"),
    ).select("audit_id", "paper_id", "i.type", "i.identifier").filter("identifier IS NOT NULL")
    is_doi = F.col("type") == "DOI"

    def keyed(c: str) -> Column:
        return F.when(is_doi, ids.doi_key(c)).otherwise(ids.arxiv_key(c))

    known = authority.select("type", keyed("identifier").alias("identifier"), keyed("resolved_identifier").alias("resolved_identifier")).dropDuplicates(["type", "identifier"])
    down = outages.select("type", keyed("identifier").alias("identifier"), F.lit(True).alias("_down")).distinct()
    out = wanted.join(known.withColumn("_known", F.lit(True)), ["type", "identifier"], "left").join(down, ["type", "identifier"], "left")
    failed = F.col("_down").isNotNull() | F.col("_known").isNull()
    valid = ~failed & F.coalesce(F.col("resolved_identifier") == F.col("identifier"), F.lit(False))
    return out.select(
        "audit_id", "paper_id", "type", "identifier", F.when(F.col("type") == "DOI", "crossref").otherwise("arxiv").alias("provider"), valid.alias("valid"),
        F.when(~failed, F.col("resolved_identifier")).alias("resolved_identifier"),
        F.when(failed, "PROVIDER_FAILURE").when(~valid, "IDENTIFIER_MISMATCH").alias("error_code"),
    )


def verification_status(audits: DataFrame, checks: DataFrame) -> DataFrame:
    """``(audit_id, status)``: a failed lookup means PARTIAL even when others are invalid."""
    per = checks.groupBy("audit_id").agg(
        F.when(F.bool_or(F.coalesce(F.col("error_code") == "PROVIDER_FAILURE", F.lit(False))), "PARTIAL").when(F.bool_or(~F.col("valid")), "FAILED").otherwise("COMPLETE").alias("status")
    )
    return audits.select("audit_id").join(per, "audit_id", "left").withColumn("status", F.coalesce("status", F.lit("COMPLETE")))


def reproduce_bibliography(entries: DataFrame, papers: DataFrame) -> DataFrame:
    """Re-derive every declared bibliography match from its raw entry.

    ``entries(audit_id, pos, raw_entry, matched_paper_id, match_basis)``. Adds
    ``known`` (the paper exists) and ``reproduced``. MANUAL is never reproduced.
    """
    facts = papers.select("audit_id", F.col("id").alias("matched_paper_id"), "title", "authors", F.col("year").cast("string").alias("year"), "doi", "arxiv_id", F.lit(True).alias("_known"))
    row = entries.join(facts, ["audit_id", "matched_paper_id"], "left")
    raw = F.coalesce("raw_entry", F.lit(""))
    dois = F.transform(F.regexp_extract_all(raw, F.lit(ids.BIBLIOGRAPHY_DOI), F.lit(0)), lambda d: ids.doi_key(d))
    arxivs = F.transform(F.regexp_extract_all(raw, F.lit(ids.BIBLIOGRAPHY_ARXIV), F.lit(1)), lambda a: ids.arxiv_key(a))
    row = row.withColumn("_raw", title_key(raw)).withColumn("_title", title_key("title")).withColumn("_surnames", ids.surnames(F.col("authors")))
    years = F.regexp_extract_all(raw, F.lit(r"\b(?:18|19|20)\d{2}\b"), F.lit(0))
    has_authors = F.size(F.coalesce("_surnames", F.array().cast("array<string>"))) > 0
    author_ok = ~has_authors | F.arrays_overlap("_surnames", F.split("_raw", " "))
    year_ok = (F.size(years) == 0) | F.col("year").isNull() | F.col("year").isin("", "0") | F.array_contains(years, F.col("year"))
    by_title = (F.col("_title") != "") & F.col("_raw").contains(F.col("_title")) & author_ok & year_ok
    reproduced = (
        F.when(F.col("match_basis") == "DOI", F.array_contains(dois, ids.doi_key("doi")))
        .when(F.col("match_basis") == "ARXIV_ID", F.array_contains(arxivs, ids.arxiv_key("arxiv_id")))
        .when(F.col("match_basis") == "TITLE_AUTHOR", by_title)
    )
    known = F.col("_known").isNotNull()
    return row.select(*entries.columns, known.alias("known"), (known & F.coalesce(reproduced, F.lit(False))).alias("reproduced"))


def bibliography_status(papers: DataFrame, audits: DataFrame, listed: DataFrame) -> DataFrame:
    """``(audit_id, paper_id, bibliography_status)``; ``audits`` carry ``bibliography_status``,
    ``listed(audit_id, paper_id)`` are the normalised bibliography ids."""
    out = papers.join(audits.select("audit_id", F.col("bibliography_status").alias("_b")), "audit_id", "left")
    out = out.join(listed.select("audit_id", "paper_id", F.lit(True).alias("_in")).distinct(), ["audit_id", "paper_id"], "left")
    label = F.when(~F.coalesce(F.col("_b") == "PROVIDED", F.lit(False)), "BIBLIOGRAPHY_UNAVAILABLE").when(F.col("_in").isNotNull(), "IN_BIBLIOGRAPHY").otherwise("NOT_IN_BIBLIOGRAPHY")
    return out.withColumn("expected_status", label).drop("_b", "_in")
