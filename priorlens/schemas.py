"""Table schemas and closed value sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ddl(text: str) -> str:
    return " ".join(text.split())


AUTHORS = "array<struct<name:string,orcid:string,id:string>>"
DATES = "array<struct<value:string,source:string,url:string,verified:boolean>>"
ARXIV_VERSIONS = "array<struct<version:int,identifier:string,submitted_at:string,pdf_url:string,verified:boolean>>"
PROVENANCE = "array<struct<provider:string,provider_id:string>>"
STRINGS = "array<string>"

# Columns of a paper record, in order, with their types.
PAPER_TYPES = {
    "audit_id": "string",
    "ordinal": "bigint",
    "id": "string",
    "title": "string",
    "title_normalized": "string",
    "abstract": "string",
    "authors": AUTHORS,
    "year": "string",
    "venue": "string",
    "doi": "string",
    "arxiv_id": "string",
    "arxiv_version": "int",
    "arxiv_latest_version_verified": "boolean",
    "arxiv_versions": ARXIV_VERSIONS,
    "url": "string",
    "providers": STRINGS,
    "provider_ids": "map<string,string>",
    "dates": DATES,
    "references": STRINGS,
    "found_by_query_ids": STRINGS,
    "citation_count": "bigint",
    "open_access": "string",
    "fulltext_urls": STRINGS,
    "raw_provenance": PROVENANCE,
    "canonical_key": "string",
    "cluster_id": "string",
}

# Raw records may also carry these.
RAW_EXTRA_TYPES = {"paper_id": "string", "external_ids": "map<string,string>"}

TABLES = {
    "facets": "audit_id string, facet_id string, type string, text string, critical boolean, structural_critical boolean",
    "coverage": "audit_id string, paper_id string, facet_id string, status string, evidence_ids array<string>",
    "evidence": ddl("""audit_id string, id string, canonical_paper_id string, source_level string, evidence_kind string,
        supports array<string>, acquisition_id string, span string, location string, source string, retrieved_at string"""),
    "bridges": ddl("""audit_id string, type string, underlying_type string, provenance_type string, paper_ids array<string>,
        source_paper_id string, cutoff_status string, graph_verified boolean, text_verified boolean,
        evidence_ids array<string>, base_rate_status string, source_rechecked_as_candidate boolean,
        affects_historical_verdict boolean"""),
    "edges": "audit_id string, provider string, source_id string, target_raw string",
}

# Closed sets of labels.
HARD_COVERAGE = ("EXACT", "FUNCTIONAL")
TEXTUAL_BRIDGES = ("EXPLICIT_EXTENSION", "SHARED_BENCHMARK", "TAXONOMY_BRIDGE", "SYNTHESIS_BRIDGE", "COMBINATION_BRIDGE")
GRAPH_BRIDGES = ("DIRECT_CITATION", "CO_CITATION", "SHARED_DESCENDANT")
CLASSIFICATIONS = (
    "DIRECT_PRECEDENT", "STRONG_COMPOSITION_RISK", "PLAUSIBLE_COMPOSITION_RISK", "FRAGMENTED_PRECEDENT",
    "RESIDUAL_NOVELTY", "INCONCLUSIVE",
)
ADVERSE = ("DIRECT_PRECEDENT", "STRONG_COMPOSITION_RISK", "PLAUSIBLE_COMPOSITION_RISK")
NOVELTY_RISKS = ("HIGH", "MEDIUM", "LOW", "INCONCLUSIVE")
COVERAGE_LEVELS = ("BROAD", "MODERATE", "NARROW")
CONFIDENCES = ("STRONG", "MIXED", "WEAK")
EVIDENCE_LEVELS = ("TIER_1_METADATA", "TIER_2_FULLTEXT", "GRAPH", "DATE")
FULLTEXT_LEVEL = "TIER_2_FULLTEXT"
BIBLIOGRAPHY_STATUSES = ("IN_BIBLIOGRAPHY", "NOT_IN_BIBLIOGRAPHY", "BIBLIOGRAPHY_UNAVAILABLE")
MATCH_BASES = ("DOI", "ARXIV_ID", "TITLE_AUTHOR", "MANUAL", "NONE")
FAILURE_TYPES = ("RATE_LIMIT", "TIMEOUT", "HTTP_5XX", "MALFORMED_RESPONSE", "TRUNCATED", "AUTH", "OTHER")
REQUIRED_FAMILIES = ("ancestor", "composition_bridge", "literal", "mechanism", "problem_function")
PRIMARY_PROVIDERS = ("arxiv", "openalex", "semantic-scholar")
GRAPH_PROVIDERS = ("openalex", "semantic-scholar")
SATURATING_STOPS = ("PROVIDER_EXHAUSTED", "NO_NEW_RESULTS")
RISK_BASES = ("CRITICALITY_SENSITIVITY_COLLAPSE", "CRITICALITY_DISPUTE", "OTHER_EXPLICIT_RISK")
RISK_MATRIX = {
    "DIRECT_PRECEDENT": ("HIGH", "MEDIUM"),
    "STRONG_COMPOSITION_RISK": ("HIGH", "MEDIUM"),
    "PLAUSIBLE_COMPOSITION_RISK": ("HIGH", "MEDIUM"),
    "FRAGMENTED_PRECEDENT": ("HIGH", "MEDIUM", "LOW", "INCONCLUSIVE"),
    "RESIDUAL_NOVELTY": ("HIGH", "MEDIUM", "LOW"),
    "INCONCLUSIVE": ("INCONCLUSIVE",),
}
REPORT_VERSION = "0.3.2"
DEFAULT_CITATION_THRESHOLD = 500


def shaped(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Give ``df`` exactly the named columns; missing ones become typed nulls."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def struct_type(types: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in types.items()))
