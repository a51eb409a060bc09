"""Nested audit documents as section tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ARXIV_VERSIONS, AUTHORS, DATES
from ..session import cut_lineage

# One field list per section; a section table is the section exploded by position.
PAPER = f"""id string, title string, year string, doi string, arxiv_id string, arxiv_version int, arxiv_latest_version_verified boolean, authors {AUTHORS}, providers array<string>,
 provider_ids map<string,string>, dates {DATES}, earliest_public_date string, cutoff string, cutoff_status string, `references` array<string>, found_by_query_ids array<string>, citation_count bigint,
 canonical_key string, cluster_id string, coverage map<string,struct<status:string,evidence_ids:array<string>>>,
 citation_validation array<struct<type:string,provider:string,valid:boolean,identifier:string>>"""
ACQUISITION = f"""id string, paper_id string, status string, source_url string, retrieved_at string, historical_cutoff string, arxiv_version int, arxiv_version_date string, version_lock string,
 version_selection_method string, arxiv_version_history {ARXIV_VERSIONS}, arxiv_version_history_complete boolean"""
EVIDENCE = """id string, canonical_paper_id string, source_level string, acquisition_id string, span string, location string, source string, retrieved_at string, evidence_kind string, supports array<string>"""
BRIDGE = """type string, underlying_type string, provenance_type string, paper_ids array<string>, source_paper_id string, cutoff_status string, graph_verified boolean, text_verified boolean,
 evidence_ids array<string>, base_rate_status string, source_rechecked_as_candidate boolean, affects_historical_verdict boolean"""
RUN = """query_id string, provider string, family string, query string, reason string, target_facets array<string>, removed_author_terms boolean, retrieved_at string, temporal_recall_backstop boolean,
 provider_cutoff_applied boolean, returned_count bigint, total_count bigint, truncated boolean, pagination string, corpus string, saturation_stop_reason string, paper_ids array<string>,
 canonical_paper_ids array<string>, status string"""
EXPANSION = """expansion_id string, status string, partial_reasons array<string>, provider string, providers array<string>, provider_selection string, omitted_providers array<string>, paper_ids array<string>,
 cutoff string, temporal_recall_backstop boolean, provider_cutoff_applied boolean, limit_per_call bigint, anchor_selection string,
 calls array<struct<provider:string,direction:string,anchor_paper_id:string,returned_count:bigint,limit:bigint,exhausted:boolean,next_token:string,provider_total:bigint,raw_examined_count:bigint,possibly_truncated:boolean>>,
 failures array<struct<provider:string,direction:string,anchor_paper_id:string,detail:string>>, bridge_candidate_ids array<string>, historical_bridge_candidate_ids array<string>,
 landscape_bridge_candidate_ids array<string>, endpoint_reference_observations array<struct<paper_id:string,provider_returned_count:bigint,status:string,provider_observations:array<struct<provider:string,returned_count:bigint,status:string>>>>,
 observation_window_days bigint, observation_window_status string, observation_window_threshold_days bigint, negative_result_scope string, discovered_paper_ids array<string>, new_paper_ids array<string>"""
SECTIONS = {
    "papers": PAPER,
    "fulltext_acquisitions": ACQUISITION,
    "evidence": EVIDENCE,
    "top_killers": "paper_id string, covers array<string>, does_not_cover array<string>, evidence_ids array<string>, bibliography_status string",
    "minimal_prior_sets": "paper_ids array<string>, size bigint, evidence_ids array<string>",
    "bridges": BRIDGE,
    "landscape_bridges": BRIDGE,
    "criticality_sensitivity": "removed_facet string, baseline_size bigint, alternative_size bigint, alternative_classification string",
    "ancestor_terms": "term string, admitted boolean, source_paper_id string, first_observed string, evidence_ids array<string>",
    "audit_log": "event string, at string, freeze_hash string",
}


def _array(fields: str) -> T.ArrayType:
    return T.ArrayType(T.StructType.fromDDL(fields))


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v if isinstance(v, T.DataType) else T.StructType.fromDDL(f"x {v}")[0].dataType) for k, v in fields.items()])


def report_schema() -> T.StructType:
    s, a = "string", "array<string>"
    return _struct(
        schema_version=s, audit_id=s, generated_at=s, candidate_ids=a, residual_novelty=s,
        run_manifest=_struct(
            tool_version=s, config_hash=s, cutoff=s, domain=s, model_name=s, prompt_version=s, retrieval_started_at=s, retrieval_completed_at=s, candidate_snapshot_hash=s,
            provider_endpoints=_array("name string, endpoint string, version string"), runtime_environment="struct<python_version:string,dependencies:struct<jsonschema:string,pypdf:string>>",
        ),
        input=_struct(claim=s, normalized_claim=s, field=s, cutoff=s, strict_date="boolean"),
        author_bibliography=_struct(status=s, source=s, entries=_array("raw_entry string, matched_paper_id string, match_basis string"), normalized_paper_ids=a, unmatched_entries=a),
        claim_map=_struct(claim_id=s, claim_text=s, normalized_claim=s, frozen_before_retrieval="boolean", frozen_at=s, freeze_hash=s, facets=_array("id string, type string, text string, critical boolean, structural_critical boolean")),
        verdict=_struct(
            classification=s, novelty_risk=s, search_coverage=s, evidence_confidence=s, decided_at=s, main_concern=s, evidence_ids=a, risk_basis=_array("type string, detail string, evidence_ids array<string>")
        ),
        **{k: _array(v) for k, v in SECTIONS.items()},
        defensible_rewrite=_struct(text=s, prior_coverage_claims=_array("text string, evidence_ids array<string>")),
        search=_struct(
            providers=_array("name string, status string"), query_families=a, query_runs=_array(RUN), graph_expansions=_array(EXPANSION), failures=_array("provider string, type string, detail string"), gaps=a,
            obligations=_array("id string, status string, detail string"),
            bridge_policy=_struct(status=s, high_citation_threshold="bigint", source=s, evidence="struct<dataset:string,method:string,preregistered:boolean>"),
            coverage_derivation="struct<level:string,scope:string,successful_providers:array<string>,successful_families:array<string>,reasons:array<string>>", saturated="boolean",
        ),
        excluded=_struct(post_cutoff=a, date_uncertain=a, other=a),
    )


def _rows(r: DataFrame, c: Column | str, name: str = "x") -> DataFrame:
    c = F.col(c) if isinstance(c, str) else c
    return r.select("audit_id", F.posexplode(c).alias("pos", name))


def _flat(r: DataFrame, c: Column | str) -> DataFrame:
    return _rows(r, c).select("audit_id", "pos", "x.*")


def _values(r: DataFrame, c: str, name: str) -> DataFrame:
    return _rows(r, c, name).drop("pos")


PAGE = """array<struct<page_index:int,returned_count:bigint,total_count:bigint,pagination:struct<start:bigint,raw_returned_count:bigint,eligible_returned_count:bigint,next:bigint>,paper_ids:array<string>>>"""


def report_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """Section tables of ``reports(audit_id, doc)``, where ``doc`` is the JSON text.

    The raw text stays next to the parsed form because hashes need it and
    because the shape check compares both. Documents are parsed once, into a
    nested table of which every section reads its own columns only.
    """
    r = cut_lineage(reports.select("audit_id", "doc", F.from_json("doc", report_schema()).alias("r")))
    reports = r.select("audit_id", "doc")
    raw_claim = F.get_json_object("doc", "$.claim_map")
    m, v, c, b, p = "r.run_manifest", "r.verdict", "r.claim_map", "r.author_bibliography", "r.search.bridge_policy"
    audits = r.select(
        "audit_id", "doc", F.col("r.audit_id").alias("report_audit_id"), "r.schema_version", "r.generated_at", "r.residual_novelty", F.col("r.input.claim").alias("input_claim"), "r.input.cutoff", "r.input.strict_date",
        f"{c}.claim_id", f"{c}.claim_text", f"{c}.frozen_before_retrieval", f"{c}.frozen_at", f"{c}.freeze_hash", raw_claim.alias("claim_map_json"),
        F.col(f"{m}.cutoff").alias("manifest_cutoff"), *[f"{m}.{k}" for k in ("tool_version", "config_hash", "domain", "model_name", "prompt_version", "retrieval_started_at", "retrieval_completed_at", "candidate_snapshot_hash")],
        f"{m}.runtime_environment.python_version", F.col(f"{m}.runtime_environment.dependencies.jsonschema").alias("jsonschema_version"), F.col(f"{m}.runtime_environment.dependencies.pypdf").alias("pypdf_version"),
        F.col(f"{b}.status").alias("bibliography_status"), *[f"{v}.{k}" for k in ("classification", "novelty_risk", "search_coverage", "evidence_confidence", "decided_at", "main_concern")], F.col(f"{v}.evidence_ids").alias("verdict_evidence_ids"),
        F.col("r.defensible_rewrite.text").alias("rewrite_text"), F.col("r.search.saturated").alias("saturated"), F.col("r.search.coverage_derivation").alias("coverage_derivation"), F.col(f"{p}.status").alias("policy_status"),
        f"{p}.high_citation_threshold", F.col(f"{p}.source").alias("policy_source"), F.col(f"{p}.evidence").alias("policy_evidence"),
    )
    papers = _flat(r, "r.papers").withColumnRenamed("pos", "ordinal")
    raw_papers = r.select("audit_id", F.posexplode(F.from_json(F.get_json_object("doc", "$.papers"), "array<string>")).alias("ordinal", "doc"))
    papers = papers.join(raw_papers, ["audit_id", "ordinal"], "left")
    runs = _flat(r, "r.search.query_runs")
    page = F.from_json(F.get_json_object("pagination", "$.pages"), PAGE)
    pages = runs.select("audit_id", "query_id", F.posexplode(page).alias("page_pos", "g")).select("audit_id", "query_id", "page_pos", "g.page_index", "g.returned_count", "g.total_count", "g.pagination.*", F.col("g.paper_ids").alias("paper_ids"))
    expansions = _flat(r, "r.search.graph_expansions")

    def of_expansion(field: str) -> DataFrame:
        return expansions.select("audit_id", F.col("pos").alias("expansion_pos"), "expansion_id", F.explode(field).alias("x")).select("audit_id", "expansion_pos", "expansion_id", "x.*")

    coverage = papers.select("audit_id", F.col("id").alias("paper_id"), F.explode("coverage").alias("facet_id", "e"))
    coverage = coverage.select("audit_id", "paper_id", "facet_id", F.upper(F.coalesce("e.status", F.lit("UNKNOWN"))).alias("status"), F.coalesce("e.evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))
    excluded = None
    for kind in ("post_cutoff", "date_uncertain", "other"):
        one = _values(r, f"r.excluded.{kind}", "paper_id").withColumn("kind", F.lit(kind))
        excluded = one if excluded is None else excluded.unionByName(one)
    return {
        "reports": reports,
        "audits": audits,
        "candidates": _values(r, "r.candidate_ids", "paper_id"),
        "papers": papers,
        "citation_checks": papers.select("audit_id", F.col("id").alias("paper_id"), F.explode("citation_validation").alias("x")).select("audit_id", "paper_id", "x.*"),
        "facets": _flat(r, f"{c}.facets").withColumnRenamed("id", "facet_id"),
        "coverage": coverage,
        "acquisitions": _flat(r, "r.fulltext_acquisitions"),
        "evidence": _flat(r, "r.evidence"),
        "killers": _flat(r, "r.top_killers"),
        "sets": _flat(r, "r.minimal_prior_sets"),
        "bridges": _flat(r, "r.bridges"),
        "landscape_bridges": _flat(r, "r.landscape_bridges"),
        "sensitivity": _flat(r, "r.criticality_sensitivity"),
        "ancestor_terms": _flat(r, "r.ancestor_terms"),
        "audit_log": _flat(r, "r.audit_log"),
        "rewrite_claims": _flat(r, "r.defensible_rewrite.prior_coverage_claims"),
        "bibliography_entries": _flat(r, f"{b}.entries"),
        "bibliography_ids": _values(r, f"{b}.normalized_paper_ids", "paper_id"),
        "bibliography_unmatched": _rows(r, f"{b}.unmatched_entries", "raw_entry"),
        "verdict_evidence": _values(r, f"{v}.evidence_ids", "evidence_id"),
        "risk_basis": _flat(r, f"{v}.risk_basis"),
        "providers": _flat(r, "r.search.providers"),
        "provider_endpoints": _flat(r, f"{m}.provider_endpoints"),
        "query_runs": runs,
        "query_pages": pages,
        "failures": _flat(r, "r.search.failures"),
        "gaps": _values(r, "r.search.gaps", "gap"),
        "obligations": _flat(r, "r.search.obligations"),
        "expansions": expansions.drop("calls", "failures", "endpoint_reference_observations"),
        "expansion_calls": of_expansion("calls"),
        "expansion_failures": of_expansion("failures"),
        "expansion_observations": of_expansion("endpoint_reference_observations"),
        "excluded": excluded,
    }
