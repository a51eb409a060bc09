"""A small valid audit document, and changes that break one thing each.

Three works: M1 covers memory, M2 covers selection and cites M1, M3 is a survey
that cites both and carries the textual bridge. The registered queries give every
customer such a document about its own orders; the tests use them one by one.
"""

from __future__ import annotations

import copy
import hashlib
import json

from ..operators.bridges import POLICY_DATASET, POLICY_METHOD, POLICY_SOURCE

CUTOFF = "2025-09-18"


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(value) -> str:
    return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()


def at(minute: int, hour: int = 7) -> str:
    return f"2026-08-27T{hour:02d}:{minute:02d}:00Z"


def frozen_part(claim_map) -> dict:
    """What the freeze hash covers."""
    return {k: claim_map.get(k) for k in ("claim_id", "claim_text", "normalized_claim")} | {"facets": claim_map.get("facets") or []}


def snapshot_part(papers) -> list[dict]:
    """What the snapshot hash covers."""
    keys = ("id", "title", "doi", "arxiv_id", "providers", "dates", "references", "found_by_query_ids")
    return [{k: p.get(k) for k in keys} for p in sorted(papers, key=lambda p: str(p.get("id")))]


def freeze_hash(claim_map) -> str:
    return digest(frozen_part(claim_map))


def snapshot_hash(papers) -> str:
    return digest(snapshot_part(papers))


def paper(pid, title, providers, date, source, refs, found, coverage, **kw):
    return dict(id=pid, title=title, providers=providers, dates=[{"value": date, "source": source}], earliest_public_date=date, cutoff_status="ELIGIBLE",
                references=refs, found_by_query_ids=found, coverage=coverage, **kw)


def entry(status, *evidence):
    return {"status": status, "evidence_ids": list(evidence)}


def span(eid, pid, minute, kind, *supports):
    return dict(id=eid, canonical_paper_id=pid, source_level="TIER_2_FULLTEXT", acquisition_id=f"FT:{pid}", span=f"Span {eid}.", location="Section 3",
                source=f"https://example.org/{pid}", retrieved_at=at(minute), evidence_kind=kind, supports=list(supports))


def run(qid, provider, family, minute, ids, plain=False, backstop=False, pagination=None):
    return dict(query_id=qid, provider=provider, family=family, query=f"query {qid}", reason="because", target_facets=["F1", "F2"], removed_author_terms=plain, retrieved_at=at(minute),
                temporal_recall_backstop=backstop, provider_cutoff_applied=not backstop, returned_count=len(ids), total_count=len(ids), truncated=False, pagination=pagination or {"page": 1},
                corpus="all" if provider == "openalex" else "not_applicable", saturation_stop_reason="PROVIDER_EXHAUSTED", paper_ids=list(ids), canonical_paper_ids=list(ids), status="ok")


def call(provider, direction, anchor, n):
    return dict(provider=provider, direction=direction, anchor_paper_id=anchor, returned_count=n, limit=100, exhausted=True, next_token=None, provider_total=None, raw_examined_count=None, possibly_truncated=False)


def observation(pid, *providers):
    total = sum(n for _, n in providers)
    rows = [dict(provider=p, returned_count=n, status="NONEMPTY" if n else "EMPTY_AT_PROVIDER") for p, n in providers]
    return dict(paper_id=pid, provider_returned_count=total, status="NONEMPTY" if total else "EMPTY_AT_PROVIDER", provider_observations=rows)


def build(audit_id: str = "golden") -> dict:
    claim = dict(claim_id="C0", claim_text="Adaptive memory with compression-aware selection.", normalized_claim="adaptive memory compression aware selection", frozen_before_retrieval=True, frozen_at=at(0),
                 facets=[dict(id="F1", type="mechanism", text="adaptive memory", critical=True), dict(id="F2", type="interaction", text="compression-aware selection", critical=False, structural_critical=True)])
    claim["freeze_hash"] = freeze_hash(claim)
    papers = [
        paper("M1", "Adaptive Memory Systems", ["openalex", "arxiv"], "2022-03-01", "arxiv_v1", [], ["Q-literal", "Q-mechanism"], {"F1": entry("EXACT", "E1"), "F2": entry("NO", "E4")}),
        paper("M2", "Compression-aware Selection", ["openalex", "semantic-scholar"], "2023-04-02", "publisher_online", ["M1"], ["Q-literal", "Q-problem"], {"F1": entry("PARTIAL", "E5"), "F2": entry("FUNCTIONAL", "E2")}),
        paper("M3", "A Survey of Memory and Compression", ["openalex"], "2024-05-03", "publisher_online", ["M1", "M2"], ["Q-bridge"], {}),
    ]
    page = {"pages": [dict(page_index=1, returned_count=0, total_count=0, truncated=False, paper_ids=[], pagination=dict(start=0, raw_returned_count=0, eligible_returned_count=0, next=None))], "stop_reason": "PROVIDER_EXHAUSTED"}
    sha = lambda c: "sha256:" + c * 64
    return dict(
        schema_version="0.3.2", audit_id=audit_id, generated_at=at(0, 8), candidate_ids=["M1", "M2", "M3"],
        run_manifest=dict(tool_version="0.3.2", config_hash=sha("a"), cutoff=CUTOFF, domain="computer science", model_name="m", prompt_version="p", retrieval_started_at=at(10), retrieval_completed_at=at(18), candidate_snapshot_hash=snapshot_hash(papers),
                          provider_endpoints=[dict(name="openalex", endpoint="https://api", version="1")], runtime_environment=dict(python_version="3.12", dependencies=dict(jsonschema="4", pypdf="5"))),
        input=dict(claim="Adaptive memory with compression-aware selection.", normalized_claim="adaptive memory", field="cs", cutoff=CUTOFF, strict_date=True),
        author_bibliography=dict(status="PROVIDED", source="manuscript", entries=[dict(raw_entry="Compression-aware Selection (2023)", matched_paper_id="M2", match_basis="TITLE_AUTHOR")], normalized_paper_ids=["M2"], unmatched_entries=[]),
        claim_map=claim,
        verdict=dict(classification="STRONG_COMPOSITION_RISK", novelty_risk="HIGH", search_coverage="BROAD", evidence_confidence="STRONG", decided_at=at(45), main_concern="M1 and M2 jointly cover the claim and M3 connects them.", evidence_ids=["E1", "E2", "E3"]),
        papers=papers,
        fulltext_acquisitions=[dict(id=f"FT:{p}", paper_id=p, status="COMPLETE", source_url=f"https://example.org/{p}.pdf", source_kind="PDF", retrieved_at=at(20), content_sha256=sha("b"), text_sha256=sha("c"), text_path=f"{p}.txt", extraction_method="pypdf", char_count=10) for p in ("M1", "M2", "M3")],
        evidence=[span("E1", "M1", 30, "METHOD", "F1"), span("E2", "M2", 31, "METHOD", "F2"), span("E3", "M3", 32, "BRIDGE_TEXT"), span("E4", "M1", 30, "METHOD", "F2"), span("E5", "M2", 31, "METHOD", "F1")],
        top_killers=[dict(paper_id="M1", covers=["F1"], does_not_cover=["F2"], evidence_ids=["E1", "E4"], bibliography_status="NOT_IN_BIBLIOGRAPHY"), dict(paper_id="M2", covers=["F2"], does_not_cover=["F1"], evidence_ids=["E2", "E5"], bibliography_status="IN_BIBLIOGRAPHY")],
        minimal_prior_sets=[dict(paper_ids=["M1", "M2"], size=2, covered_facets=["F1", "F2"], evidence_ids=["E1", "E2"])],
        bridges=[dict(type="TAXONOMY_BRIDGE", provenance_type="text", paper_ids=["M1", "M2"], source_paper_id="M3", cutoff_status="ELIGIBLE", text_verified=True, source_rechecked_as_candidate=True, evidence_ids=["E3"])],
        landscape_bridges=[],
        criticality_sensitivity=[dict(removed_facet=f, baseline_size=2, alternative_size=1, alternative_classification="DIRECT_PRECEDENT") for f in ("F1", "F2")],
        ancestor_terms=[], residual_novelty="The interaction rule may survive.",
        defensible_rewrite=dict(text="Prior work covers both parts separately.", prior_coverage_claims=[dict(text="Prior work covers adaptive memory.", evidence_ids=["E1"])]),
        search=dict(
            providers=[dict(name="openalex", status="ok")], query_families=["literal"],
            query_runs=[run("Q-literal", "openalex", "literal", 10, ["M1", "M2"]), run("Q-mechanism", "semantic-scholar", "mechanism", 12, ["M1"], plain=True), run("Q-problem", "openalex", "problem_function", 14, ["M2"]),
                        run("Q-ancestor", "arxiv", "ancestor", 16, [], backstop=True, pagination=page), run("Q-bridge", "openalex", "composition_bridge", 18, ["M3"])],
            graph_expansions=[dict(
                expansion_id="EXPAND-GRAPH:multi-provider:M1:M2", status="COMPLETE", partial_reasons=[], provider="multi-provider", providers=["openalex", "semantic-scholar"], provider_selection="AUTO_AVAILABLE", omitted_providers=[], paper_ids=["M1", "M2"],
                cutoff=CUTOFF, temporal_recall_backstop=True, provider_cutoff_applied=False, limit_per_call=100, anchor_selection="CITATION_COUNT_INCOMPLETE_EXPAND_BOTH",
                calls=[call("openalex", "BACKWARD", "M1", 0), call("openalex", "BACKWARD", "M2", 1), call("semantic-scholar", "BACKWARD", "M2", 0), call("openalex", "FORWARD", "M1", 1), call("openalex", "FORWARD", "M2", 1)], failures=[],
                bridge_candidate_ids=["M3"], historical_bridge_candidate_ids=["M3"], landscape_bridge_candidate_ids=[], endpoint_reference_observations=[observation("M1", ("openalex", 0)), observation("M2", ("openalex", 1), ("semantic-scholar", 0))],
                observation_window_days=900, observation_window_status="MEETS_DIAGNOSTIC_THRESHOLD", observation_window_threshold_days=548, negative_result_scope="HISTORICAL_CANDIDATE_PRESENT", discovered_paper_ids=["M3"], new_paper_ids=[])],
            failures=[], gaps=["One workshop paper had no full text."], obligations=[dict(id="multi-family", status="COMPLETE", detail="done")],
            bridge_policy=dict(status="SENSITIVITY_CHECKED", high_citation_threshold=500, source=POLICY_SOURCE, evidence=dict(dataset=POLICY_DATASET, method=POLICY_METHOD, preregistered=False)),
            coverage_derivation=dict(level="BROAD", scope="PROTOCOL_EXECUTION_NOT_RECALL", successful_providers=["arxiv", "openalex", "semantic-scholar"], successful_families=["ancestor", "composition_bridge", "literal", "mechanism", "problem_function"], reasons=[]),
            saturated=True,
        ),
        excluded=dict(post_cutoff=[], date_uncertain=[], other=[]),
        audit_log=[dict(event="claim_map_frozen", at=at(0), freeze_hash=claim["freeze_hash"])],
    )


def mutated(audit_id: str, change) -> dict:
    doc = copy.deepcopy(build(audit_id))
    change(doc)
    return doc


# ------------------------------------------------------------------ changes


def _set(path, value):
    def change(d):
        *head, last = path
        for k in head:
            d = d[k]
        d[last] = value

    return change


def _del(path):
    def change(d):
        *head, last = path
        for k in head:
            d = d[k]
        del d[last]

    return change


def _both(*changes):
    def change(d):
        for c in changes:
            c(d)

    return change


def _rehash(d):
    d["run_manifest"]["candidate_snapshot_hash"] = snapshot_hash(d["papers"])


X = ["search", "graph_expansions", 0]


def _add_paper(d):
    new = json.loads(json.dumps(d["papers"][0])) | {"id": "M9", "coverage": {"F1": {"status": "EXACT", "evidence_ids": ["E9"]}, "F2": {"status": "EXACT", "evidence_ids": ["E9"]}}}
    d["papers"].append(new)
    d["evidence"].append(dict(d["evidence"][0], id="E9", canonical_paper_id="M9", acquisition_id="FT:M9", supports=["F1", "F2"]))
    d["candidate_ids"].append("M9")


def _low_risk(d):
    d["verdict"].update(novelty_risk="LOW", search_coverage="NARROW")


def _arxiv(version, date, **extra):
    def change(d):
        hist = [dict(version=v, identifier=f"1706.03762v{v}", submitted_at=s, pdf_url=f"https://arxiv.org/pdf/1706.03762v{v}", verified=True) for v, s in ((1, "2017-06-12"), (2, "2019-01-15"), (3, "2026-01-01"))]
        d["papers"][0]["arxiv_id"] = "1706.03762"
        d["papers"][0]["citation_validation"] = [dict(type="ARXIV", provider="arxiv", valid=True, identifier="1706.03762v1")]
        d["fulltext_acquisitions"][0].update(dict(
            source_url=f"https://arxiv.org/pdf/1706.03762v{version}", historical_cutoff="2025-09-18", arxiv_version=version, arxiv_version_date=date, version_lock="LATEST_VERIFIED_VERSION_AT_OR_BEFORE_CUTOFF",
            version_selection_method="ARXIV_API_COMPLETE_VERSION_HISTORY", arxiv_version_history=hist, arxiv_version_history_complete=True) | extra)
        _rehash(d)

    return change


MUTATIONS = {
    "VAL-01 types": _set(["input", "strict_date"], "yes"),
    "VAL-01 item keys": _del(["evidence", 0, "span"]),
    "VAL-01 duplicate candidates": lambda d: d["candidate_ids"].append("M1"),
    "VAL-01 date-time": _set(["generated_at"], "yesterday"),
    "VAL-02 section": _del(["excluded", "other"]),
    "VAL-03 version": _set(["schema_version"], "0.1"),
    "VAL-04 class": _set(["verdict", "classification"], "NOVEL"),
    "VAL-05 facet text": _set(["claim_map", "facets", 0, "text"], "changed"),
    "VAL-06 cutoff": _set(["run_manifest", "cutoff"], "2025-09-19"),
    "VAL-07 query before freeze": _set(["search", "query_runs", 0, "retrieved_at"], "2026-08-27T06:00:00Z"),
    "VAL-08 facet twice": lambda d: d["claim_map"]["facets"].append(d["claim_map"]["facets"][0]),
    "VAL-09 outside": _both(lambda d: d["candidate_ids"].remove("M3")),
    "VAL-10 ids": _set(["author_bibliography", "normalized_paper_ids"], ["M1"]),
    "VAL-10 entry": _set(["author_bibliography", "entries", 0, "raw_entry"], "Something else (2023)"),
    "VAL-11 threshold": _set(["search", "bridge_policy", "high_citation_threshold"], 999),
    "VAL-12 runtime": _set(["run_manifest", "runtime_environment", "python_version"], ""),
    "VAL-13 dates": _both(_set(["papers", 0, "dates", 0, "value"], "2026-03-01"), _rehash),
    "VAL-14 doi": _both(_set(["papers", 0, "doi"], "10.1000/x"), _rehash),
    "VAL-15 acquisition": _set(["fulltext_acquisitions", 2, "paper_id"], "M7"),
    "VAL-16 level": _set(["evidence", 3, "source_level"], "TIER_9"),
    "VAL-17 other paper": _set(["evidence", 0, "acquisition_id"], "FT:M2"),
    "VAL-17 missing": _set(["evidence", 0, "acquisition_id"], "FT:none"),
    "VAL-18 late evidence": _set(["evidence", 2, "retrieved_at"], "2026-08-27T07:50:00Z"),
    "VAL-18 none": _set(["verdict", "evidence_ids"], []),
    "VAL-19 no negative": _set(["top_killers", 0, "does_not_cover"], []),
    "VAL-19 bibliography": _set(["top_killers", 1, "bibliography_status"], "NOT_IN_BIBLIOGRAPHY"),
    "VAL-20 ineligible": _set(["papers", 0, "cutoff_status"], "POST_CUTOFF"),
    "VAL-20 no evidence": _set(["papers", 0, "coverage", "F1", "evidence_ids"], []),
    "VAL-20 tier 1": _set(["evidence", 0, "source_level"], "TIER_1_METADATA"),
    "VAL-21 smaller set": _add_paper,
    "VAL-21 omitted": _set(["minimal_prior_sets"], []),
    "VAL-22 partial": _set([*X, "status"], "PARTIAL"),
    "VAL-22 missing": _set(["search", "graph_expansions"], []),
    "VAL-23 extra landscape": lambda d: d["landscape_bridges"].append(dict(type="LANDSCAPE_BRIDGE", underlying_type="CO_CITATION", provenance_type="graph", paper_ids=["M1", "M2"], source_paper_id="M3", cutoff_status="POST_CUTOFF", graph_verified=True, affects_historical_verdict=False)),
    "VAL-24 hidden": _both(_set(["bridges"], []), _set(["verdict", "classification"], "FRAGMENTED_PRECEDENT")),
    "VAL-25 recheck": _set(["bridges", 0, "source_rechecked_as_candidate"], False),
    "VAL-25 source": _set(["bridges", 0, "source_paper_id"], "M8"),
    "VAL-26 graph only": _set(["bridges"], [dict(type="DIRECT_CITATION", provenance_type="graph", paper_ids=["M1", "M2"], source_paper_id="M2", cutoff_status="ELIGIBLE", graph_verified=True, evidence_ids=[])]),
    "VAL-27 term": lambda d: d["ancestor_terms"].append(dict(term="t", source_paper_id="M8", first_observed="2020-01-01", evidence_ids=["E1"])),
    "VAL-28 rewrite": _set(["defensible_rewrite", "prior_coverage_claims", 0, "evidence_ids"], ["nope"]),
    "VAL-29 fabricated": _set(["criticality_sensitivity", 0, "alternative_size"], 3),
    "VAL-29 missing": lambda d: d["criticality_sensitivity"].pop(),
    "VAL-30 exclusion": _set(["excluded", "post_cutoff"], ["M3"]),
    "VAL-31 low": _low_risk,
    "VAL-32 open": _both(_set(["search", "obligations", 0, "status"], "INCOMPLETE"), _set(["search", "gaps"], [])),
    "VAL-33 loose": lambda d: d["search"]["failures"].append(dict(provider="openalex", type="TIMEOUT", detail="x")),
    "VAL-34 count": _set(["search", "query_runs", 0, "total_count"], 1),
    "VAL-35 saturated": _set(["search", "saturated"], False),
    "VAL-35 truncated": _set(["search", "query_runs", 0, "truncated"], True),
    "VAL-36 backstop": _set(["search", "query_runs", 3, "provider_cutoff_applied"], True),
    "VAL-37 offset": _set(["search", "query_runs", 3, "pagination", "pages", 0, "pagination", "start"], 5),
    "VAL-38 cutoff": _set([*X, "provider_cutoff_applied"], True),
    "VAL-38 window": _set([*X, "observation_window_days"], 3),
    "VAL-38 route": lambda d: d["search"]["graph_expansions"][0]["calls"].pop(2),
    "VAL-38 scope": _set([*X, "negative_result_scope"], "NO_HISTORICAL_CUTOFF"),
    "VAL-38 hidden provider": _set([*X, "providers"], ["openalex"]),
    "VAL-38 exhaustion": _set([*X, "calls", 0, "next_token"], "t"),
    "VAL-39 lineage": _both(_set(["papers", 2, "found_by_query_ids"], ["Q-gone"]), _rehash),
    "VAL-40 late version": _arxiv(3, "2026-01-01"),
    "VAL-40 older version": _arxiv(1, "2017-06-12"),
    "VAL-40 unversioned": _arxiv(2, "2019-01-15", source_url="https://arxiv.org/pdf/1706.03762"),
    "VAL-41 number": _set(["residual_novelty"], "novelty 99.99%"),
}
VALID = {
    "ok": lambda d: None,
    "ok medium risk": _set(["verdict", "novelty_risk"], "MEDIUM"),
    "ok version": _arxiv(2, "2019-01-15"),
    "ok override": _both(_set(["search", "bridge_policy"], dict(status="DOCUMENTED_OVERRIDE", high_citation_threshold=100, source="ours", evidence=dict(dataset=None, method=None, preregistered=None)))),
    "ok not strict": _both(_arxiv(3, "2026-01-01"), _set(["input", "strict_date"], False)),
    "ok inconclusive": _both(
        _set([*X, "status"], "PARTIAL"), _set([*X, "partial_reasons"], ["PROVIDER_FAILURE"]), _set([*X, "failures"], [dict(provider="semantic-scholar", direction="BACKWARD", anchor_paper_id="M2", detail="x")]),
        lambda d: d["search"]["graph_expansions"][0]["calls"].pop(2), _set([*X, "negative_result_scope"], "INCOMPLETE_EXPANSION"),
        _set([*X, "endpoint_reference_observations", 1, "provider_observations", 1], dict(provider="semantic-scholar", returned_count=None, status="FAILED")),
        lambda d: d["search"]["gaps"].append("GRAPH_EXPANSION_INCOMPLETE:M1:M2"), lambda d: d["verdict"].update(classification="INCONCLUSIVE", novelty_risk="INCONCLUSIVE"),
    ),
}
