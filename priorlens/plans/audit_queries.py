"""Every customer's audit document and all that the invariants find in it.

A customer with three orders gets the sample audit with its first three orders as
works; the remainder of its key chooses one change, or none. Documents and their
hashes are put together by Spark.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.checks import valid_audits, violations
from ..sources.reports import report_tables
from . import audit_documents as D
from .registry import Tables, query

# What each change breaks: change, entity, finding. Reviewed by hand, rule by rule.
EXPECTED: dict[str, list[tuple[str, str | None, str]]] = {
    "VAL-01": [
        ("VAL-01 date-time", None, "generated_at must be an ISO 8601 date-time"),
        ("VAL-01 duplicate candidates", "M1", "repeated candidate id"),
        ("VAL-01 item keys", "evidence.0", "absent field: span"),
        ("VAL-01 types", None, "wrongly typed field"),
    ],
    "VAL-02": [
        ("VAL-02 section", "excluded", "absent field: other"),
    ],
    "VAL-03": [
        ("VAL-03 version", None, "schema_version is another"),
    ],
    "VAL-04": [
        ("VAL-04 class", None, "invalid classification"),
    ],
    "VAL-05": [
        ("VAL-05 facet text", None, "freeze_hash differs from the hash of the claim"),
        ("VAL-05 facet text", None, "log holds another freeze_hash"),
        ("VAL-08 facet twice", None, "freeze_hash differs from the hash of the claim"),
        ("VAL-08 facet twice", None, "log holds another freeze_hash"),
    ],
    "VAL-06": [
        ("VAL-06 cutoff", None, "manifest and input name different cutoffs"),
    ],
    "VAL-07": [
        ("VAL-07 query before freeze", "Q-literal", "query precedes the freeze"),
        ("VAL-07 query before freeze", "Q-literal", "query time is not within retrieval"),
    ],
    "VAL-08": [
        ("VAL-08 facet twice", "F1", "duplicate facet IDs"),
    ],
    "VAL-09": [
        ("VAL-09 outside", "M3", "paper does not exist in candidate_ids"),
        ("VAL-21 smaller set", None, "snapshot hash differs from the hash of the candidates"),
    ],
    "VAL-10": [
        ("VAL-10 entry", "0", "match is not independently reproduced"),
        ("VAL-10 entry", "M2", "normalized ids are not those of the entries"),
        ("VAL-10 ids", "M1", "normalized ids are not those of the entries"),
        ("VAL-10 ids", "M2", "normalized ids are not those of the entries"),
    ],
    "VAL-11": [
        ("VAL-11 threshold", None, "policy differs from the checked default"),
    ],
    "VAL-12": [
        ("VAL-12 runtime", None, "manifest has no python_version"),
    ],
    "VAL-13": [
        ("VAL-13 dates", "M1", "cutoff status does not follow from the dates"),
        ("VAL-13 dates", "M1", "first public date is not the earliest observed one"),
        ("VAL-20 ineligible", "M1", "cutoff status does not follow from the dates"),
    ],
    "VAL-14": [
        ("VAL-14 doi", "M1", "DOI was not independently validated"),
    ],
    "VAL-15": [
        ("VAL-15 acquisition", "FT:M3", "acquired text of no known paper"),
    ],
    "VAL-16": [
        ("VAL-01 item keys", "E1", "evidence has no span"),
        ("VAL-16 level", "E4", "evidence has invalid source_level"),
    ],
    "VAL-17": [
        ("VAL-15 acquisition", "E3", "tier 2 rests on the text of a different paper"),
        ("VAL-17 missing", "E1", "tier 2 without an acquired text"),
        ("VAL-17 other paper", "E1", "tier 2 rests on the text of a different paper"),
        ("VAL-21 smaller set", "E9", "tier 2 without an acquired text"),
    ],
    "VAL-18": [
        ("VAL-18 late evidence", "E3", "verdict is older than its evidence"),
        ("VAL-18 none", None, "negative verdict without evidence ids"),
        ("VAL-20 ineligible", "E1", "verdict rests on a paper past the cutoff rules"),
    ],
    "VAL-19": [
        ("VAL-10 ids", "M1", "bibliography status of a killer is not the derived one"),
        ("VAL-10 ids", "M2", "bibliography status of a killer is not the derived one"),
        ("VAL-16 level", "M1", "top killer facet is not evidence-bound"),
        ("VAL-19 bibliography", "M2", "bibliography status of a killer is not the derived one"),
        ("VAL-19 no negative", "M1", "killer leaves no facet uncovered"),
        ("VAL-20 ineligible", "M1", "top killer is not strictly cutoff-eligible"),
        ("VAL-20 no evidence", "M1", "killer covers a facet without proof"),
        ("VAL-20 tier 1", "M1", "top killer facet is not evidence-bound"),
    ],
    "VAL-20": [
        ("VAL-20 ineligible", "0", "set holds a paper that is not eligible"),
        ("VAL-20 no evidence", "0", "set leaves open critical facet F1"),
        ("VAL-20 no evidence", "M1", "covered facet without evidence"),
        ("VAL-20 tier 1", "M1", "paper hard coverage is not Tier-2 full-text evidence"),
    ],
    "VAL-21": [
        ("VAL-04 class", None, "several papers cover all, yet the class says otherwise"),
        ("VAL-20 ineligible", None, "a smaller set exists"),
        ("VAL-20 ineligible", None, "nothing covers all, yet the class says otherwise"),
        ("VAL-20 no evidence", None, "a smaller set exists"),
        ("VAL-20 no evidence", None, "nothing covers all, yet the class says otherwise"),
        ("VAL-20 tier 1", None, "a smaller set exists"),
        ("VAL-20 tier 1", None, "nothing covers all, yet the class says otherwise"),
        ("VAL-21 omitted", None, "a minimal set is not reported"),
        ("VAL-21 omitted", None, "composition class without a set of two or three"),
        ("VAL-21 omitted", None, "negative class without a set"),
        ("VAL-21 smaller set", None, "a smaller set exists"),
        ("VAL-21 smaller set", None, "one paper covers all, yet the class says otherwise"),
    ],
    "VAL-22": [
        ("VAL-22 missing", "GRAPH_EXPANSION_INCOMPLETE:M1:M2", "gaps of partial expansions are not listed"),
        ("VAL-22 missing", None, "partial expansion without an inconclusive class"),
        ("VAL-22 partial", "GRAPH_EXPANSION_INCOMPLETE:M1:M2", "gaps of partial expansions are not listed"),
        ("VAL-22 partial", None, "partial expansion without an inconclusive class"),
    ],
    "VAL-23": [
        ("VAL-23 extra landscape", "M3", "landscape bridge incorrectly uses a cutoff-eligible source"),
        ("VAL-23 extra landscape", "M3", "landscape bridges are not those of the graph: extra"),
    ],
    "VAL-24": [
        ("VAL-24 hidden", "M1,M2", "a bridge of the graph is not reported"),
        ("VAL-24 hidden", "M1,M2", "fragmented class although a bridge qualifies"),
    ],
    "VAL-25": [
        ("VAL-25 recheck", "0", "source of a textual bridge was not checked as a prior"),
        ("VAL-25 source", "0", "bridge from no known paper"),
        ("VAL-25 source", "0", "textual bridge cites evidence of another paper"),
    ],
    "VAL-26": [
        ("VAL-21 omitted", None, "strong risk without a usable textual bridge"),
        ("VAL-25 source", None, "strong risk without a usable textual bridge"),
        ("VAL-26 graph only", None, "strong risk without a usable textual bridge"),
    ],
    "VAL-27": [
        ("VAL-27 term", "t", "ancestor term cites evidence of another paper"),
        ("VAL-27 term", "t", "ancestor term from no known paper"),
    ],
    "VAL-28": [
        ("VAL-20 ineligible", "0", "defensible rewrite coverage claim references invalid evidence"),
        ("VAL-28 rewrite", "0", "defensible rewrite coverage claim references invalid evidence"),
    ],
    "VAL-29": [
        ("VAL-20 ineligible", "F1", "sensitivity result is not the recomputed one"),
        ("VAL-20 ineligible", "F2", "sensitivity result is not the recomputed one"),
        ("VAL-20 no evidence", "F1", "sensitivity result is not the recomputed one"),
        ("VAL-20 no evidence", "F2", "sensitivity result is not the recomputed one"),
        ("VAL-20 tier 1", "F1", "sensitivity result is not the recomputed one"),
        ("VAL-20 tier 1", "F2", "sensitivity result is not the recomputed one"),
        ("VAL-21 smaller set", "F1", "sensitivity result is not the recomputed one"),
        ("VAL-21 smaller set", "F2", "sensitivity result is not the recomputed one"),
        ("VAL-29 fabricated", "F1", "sensitivity result is not the recomputed one"),
        ("VAL-29 missing", "F2", "not one sensitivity result for each critical facet"),
    ],
    "VAL-30": [
        ("VAL-20 ineligible", "M1", "excluded.post_cutoff is not what the paper statuses give"),
        ("VAL-30 exclusion", "M3", "excluded.post_cutoff is not what the paper statuses give"),
    ],
    "VAL-31": [
        ("VAL-24 hidden", None, "high risk without a basis"),
        ("VAL-31 low", None, "low risk on narrow search or weak evidence"),
        ("VAL-31 low", None, "risk does not fit the class"),
    ],
    "VAL-32": [
        ("VAL-32 open", "multi-family", "open search duties without gaps"),
    ],
    "VAL-33": [
        ("VAL-33 loose", "openalex", "provider failure is not linked to a failed or truncated SearchRun"),
        ("VAL-35 truncated", "Q-literal", "query failure or truncation is not disclosed"),
    ],
    "VAL-34": [
        ("VAL-09 outside", "Q-bridge", "canonical id is no candidate"),
        ("VAL-34 count", "Q-literal", "more returned than there are"),
        ("VAL-36 backstop", "Q-ancestor", "back-stop query filtered by date"),
    ],
    "VAL-35": [
        ("VAL-31 low", None, "verdict states another coverage than derived"),
        ("VAL-32 open", None, "coverage differs from the derived one"),
        ("VAL-32 open", None, "verdict states another coverage than derived"),
        ("VAL-35 saturated", None, "coverage differs from the derived one"),
        ("VAL-35 saturated", None, "saturation does not follow from the stop reasons"),
        ("VAL-35 saturated", None, "verdict states another coverage than derived"),
        ("VAL-35 truncated", None, "coverage differs from the derived one"),
        ("VAL-35 truncated", None, "verdict states another coverage than derived"),
    ],
    "VAL-36": [
        ("VAL-36 backstop", None, "no unfiltered back-stop query"),
    ],
    "VAL-37": [
        ("VAL-37 offset", "Q-ancestor#0", "page starts at the wrong offset"),
    ],
    "VAL-38": [
        ("VAL-09 outside", "EXPAND-GRAPH:multi-provider:M1:M2", "names a paper that is no candidate"),
        ("VAL-22 partial", "EXPAND-GRAPH:multi-provider:M1:M2", "called partial without a cause"),
        ("VAL-22 partial", "EXPAND-GRAPH:multi-provider:M1:M2", "negative_result_scope is inconsistent"),
        ("VAL-38 cutoff", "EXPAND-GRAPH:multi-provider:M1:M2", "provider filtered by date"),
        ("VAL-38 exhaustion", "EXPAND-GRAPH:multi-provider:M1:M2", "finished call still has a token"),
        ("VAL-38 hidden provider", "EXPAND-GRAPH:multi-provider:M1:M2", "automatic mode left out a provider"),
        ("VAL-38 hidden provider", "EXPAND-GRAPH:multi-provider:M1:M2", "backward calls are not those the ids allow"),
        ("VAL-38 hidden provider", "EXPAND-GRAPH:multi-provider:M1:M2", "call to a provider it does not name"),
        ("VAL-38 hidden provider", "EXPAND-GRAPH:multi-provider:M1:M2", "called complete with work left"),
        ("VAL-38 hidden provider", "EXPAND-GRAPH:multi-provider:M1:M2", "mode does not fit the providers"),
        ("VAL-38 hidden provider", "EXPAND-GRAPH:multi-provider:M1:M2", "omitted providers are not those left out"),
        ("VAL-38 hidden provider", "EXPAND-GRAPH:multi-provider:M1:M2", "reasons for being partial do not follow from the log"),
        ("VAL-38 route", "EXPAND-GRAPH:multi-provider:M1:M2", "backward calls are not those the ids allow"),
        ("VAL-38 route", "EXPAND-GRAPH:multi-provider:M1:M2", "reference observation is not what the calls show"),
        ("VAL-38 scope", "EXPAND-GRAPH:multi-provider:M1:M2", "negative_result_scope is inconsistent"),
        ("VAL-38 window", "EXPAND-GRAPH:multi-provider:M1:M2", "observation_window_days is inconsistent"),
    ],
    "VAL-39": [
        ("VAL-21 smaller set", "M9", "named query did not return the paper"),
        ("VAL-21 smaller set", "M9", "named query did not return the paper"),
        ("VAL-39 lineage", "M3", "paper names an unknown query"),
    ],
    "VAL-40": [
        ("VAL-40 late version", "FT:M1", "a later version fits the cutoff"),
        ("VAL-40 late version", "FT:M1", "locked version is newer than the cutoff"),
        ("VAL-40 older version", "FT:M1", "a later version fits the cutoff"),
        ("VAL-40 unversioned", "FT:M1", "a later version fits the cutoff"),
        ("VAL-40 unversioned", "FT:M1", "locked version is not in the history"),
        ("VAL-40 unversioned", "FT:M1", "no version in the source link"),
        ("VAL-40 unversioned", "FT:M1", "version differs from that of the link"),
    ],
    "VAL-41": [
        ("VAL-41 number", "residual_novelty", "novelty_number"),
    ],
}
KINDS = [*D.MUTATIONS, *D.VALID]
CLAIM = "Adaptive memory with compression-aware selection"


def _marked(text: str) -> str:
    """The text with marks for a customer's name and works."""
    for work in "123":
        text = text.replace(f"M{work}", f"M{work}-<{work}>")
    return text.replace(CLAIM, f"{CLAIM} for <name>")


@cache
def templates() -> list[tuple[int, str, str, str]]:
    """Per kind of document: its number, the text, and the texts that its two hashes cover, all with marks."""
    base = D.build()
    freeze, snapshot = base["claim_map"]["freeze_hash"], base["run_manifest"]["candidate_snapshot_hash"]
    out = []
    for number, change in enumerate((D.MUTATIONS | D.VALID).values()):
        doc = D.mutated("<id>", change)
        papers = doc["papers"] if doc["run_manifest"]["candidate_snapshot_hash"] == D.snapshot_hash(doc["papers"]) else base["papers"]
        text = D.json.dumps(doc, ensure_ascii=False).replace(freeze, "<freeze>").replace(D.snapshot_hash(papers), "<snapshot>").replace(snapshot, "<snapshot>")
        out.append((number, _marked(text), _marked(D.canonical(D.frozen_part(base["claim_map"]))), _marked(D.canonical(D.snapshot_part(papers)))))
    return out


def audit_documents(t: Tables) -> DataFrame:
    """``(audit_id, doc)`` of every customer with three orders."""
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    first = t.orders.select("o_custkey", "o_orderkey", nth.alias("n")).filter("n <= 3")
    works = first.groupBy("o_custkey").agg(*[F.max(F.when(F.col("n") == i, F.col("o_orderkey"))).cast("string").alias(f"w{i}") for i in (1, 2, 3)]).filter("w3 IS NOT NULL")
    audits = t.customer.join(works, F.col("c_custkey") == F.col("o_custkey")).withColumn("number", (F.col("c_custkey") % len(KINDS)).cast("int"))
    # a row of a few bytes becomes a document of many thousand: dealt anew, in as many parts as a shuffle
    # has; by the key itself Spark would leave the shuffle before it as it is, merged into few parts by its few bytes
    audits = audits.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("c_custkey"))
    kinds = t.rows(templates(), "number int, doc string, claim string, papers string")
    full = audits.join(kinds, "number")

    def filled(column: str) -> Column:
        text = F.replace(F.col(column), F.lit("<name>"), F.col("c_name"))
        for i in (1, 2, 3):
            text = F.replace(text, F.lit(f"<{i}>"), F.col(f"w{i}"))
        return text

    def digest(column: str) -> Column:
        return F.concat(F.lit("sha256:"), F.sha2(filled(column), 256))

    doc = F.replace(F.replace(filled("doc"), F.lit("<freeze>"), digest("claim")), F.lit("<snapshot>"), digest("papers"))
    audit = F.col("c_custkey").cast("string")
    return full.select(audit.alias("audit_id"), F.replace(doc, F.lit("<id>"), audit).alias("doc"))


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _twin(rules: list[str], gate: bool) -> str:
    rows = [
        f"({KINDS.index(kind)}, {_text(rule)}, {_text(entity)}, {_text(detail)})"
        for rule in rules for kind, entity, detail in EXPECTED[rule] if not gate or rule == "VAL-01" or not kind.startswith("VAL-01")
    ]
    return f"""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
 a AS (SELECT c_custkey, c_custkey % {len(KINDS)} AS kind, max(o_orderkey) FILTER (n = 1) AS w1, max(o_orderkey) FILTER (n = 2) AS w2, max(o_orderkey) FILTER (n = 3) AS w3
   FROM customer JOIN o ON o_custkey = c_custkey WHERE n <= 3 GROUP BY c_custkey HAVING count(*) = 3),
 x(kind, rule, entity, detail) AS (VALUES {", ".join(rows)}),
 found AS (SELECT c_custkey::varchar AS audit_id, rule, replace(replace(replace(entity, 'M1', 'M1-' || w1), 'M2', 'M2-' || w2), 'M3', 'M3-' || w3) AS entity_id, detail FROM a JOIN x USING (kind))
 """


@query("val_gate", _twin(sorted(EXPECTED), True) + "SELECT * FROM found")
def val_gate(t: Tables) -> DataFrame:
    """Every finding of every rule."""
    return violations(report_tables(audit_documents(t)))


@query("val_valid_audits", _twin(sorted(EXPECTED), True) + "SELECT c_custkey::varchar AS audit_id, count(f.rule) = 0 AS valid, count(f.rule) AS violation_count FROM a LEFT JOIN found f ON f.audit_id = c_custkey::varchar GROUP BY c_custkey")
def val_valid_audits(t: Tables) -> DataFrame:
    return valid_audits(report_tables(audit_documents(t)))


# Rules that need a whole document; the others have queries of their own in check_queries.
WHOLE_DOCUMENT_RULES = {
    "VAL-01": "shape", "VAL-02": "required", "VAL-09": "candidates", "VAL-10": "bibliography", "VAL-12": "manifest", "VAL-18": "verdict_evidence",
    "VAL-19": "killers", "VAL-20": "set_evidence", "VAL-21": "recomputed_sets", "VAL-22": "partial_expansions", "VAL-23": "landscape", "VAL-24": "graph_bridges",
    "VAL-25": "textual_bridges", "VAL-26": "strong_risk", "VAL-27": "ancestors", "VAL-28": "rewrite", "VAL-29": "sensitivity", "VAL-32": "obligations",
    "VAL-34": "query_ids", "VAL-38": "expansions", "VAL-40": "locked_versions", "VAL-41": "visible_text",
}

for _rule, _name in WHOLE_DOCUMENT_RULES.items():

    @query(f"val_{_name}", _twin([_rule], False) + "SELECT * FROM found")
    def _one_rule(t: Tables, rule: str = _rule) -> DataFrame:
        return violations(report_tables(audit_documents(t)), [rule], gate=False)
