"""Audit invariants over the driver tables.

Each query builds the section tables one rule needs (an audit is a brand, a
customer or a user) with breakages that occur naturally or by key, and runs
that rule alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checks import RULES, Context
from ..operators.checks.search_log import page_violations
from ..functions.text import leaked_fields, visible_markup
from ..sources import reports
from . import graph_queries as G
from . import search_queries as Q
from .registry import Tables, query

S = F.expr


def _shaped(df: DataFrame, fields: str, *keys: str) -> DataFrame:
    """Add the section's missing columns as typed nulls."""
    have = set(df.columns)
    wanted = T.StructType.fromDDL(fields).fields
    return df.select(*keys, *[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted if f.name not in keys])


def _run(rule: str, **tables: DataFrame) -> DataFrame:
    return RULES[rule](Context(tables)).select("audit_id", F.col("entity_id").cast("string").alias("entity_id"), "detail")


def _customers(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").cast("string").alias("audit_id"), "c_custkey", "c_mktsegment", "c_acctbal", "c_name")


# ------------------------------------------------------------------ header rules


@query(
    "val_version",
    """SELECT c_custkey::varchar AS audit_id, d AS detail FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'schema_version is another' END, CASE WHEN c_custkey % 5 = 0 THEN 'audit_id is blank' END, CASE WHEN c_custkey % 7 = 0 THEN 'made by another tool version' END], lambda x: x IS NOT NULL)) AS d FROM customer)""",
)
def val_version(t: Tables) -> DataFrame:
    a = _customers(t).select("audit_id", S("CASE WHEN c_custkey % 3 > 0 THEN '0.3.2' ELSE '0.1' END").alias("schema_version"), S("CASE WHEN c_custkey % 5 > 0 THEN 'x' ELSE ' ' END").alias("report_audit_id"), S("CASE WHEN c_custkey % 7 > 0 THEN '0.3.2' END").alias("tool_version"))
    return _run("VAL-03", audits=a).drop("entity_id")


@query(
    "val_domains",
    """SELECT c_custkey::varchar AS audit_id, d AS detail FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'invalid classification' END, CASE WHEN c_acctbal < 0 THEN 'invalid novelty_risk' END, CASE WHEN c_custkey % 4 = 0 THEN 'invalid search_coverage' END], lambda x: x IS NOT NULL)) AS d FROM customer)""",
)
def val_domains(t: Tables) -> DataFrame:
    a = _customers(t).select(
        "audit_id", S("CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'RESIDUAL_NOVELTY' END").alias("classification"), S("CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' ELSE 'LOW' END").alias("novelty_risk"),
        S("CASE WHEN c_custkey % 4 > 0 THEN 'BROAD' END").alias("search_coverage"), F.lit("MIXED").alias("evidence_confidence"),
    )
    return _run("VAL-04", audits=a).drop("entity_id")


@query(
    "val_cutoff",
    """SELECT c_custkey::varchar AS audit_id, d AS detail FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 4 > 1 THEN 'input cutoff is no full date' END, CASE WHEN c_custkey % 4 > 0 THEN 'manifest and input name different cutoffs' END], lambda x: x IS NOT NULL)) AS d FROM customer)""",
)
def val_cutoff(t: Tables) -> DataFrame:
    a = _customers(t).select("audit_id", S("element_at(array('2025-09-18', '2025-09-19', '2025-9-18', '2025'), cast(c_custkey % 4 + 1 AS int))").alias("cutoff"), F.lit("2025-09-18").alias("manifest_cutoff"))
    return _run("VAL-06", audits=a).drop("entity_id")


@query(
    "val_freeze",
    """SELECT o_orderkey::varchar AS audit_id, d AS detail FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'no freeze before retrieval' END, CASE WHEN o_orderkey % 5 = 0 THEN 'freeze_hash differs from the hash of the claim' END,
     CASE WHEN o_orderkey % 7 = 0 THEN 'log holds another freeze_hash' END], lambda x: x IS NOT NULL)) AS d FROM orders)""",
)
def val_freeze(t: Tables) -> DataFrame:
    doc = F.concat(F.lit('{"facets": [], "claim_id": "'), F.col("o_orderkey"), F.lit('"}'))
    want = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit('{"claim_id":"'), F.col("o_orderkey"), F.lit('","claim_text":null,"facets":[],"normalized_claim":null}')), 256))
    o = t.orders.select(F.col("o_orderkey").cast("string").alias("audit_id"), "o_orderkey", doc.alias("claim_map_json"), want.alias("want"))
    a = o.select("audit_id", "claim_map_json", S("o_orderkey % 3 > 0").alias("frozen_before_retrieval"), S("CASE WHEN o_orderkey % 5 > 0 THEN want ELSE 'sha256:0' END").alias("freeze_hash"))
    log = o.select("audit_id", S("CASE WHEN o_orderkey % 7 > 0 THEN 'claim_map_frozen' ELSE 'other' END").alias("event"), F.col("want").alias("freeze_hash"))
    return _run("VAL-05", audits=a, audit_log=log).drop("entity_id")


@query(
    "val_time_order",
    """WITH o AS (SELECT o_orderkey, o_orderdate AS f, min(l_shipdate) AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
 SELECT o_orderkey::varchar AS audit_id, NULL AS entity_id, 'retrieval begins before the freeze' AS detail FROM o WHERE s < f UNION ALL SELECT l_orderkey::varchar, l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'query precedes the freeze' FROM lineitem JOIN o ON o.o_orderkey = l_orderkey WHERE l_shipdate < f""",
)
def val_time_order(t: Tables) -> DataFrame:
    o = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderdate").agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    a = o.select(
        F.col("o_orderkey").cast("string").alias("audit_id"), F.date_format("o_orderdate", iso).alias("frozen_at"), F.concat(F.date_format("s", iso), F.lit("Z")).alias("retrieval_started_at"), F.concat(F.date_format("e", iso), F.lit("+00:00")).alias("retrieval_completed_at"),
        F.lit("2030-01-01T00:00:00").alias("decided_at"), F.lit("2030-01-02T00:00:00+02:00").alias("generated_at"),
    )
    runs = t.lineitem.select(F.col("l_orderkey").cast("string").alias("audit_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("query_id"), F.date_format("l_shipdate", iso).alias("retrieved_at"))
    return _run("VAL-07", audits=a, query_runs=runs)


@query(
    "val_unique_ids",
    """SELECT l_orderkey::varchar AS audit_id, l_linenumber::varchar AS entity_id, 'duplicate evidence IDs' AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT l_orderkey::varchar, l_partkey::varchar, 'duplicate paper IDs' FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
 UNION ALL SELECT l_orderkey::varchar, l_suppkey::varchar, 'duplicate full-text acquisition IDs' FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1 UNION ALL SELECT l_orderkey::varchar, l_returnflag, 'duplicate facet IDs' FROM lineitem GROUP BY l_orderkey, l_returnflag HAVING count(*) > 1
 UNION ALL SELECT o_orderkey::varchar, NULL, 'no facet is critical' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')""",
)
def val_unique_ids(t: Tables) -> DataFrame:
    line = t.lineitem.select(F.col("l_orderkey").cast("string").alias("audit_id"), *[F.col(c).cast("string").alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")])
    one = lambda c: line.select("audit_id", F.col(c).alias("id"))
    facets = line.select("audit_id", F.col("l_returnflag").alias("facet_id"), S("l_returnflag = 'R'").alias("critical"), S("l_returnflag = 'A'").alias("structural_critical"))
    return _run("VAL-08", audits=t.orders.select(F.col("o_orderkey").cast("string").alias("audit_id")), facets=facets, papers=one("l_partkey"), evidence=one("l_linenumber"), acquisitions=one("l_suppkey"))


# ------------------------------------------------------------------ papers and evidence


@query(
    "val_dates",
    G.DATES_SQL
    + """, c AS (SELECT f.*, CASE WHEN id % 5 = 0 THEN DATE '1996-01-01' ELSE earliest_public_date END AS cd, CASE WHEN id % 6 = 0 THEN 'ELIGIBLE' ELSE cutoff_status END AS cs FROM f)
 SELECT id::varchar AS entity_id, 'first public date is not the earliest observed one' AS detail FROM c WHERE cd IS DISTINCT FROM earliest_public_date UNION ALL SELECT id::varchar, 'cutoff status does not follow from the dates' FROM c WHERE cs <> cutoff_status""",
)
def val_dates(t: Tables) -> DataFrame:
    true = G._cut(t).select("audit_id", F.col("id").cast("string").alias("id"), "dates", "year", "earliest_public_date", "cutoff_status")
    n = "cast(id AS bigint)"
    papers = true.withColumns({"earliest_public_date": S(f"CASE WHEN {n} % 5 = 0 THEN '1996-01-01' ELSE cast(earliest_public_date AS string) END"), "cutoff_status": S(f"CASE WHEN {n} % 6 = 0 THEN 'ELIGIBLE' ELSE cutoff_status END"), "cutoff": F.lit(None).cast("string")})
    audits = t.rows([("dates", G.CUTOFF)], "audit_id string, cutoff string")
    return _run("VAL-13", audits=audits, papers=papers).drop("audit_id")


def _line_papers(t: Tables) -> DataFrame:
    p = t.orders.select(F.lit("a").alias("audit_id"), F.concat(F.lit("O"), "o_orderkey").alias("id"), S("CASE o_orderstatus WHEN 'P' THEN 'POST_CUTOFF' ELSE 'ELIGIBLE' END").alias("cutoff_status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("earliest_public_date"))
    return _shaped(p, reports.PAPER, "audit_id")


@query(
    "val_acquisitions",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS entity_id, d AS detail FROM (SELECT *, unnest(list_filter([CASE WHEN l_orderkey % 9 = 0 THEN 'acquired text of no known paper' END, CASE WHEN l_returnflag = 'N' THEN 'text was acquired in part only' END], lambda x: x IS NOT NULL)) AS d FROM lineitem)""",
)
def val_acquisitions(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.lit("a").alias("audit_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), S("CASE WHEN l_orderkey % 9 > 0 THEN concat('O', l_orderkey) ELSE concat('X', l_orderkey) END").alias("paper_id"), S("CASE WHEN l_returnflag <> 'N' THEN 'COMPLETE' END").alias("status"))
    return _run("VAL-15", papers=_line_papers(t), acquisitions=a).drop("audit_id")


def _evidence(t: Tables) -> DataFrame:
    e = t.lineitem.select(
        F.lit("a").alias("audit_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.concat(F.lit("O"), "l_orderkey").alias("canonical_paper_id"), S("CASE WHEN l_returnflag = 'A' THEN '' ELSE 'text' END").alias("span"), F.lit("loc").alias("location"), F.lit("src").alias("source"),
        S("CASE l_linestatus WHEN 'F' THEN 'TIER_2_FULLTEXT' ELSE CASE WHEN l_returnflag = 'N' THEN 'TIER_3' ELSE 'GRAPH' END END").alias("source_level"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved_at"),
        S("CASE WHEN l_partkey % 10 > 0 THEN concat('FT', CASE WHEN l_partkey % 10 = 1 THEN l_orderkey + 1 ELSE l_orderkey END) END").alias("acquisition_id"),
    )
    return _shaped(e, reports.EVIDENCE, "audit_id")


@query(
    "val_evidence_fields",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS entity_id, d AS detail FROM (SELECT *, unnest(list_filter([CASE WHEN l_returnflag = 'A' THEN 'evidence has no span' END, CASE WHEN l_linestatus <> 'F' AND l_returnflag = 'N' THEN 'evidence has invalid source_level' END,
   CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders) THEN 'evidence from no known paper' END], lambda x: x IS NOT NULL)) AS d FROM lineitem)""",
)
def val_evidence_fields(t: Tables) -> DataFrame:
    return _run("VAL-16", papers=_line_papers(t), evidence=_evidence(t)).drop("audit_id")


@query(
    "val_fulltext_evidence",
    """WITH e AS (SELECT l.*, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CASE WHEN l_partkey % 10 > 0 THEN CASE WHEN l_partkey % 10 = 1 THEN l_orderkey + 1 ELSE l_orderkey END END AS q FROM lineitem l WHERE l_linestatus = 'F')
 SELECT id AS entity_id, CASE WHEN a.o_orderkey IS NULL THEN 'tier 2 without an acquired text' WHEN a.o_orderkey <> l_orderkey THEN 'tier 2 rests on the text of a different paper' ELSE 'tier 2 is older than its text' END AS detail
 FROM e LEFT JOIN orders a ON a.o_orderkey = q WHERE a.o_orderkey IS NULL OR a.o_orderkey <> l_orderkey OR l_shipdate < o_orderdate""",
)
def val_fulltext_evidence(t: Tables) -> DataFrame:
    a = t.orders.select(F.lit("a").alias("audit_id"), F.concat(F.lit("FT"), "o_orderkey").alias("id"), F.concat(F.lit("O"), "o_orderkey").alias("paper_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved_at"))
    return _run("VAL-17", acquisitions=a, evidence=_evidence(t)).drop("audit_id")


@query(
    "val_identifier_checks",
    "SELECT p_partkey::varchar AS entity_id, 'DOI was not independently validated' AS detail FROM part WHERE p_size % 4 IN (1, 2, 3)",
)
def val_identifier_checks(t: Tables) -> DataFrame:
    p = _shaped(t.part.select(F.lit("a").alias("audit_id"), F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("10.1/P"), "p_partkey").alias("doi")), reports.PAPER, "audit_id")
    checks = t.part.filter("p_size % 4 < 3").select(
        F.lit("a").alias("audit_id"), F.col("p_partkey").cast("string").alias("paper_id"), F.lit("DOI").alias("type"), S("CASE WHEN p_size % 4 = 2 THEN 'arxiv' ELSE 'crossref' END").alias("provider"), S("p_size % 4 <> 1").alias("valid"), F.concat(F.lit("doi: 10.1/p"), "p_partkey", F.lit(".")).alias("identifier")
    )
    return _run("VAL-14", papers=p, citation_checks=checks).drop("audit_id")


@query(
    "val_exclusions",
    """WITH p AS (SELECT o_orderkey AS k, o_orderstatus = 'P' AS post, o_orderkey % 20 < 3 AND o_orderstatus <> 'O' AS listed FROM orders)
 SELECT 'O' || k AS entity_id, 'excluded.post_cutoff is not what the paper statuses give' AS detail FROM p WHERE post <> listed UNION ALL SELECT 'O' || k, 'paper past or unsure of the cutoff is used as a prior' FROM p WHERE listed AND k IN (SELECT l_orderkey FROM lineitem)""",
)
def val_exclusions(t: Tables) -> DataFrame:
    listed = t.orders.filter("o_orderkey % 20 < 3 AND o_orderstatus <> 'O'").select(F.lit("a").alias("audit_id"), F.concat(F.lit("O"), "o_orderkey").alias("paper_id"), F.lit("post_cutoff").alias("kind"))
    used = t.lineitem.select(F.lit("a").alias("audit_id"), F.concat(F.lit("O"), "l_orderkey").alias("paper_id")).distinct()
    sets = used.select("audit_id", F.array("paper_id").alias("paper_ids"))
    return _run("VAL-30", papers=_line_papers(t), excluded=listed, killers=used, sets=sets).drop("audit_id")


@query(
    "val_reader_text",
    r"""WITH k AS (SELECT page_id, 'On novelty: ' || (page_id % 100) || CASE WHEN page_id % 2 = 0 THEN '%' ELSE ' papers' END || html || CASE WHEN page_id % 3 = 0 THEN ' Bridge_Rank' ELSE '' END AS x FROM pages)
 SELECT DISTINCT page_id, CASE WHEN r = 0 THEN 'novelty_number' ELSE 'bridge_rank' END AS detail FROM (SELECT page_id, unnest(CASE WHEN page_id % 6 = 0 THEN [0, 1] WHEN page_id % 2 = 0 THEN [0] WHEN page_id % 3 = 0 THEN [1] ELSE [] END) AS r FROM k)""",
)
def val_reader_text(t: Tables) -> DataFrame:
    x = F.concat(F.lit("On novelty: "), F.col("page_id") % 100, S("CASE WHEN page_id % 2 = 0 THEN '%' ELSE ' papers' END"), F.col("html"), S("CASE WHEN page_id % 3 = 0 THEN ' Bridge_Rank' ELSE '' END"))
    found = F.array_union(leaked_fields(F.col("x")), leaked_fields(visible_markup(F.col("x"))))
    return t.pages.select("page_id", x.alias("x")).select("page_id", F.explode(found).alias("detail"))


# ------------------------------------------------------------------ search log


def _runs(t: Tables) -> DataFrame:
    return Q.runs(t).withColumn("pos", F.lit(0))


@query(
    "val_failures",
    Q.RUNS_SQL
    + """, told AS (SELECT DISTINCT audit_id, provider, CASE WHEN user_id % 3 = 0 THEN 'TIMEOUT' ELSE 'TRUNCATED' END AS type, user_id FROM runs WHERE user_id % 4 > 0),
 need AS (SELECT audit_id, provider, query_id, truncated FROM runs WHERE failed OR truncated)
 SELECT audit_id, query_id AS entity_id, 'query failure or truncation is not disclosed' AS detail FROM need n WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.audit_id = n.audit_id AND t.provider = n.provider AND (NOT n.truncated OR t.type = 'TRUNCATED'))
 UNION ALL SELECT audit_id, provider, 'provider failure is not linked to a failed or truncated SearchRun' FROM told t WHERE NOT EXISTS (SELECT 1 FROM need n WHERE t.audit_id = n.audit_id AND t.provider = n.provider)""",
)
def val_failures(t: Tables) -> DataFrame:
    r = _runs(t)
    told = r.filter("user_id % 4 > 0").select("audit_id", "provider", S("CASE WHEN user_id % 3 = 0 THEN 'TIMEOUT' ELSE 'TRUNCATED' END").alias("type"), F.lit("x").alias("detail"), F.lit(0).alias("pos")).distinct()
    return _run("VAL-33", query_runs=r, failures=told)


@query(
    "val_coverage",
    Q.coverage_sql("user_id % 2 = 0")
    + """, s AS (SELECT audit_id, any_value(user_id) AS u, bool_and(NOT failed AND stop IN ('PROVIDER_EXHAUSTED', 'NO_NEW_RESULTS')) AS sat FROM runs GROUP BY 1)
 SELECT audit_id, 'saturation does not follow from the stop reasons' AS detail FROM s WHERE sat <> (u % 2 = 0) UNION ALL SELECT audit_id, 'coverage differs from the derived one' FROM lv
 UNION ALL SELECT audit_id, 'verdict states another coverage than derived' FROM lv WHERE level <> 'BROAD'""",
)
def val_coverage(t: Tables) -> DataFrame:
    r = _runs(t)
    a = r.select("audit_id", S("user_id % 2 = 0").alias("saturated")).distinct().withColumn("search_coverage", F.lit("BROAD"))
    a = a.withColumn("coverage_derivation", F.lit(None).cast("struct<level:string,scope:string,successful_providers:array<string>,successful_families:array<string>,reasons:array<string>>"))
    return _run("VAL-35", audits=a, query_runs=r, obligations=Q.obligations(t)).drop("entity_id")


@query(
    "val_facet_families",
    """WITH k AS (SELECT user_id, event_type, value >= 100 AS ok, event_type IN ('view', 'click') AS fa FROM events), f AS (SELECT user_id, 'F1' AS facet, event_type, ok FROM k WHERE fa UNION ALL SELECT user_id, 'F2', event_type, ok FROM k WHERE NOT fa),
 g AS (SELECT u.user_id, x.facet, count(DISTINCT event_type) FILTER (ok) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('F1'), ('F2')) x(facet) LEFT JOIN f ON f.user_id = u.user_id AND f.facet = x.facet GROUP BY 1, 2)
 SELECT user_id::varchar AS audit_id, facet AS entity_id, 'critical facet is covered by fewer than two query families' AS detail FROM g WHERE n < 2 UNION ALL SELECT user_id::varchar, NULL, 'at least one composition_bridge query is required' FROM events GROUP BY user_id HAVING count_if(event_type = 'signup') = 0
 UNION ALL SELECT user_id::varchar, NULL, 'no query without terms of the authors' FROM events GROUP BY user_id HAVING count_if(value > 300) = 0""",
)
def val_facet_families(t: Tables) -> DataFrame:
    e = t.events
    audits = e.select(F.col("user_id").cast("string").alias("audit_id")).distinct()
    runs = e.select(
        F.col("user_id").cast("string").alias("audit_id"), S("CASE WHEN value >= 100 THEN 'ok' ELSE 'failed' END").alias("status"), S("CASE WHEN event_type = 'signup' THEN 'composition_bridge' ELSE event_type END").alias("family"),
        S("CASE WHEN event_type IN ('view', 'click') THEN array('F1') ELSE array('F2', 'F9') END").alias("target_facets"), S("value > 300").alias("removed_author_terms"), F.lit(False).alias("temporal_recall_backstop"), F.lit(True).alias("provider_cutoff_applied"),
    )
    facets = audits.select("audit_id", F.explode(F.array(F.lit("F1"), F.lit("F2"))).alias("facet_id"), F.lit(True).alias("critical"), F.lit(False).alias("structural_critical"))
    return _run("VAL-36", audits=audits.withColumn("cutoff", F.lit("")), query_runs=runs, facets=facets)


@query(
    "val_paging",
    """WITH p AS (SELECT o_custkey AS q, row_number() OVER w - 1 AS pos, (sum(10) OVER w) - 10 AS start0, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
 g AS (SELECT q, pos, n, k, start0 + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END AS start, CASE WHEN k % 13 = 0 AND pos < n - 1 THEN NULL WHEN pos < n - 1 OR q % 3 = 0 THEN start0 + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END + 10 END AS nxt, CASE WHEN k % 7 = 0 THEN 12 ELSE 10 - k % 2 END AS elig FROM p),
 h AS (SELECT *, coalesce(lag(coalesce(nxt, start + 10)) OVER (PARTITION BY q ORDER BY pos), 0) AS want FROM g)
 SELECT 'q' || q || '#' || pos AS entity_id, 'page starts at the wrong offset' AS detail FROM h WHERE start <> want UNION ALL SELECT 'q' || q || '#' || pos, 'page keeps more than it read' FROM h WHERE elig > 10 UNION ALL SELECT 'q' || q || '#' || pos, 'page ends the list although another follows' FROM h WHERE nxt IS NULL AND pos < n - 1
 UNION ALL SELECT 'q' || q, 'end of list with a next offset' FROM h WHERE pos = n - 1 AND q % 2 = 0 AND nxt IS NOT NULL UNION ALL SELECT 'q' || q, 'filtered page counted as nothing new' FROM h WHERE pos = n - 1 AND q % 2 = 1 AND elig < 10""",
)
def val_paging(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    p = t.orders.select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("page_pos"), F.count("*").over(W.partitionBy("o_custkey")).alias("n"))
    p = p.withColumn("start", S("page_pos * 10 + CASE WHEN o_orderkey % 11 = 0 THEN 5 ELSE 0 END"))
    nxt = S("CASE WHEN o_orderkey % 13 = 0 AND page_pos < n - 1 THEN NULL WHEN page_pos < n - 1 OR o_custkey % 3 = 0 THEN start + 10 END")
    elig = S("CASE WHEN o_orderkey % 7 = 0 THEN 12 ELSE 10 - o_orderkey % 2 END")
    key = F.concat(F.lit("q"), "o_custkey")
    pages = p.select(F.lit("a").alias("audit_id"), key.alias("query_id"), "page_pos", "start", F.lit(10).alias("raw_returned_count"), elig.alias("eligible_returned_count"), elig.alias("returned_count"), nxt.alias("next"))
    runs = t.orders.select(F.lit("a").alias("audit_id"), key.alias("query_id"), F.lit("arxiv").alias("provider"), F.lit("ok").alias("status"), S("CASE WHEN o_custkey % 2 = 0 THEN 'PROVIDER_EXHAUSTED' ELSE 'NO_NEW_RESULTS' END").alias("saturation_stop_reason")).distinct()
    return page_violations(runs, pages).drop("audit_id")


@query(
    "val_lineage",
    """WITH f AS (SELECT l_orderkey AS p, 'Q' || l_suppkey AS q, bool_or(l_returnflag = 'R') AS listed FROM lineitem GROUP BY 1, 2)
 SELECT 'O' || o_orderkey AS entity_id, 'paper without its queries' AS detail FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'O' || p, 'paper names an unknown query' FROM f WHERE substr(q, 2)::int % 10 = 0 UNION ALL SELECT 'O' || p, 'named query did not return the paper' FROM f WHERE substr(q, 2)::int % 10 > 0 AND NOT listed""",
)
def val_lineage(t: Tables) -> DataFrame:
    found = t.lineitem.groupBy(F.concat(F.lit("O"), "l_orderkey").alias("id")).agg(F.collect_set(F.concat(F.lit("Q"), "l_suppkey")).alias("found_by_query_ids"))
    papers = _line_papers(t).drop("found_by_query_ids").join(found, "id", "left")
    runs = t.lineitem.filter("l_suppkey % 10 > 0").groupBy(F.concat(F.lit("Q"), "l_suppkey").alias("query_id")).agg(F.collect_set(S("CASE WHEN l_returnflag = 'R' THEN concat('O', l_orderkey) END")).alias("canonical_paper_ids")).withColumn("audit_id", F.lit("a"))
    none = t.spark.createDataFrame([], "audit_id string, expansion_id string, discovered_paper_ids array<string>")
    return _run("VAL-39", papers=papers, query_runs=runs, expansions=none).drop("audit_id")


@query(
    "val_verdict_matrix",
    """WITH a AS (SELECT o_orderkey AS k, ['DIRECT_PRECEDENT', 'STRONG_COMPOSITION_RISK', 'FRAGMENTED_PRECEDENT', 'RESIDUAL_NOVELTY', 'INCONCLUSIVE'][o_orderkey % 5 + 1] AS c, ['HIGH', 'MEDIUM', 'LOW', 'INCONCLUSIVE'][o_custkey % 4 + 1] AS r, o_orderpriority = '5-LOW' AS weak, o_orderstatus = 'F' AS gaps FROM orders)
 SELECT k::varchar AS audit_id, d AS detail FROM (SELECT k, unnest(list_filter([CASE WHEN c IN ('RESIDUAL_NOVELTY', 'INCONCLUSIVE') AND NOT gaps THEN 'class hides search gaps' END, CASE WHEN c = 'INCONCLUSIVE' AND r <> 'INCONCLUSIVE' THEN 'inconclusive class with another risk' END,
   CASE WHEN c IN ('DIRECT_PRECEDENT', 'STRONG_COMPOSITION_RISK') AND weak THEN 'negative class on weak evidence' END, CASE WHEN (c IN ('DIRECT_PRECEDENT', 'STRONG_COMPOSITION_RISK') AND r IN ('LOW', 'INCONCLUSIVE')) OR (c = 'RESIDUAL_NOVELTY' AND r = 'INCONCLUSIVE') OR (c = 'INCONCLUSIVE' AND r <> 'INCONCLUSIVE') THEN 'risk does not fit the class' END,
   CASE WHEN r = 'LOW' AND weak THEN 'low risk on narrow search or weak evidence' END, CASE WHEN c IN ('FRAGMENTED_PRECEDENT', 'RESIDUAL_NOVELTY') AND r = 'HIGH' THEN 'high risk without a basis' END], lambda x: x IS NOT NULL)) AS d FROM a)""",
)
def val_verdict_matrix(t: Tables) -> DataFrame:
    a = t.orders.select(
        F.col("o_orderkey").cast("string").alias("audit_id"), S("element_at(array('DIRECT_PRECEDENT', 'STRONG_COMPOSITION_RISK', 'FRAGMENTED_PRECEDENT', 'RESIDUAL_NOVELTY', 'INCONCLUSIVE'), cast(o_orderkey % 5 + 1 AS int))").alias("classification"),
        S("element_at(array('HIGH', 'MEDIUM', 'LOW', 'INCONCLUSIVE'), cast(o_custkey % 4 + 1 AS int))").alias("novelty_risk"), S("CASE WHEN o_orderpriority = '5-LOW' THEN 'WEAK' ELSE 'MIXED' END").alias("evidence_confidence"), F.lit("BROAD").alias("search_coverage"),
    )
    gaps = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("audit_id"), F.lit("g").alias("gap"))
    basis = t.spark.createDataFrame([], "audit_id string, pos int, type string, detail string, evidence_ids array<string>")
    ev = t.spark.createDataFrame([], "audit_id string, id string")
    return _run("VAL-31", audits=a, gaps=gaps, risk_basis=basis, evidence=ev).drop("entity_id")


@query(
    "val_policy",
    """SELECT c_custkey::varchar AS audit_id, CASE c_custkey % 4 WHEN 0 THEN 'configured bridge policy requires an integer high_citation_threshold' WHEN 1 THEN 'threshold set although the policy is not configured' WHEN 2 THEN 'calibration lacks data set, method or preregistration' END AS detail FROM customer WHERE c_custkey % 4 < 3""",
)
def val_policy(t: Tables) -> DataFrame:
    k = "c_custkey % 4"
    a = _customers(t).select(
        "audit_id", S(f"element_at(array('DOCUMENTED_OVERRIDE', 'UNCONFIGURED', 'CALIBRATION_DECLARED', 'CALIBRATION_DECLARED'), cast({k} + 1 AS int))").alias("policy_status"), S(f"CASE WHEN {k} > 0 THEN 100 END").cast("bigint").alias("high_citation_threshold"), F.lit("s").alias("policy_source"),
        S(f"named_struct('dataset', CASE WHEN {k} <> 2 THEN c_mktsegment ELSE ' ' END, 'method', 'm', 'preregistered', true)").alias("policy_evidence"),
    )
    return _run("VAL-11", audits=a).drop("entity_id")
