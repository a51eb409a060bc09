"""Queries for operators that other operators' queries do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bridges, fulltext, metrics, search, setcover
from .registry import Tables, query

S = F.expr


@query(
    "brg_distinct",
    """SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 'CO_CITATION' ELSE 'TAXONOMY_BRIDGE' END AS kind, least('P' || l_partkey, 'S' || l_suppkey) AS a, greatest('P' || l_partkey, 'S' || l_suppkey) AS b,
   CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'O' || l_orderkey END AS source FROM lineitem""",
)
def brg_distinct(t: Tables) -> DataFrame:
    """Bridges of all lines; spelling, order of ends and landscape marking do not make another bridge."""
    found = t.lineitem.select(
        F.lit("x").alias("audit_id"), S("CASE WHEN l_returnflag <> 'R' THEN 'taxonomy_bridge' WHEN l_linenumber % 2 = 0 THEN 'LANDSCAPE_BRIDGE' ELSE 'co_citation' END").alias("type"),
        S("CASE WHEN l_returnflag <> 'R' THEN '' WHEN l_linenumber % 2 = 0 THEN 'CO_CITATION' END").alias("underlying_type"),
        S("CASE WHEN l_linenumber % 2 = 0 THEN array(concat('P', l_partkey), concat('S', l_suppkey)) ELSE array(concat('S', l_suppkey), concat('P', l_partkey)) END").alias("paper_ids"),
        S("CASE WHEN l_linenumber % 3 > 0 THEN concat('O', l_orderkey) END").alias("source_paper_id"),
    )
    key = bridges.route_key(F.col("type"), F.col("underlying_type"), F.col("paper_ids"), F.col("source_paper_id"))
    out = bridges.distinct_bridges(found).select(key.alias("k"))
    return out.select("k.kind", F.col("k.paper_ids")[0].alias("a"), F.col("k.paper_ids")[1].alias("b"), F.col("k.source_paper_id").alias("source"))


@query(
    "sch_plan_runs",
    """SELECT o_custkey::varchar AS audit_id, o_orderkey || ':' || provider AS query_id, o_orderkey::varchar AS logical_query_id, provider FROM orders
 JOIN (SELECT c_custkey, 'openalex' AS provider FROM customer UNION ALL SELECT c_custkey, 'arxiv' FROM customer WHERE c_nationkey % 2 = 0) ON c_custkey = o_custkey""",
)
def sch_plan_runs(t: Tables) -> DataFrame:
    asked = t.orders.select(F.col("o_custkey").cast("string").alias("audit_id"), F.col("o_orderkey").cast("string").alias("query_id"))
    names = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("openalex"), F.lit("arxiv"))).otherwise(F.array(F.lit("openalex")))
    providers = t.customer.select(F.col("c_custkey").cast("string").alias("audit_id"), F.explode(names).alias("provider"))
    return search.plan_runs(asked, providers).select("audit_id", "query_id", "logical_query_id", "provider")


@query(
    "mps_coverage_rows",
    """SELECT l_orderkey::varchar AS audit_id, 'S' || l_suppkey AS paper_id, l_partkey || '-' || l_linenumber AS facet_id, CASE max(l_returnflag) WHEN 'R' THEN 'EXACT' WHEN 'A' THEN 'FUNCTIONAL' ELSE 'UNKNOWN' END AS status,
   CASE WHEN l_linenumber % 2 = 0 THEN 'E' || l_linenumber ELSE '' END AS evidence FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey, l_linenumber""",
)
def mps_coverage_rows(t: Tables) -> DataFrame:
    """Coverage maps of all works, unfolded again."""
    lines = t.lineitem.groupBy("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    entry = F.struct(
        S("CASE flag WHEN 'R' THEN 'exact' WHEN 'A' THEN 'Functional' END").alias("status"),
        S("CASE WHEN l_linenumber % 2 = 0 THEN array(concat('E', l_linenumber)) END").alias("evidence_ids"),
    )
    pair = F.struct(F.concat_ws("-", "l_partkey", "l_linenumber").alias("facet"), entry.alias("entry"))
    works = lines.groupBy(F.col("l_orderkey").cast("string").alias("audit_id"), F.concat(F.lit("S"), "l_suppkey").alias("id")).agg(F.map_from_entries(F.collect_list(pair)).alias("coverage"))
    return setcover.coverage_rows(works).select("audit_id", "paper_id", "facet_id", "status", F.array_join("evidence_ids", ",").alias("evidence"))


@query(
    "ftx_batch_status",
    """SELECT p AS audit_id, count_if(page_id % 3 = 0)::bigint AS acquired, count_if(page_id % 7 = 0)::bigint AS failed, CASE WHEN count_if(page_id % 3 = 0) = 0 THEN 'FAILED' WHEN count_if(page_id % 7 = 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status
 FROM (SELECT page_id, (page_id // 4)::varchar AS p FROM pages) GROUP BY 1""",
)
def ftx_batch_status(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", F.floor(F.col("page_id") / 4).cast("string").alias("audit_id"))
    return fulltext.batch_status(p.select("audit_id").distinct(), p.filter("page_id % 3 = 0"), p.filter("page_id % 7 = 0"))


@query(
    "ftx_requested",
    """SELECT page_id::varchar AS paper_id, 'kept' AS outcome FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT (2 * page_id)::varchar, 'unknown' FROM pages WHERE 2 * page_id NOT IN (SELECT page_id FROM pages)""",
)
def ftx_requested(t: Tables) -> DataFrame:
    papers = t.pages.select(F.lit("x").alias("audit_id"), F.col("page_id").cast("string").alias("id"))
    asked = t.pages.select(F.lit("x").alias("audit_id"), (2 * F.col("page_id")).cast("string").alias("paper_id"))
    kept, unknown = fulltext.restrict(papers, asked)
    return kept.select(F.col("id").alias("paper_id"), F.lit("kept").alias("outcome")).unionByName(unknown.select("paper_id", F.lit("unknown").alias("outcome")))


@query(
    "met_joined",
    "SELECT o_custkey AS case_id, count(*) AS orders, any_value(c_name) AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
)
def met_joined(t: Tables) -> DataFrame:
    gold = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("orders"))
    return metrics.metric_cases(gold, t.customer.select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("name")))[0].select("case_id", "orders", "name")
