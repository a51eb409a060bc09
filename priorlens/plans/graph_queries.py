"""Citation graph, dates, versions and expansion over the driver tables.

View: a citing work is an order (dated by its order date), a cited work is a
part, and an order also cites its customer's previous order. Citations are
spelled three ways. Pairs are the parts that follow each other within an order,
plus each order with the customer's previous one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates as D
from ..operators import bridges, dates, expansion, versions
from ..operators.metrics import temporal_leakage
from ..session import cut_lineage
from .registry import Tables, arxiv_name, query

S = F.expr
CUTOFF = "1998-06-01"
THRESHOLD = 38


def works(t: Tables) -> DataFrame:
    orders = t.orders.select(
        F.concat(F.lit("O"), "o_orderkey").alias("id"), F.concat(F.lit("key:O"), "o_orderkey").alias("canonical_key"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"),
        F.create_map(F.lit("openalex"), F.concat(F.lit("W"), "o_orderkey")).alias("provider_ids"), F.lit(None).cast("bigint").alias("citation_count"), F.col("o_orderdate").cast("date").alias("earliest_public_date"),
    )
    counts = t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"))
    parts = t.part.join(counts, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.concat(F.lit("key:P"), "p_partkey").alias("canonical_key"), F.concat(F.lit("10.1000/p"), "p_partkey").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"),
        F.create_map().cast("map<string,string>").alias("provider_ids"), F.col("n").alias("citation_count"), F.lit(None).cast("date").alias("earliest_public_date"),
    )
    both = orders.unionByName(parts)
    return both.select(F.lit("graph").alias("audit_id"), "*", F.lit(None).cast("string").alias("cutoff_status"), F.lit(CUTOFF).cast("date").alias("cutoff"))


def previous_orders(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", "o_orderdate", "o_custkey", F.lag("o_orderkey").over(w).alias("prev"), F.lag("o_orderdate").over(w).alias("prev_date")).filter("prev IS NOT NULL")


def citations(t: Tables) -> DataFrame:
    spelled = S("CASE l_orderkey % 3 WHEN 0 THEN concat('P', l_partkey) WHEN 1 THEN concat('https://doi.org/10.1000/P', l_partkey) ELSE concat('https://openalex.org/P', l_partkey) END")
    parts = t.lineitem.select(F.concat(F.lit("O"), "l_orderkey").alias("source_id"), spelled.alias("target_raw"))
    chain = previous_orders(t).select(F.concat(F.lit("O"), "o_orderkey").alias("source_id"), F.concat(F.lit("https://openalex.org/W"), "prev").alias("target_raw"))
    return parts.unionByName(chain).withColumn("audit_id", F.lit("graph"))


def part_pairs(t: Tables) -> DataFrame:
    """Parts that follow each other in an order (sorted), with that order."""
    w = W.partitionBy("l_orderkey").orderBy("l_partkey")
    parts = t.lineitem.select("l_orderkey", "l_partkey").distinct().withColumn("next", F.lead("l_partkey").over(w)).filter("next IS NOT NULL")
    return parts.select(F.lit("graph").alias("audit_id"), "l_orderkey", F.concat(F.lit("P"), "l_partkey").alias("paper_a"), F.concat(F.lit("P"), "next").alias("paper_b"))


def pairs(t: Tables) -> DataFrame:
    chain = previous_orders(t).select(F.lit("graph").alias("audit_id"), F.concat(F.lit("O"), "o_orderkey").alias("paper_a"), F.concat(F.lit("O"), "prev").alias("paper_b"))
    return part_pairs(t).select("audit_id", "paper_a", "paper_b").distinct().unionByName(chain)


GRAPH_SQL = """WITH cnt AS (SELECT l_partkey AS p, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
 op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
 adj AS (SELECT o, p AS a, lead(p) OVER (PARTITION BY o ORDER BY p) AS b FROM op),
 pp AS (SELECT DISTINCT a, b FROM adj WHERE b IS NOT NULL),
 prev AS (SELECT * FROM (SELECT o_orderkey AS o, o_orderdate::date AS d, o_custkey AS c, lag(o_orderkey) OVER w AS q, lag(o_orderdate::date) OVER w AS qd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE q IS NOT NULL),
 co AS (SELECT pp.a, pp.b, x.o FROM pp JOIN op x ON x.p = pp.a JOIN op y ON y.o = x.o AND y.p = pp.b),
 st AS (SELECT o_orderkey AS o, CASE WHEN o_orderdate::date <= DATE '1998-06-01' THEN 'ELIGIBLE' ELSE 'POST_CUTOFF' END AS status FROM orders),
 cob AS (SELECT 'P' || a AS paper_a, 'P' || b AS paper_b, 'O' || co.o AS source_paper_id, status AS cutoff_status, 'CO_CITATION' AS kind, CASE WHEN greatest(c1.n, c2.n) >= 38 THEN 'HIGH_BASE_RATE' ELSE 'PASSED' END AS base_rate_status, c1.n AS ca, c2.n AS cb
   FROM co JOIN st USING (o) JOIN cnt c1 ON c1.p = a JOIN cnt c2 ON c2.p = b),
 dib AS (SELECT 'O' || prev.o AS paper_a, 'O' || q AS paper_b, 'O' || prev.o AS source_paper_id, status AS cutoff_status, 'DIRECT_CITATION' AS kind, 'NOT_APPLICABLE' AS base_rate_status, NULL::bigint AS ca, NULL::bigint AS cb FROM prev JOIN st USING (o)),
 allb AS (SELECT *, CASE WHEN cutoff_status = 'ELIGIBLE' THEN kind ELSE 'LANDSCAPE_BRIDGE' END AS type, CASE WHEN cutoff_status <> 'ELIGIBLE' THEN kind END AS underlying_type FROM (SELECT * FROM cob UNION ALL SELECT * FROM dib))
"""


def _found(t: Tables) -> DataFrame:
    return bridges.find_bridges(pairs(t), cut_lineage(works(t)), citations(t), THRESHOLD)


@query("brg_find", GRAPH_SQL + "SELECT paper_a, paper_b, type, underlying_type, source_paper_id, cutoff_status, base_rate_status, ca AS citation_count_a, cb AS citation_count_b FROM allb")
def brg_find(t: Tables) -> DataFrame:
    f = _found(t)
    return f.select(
        F.col("paper_ids")[0].alias("paper_a"), F.col("paper_ids")[1].alias("paper_b"), "type", "underlying_type", "source_paper_id", "cutoff_status", "base_rate_status", "citation_count_a", "citation_count_b"
    )


@query(
    "brg_summary",
    GRAPH_SQL
    + """SELECT paper_a, paper_b, count(*) FILTER (type <> 'LANDSCAPE_BRIDGE') AS graph_bridges, count(*) FILTER (type = 'LANDSCAPE_BRIDGE') AS landscape_bridges,
   coalesce(bool_or(type <> 'LANDSCAPE_BRIDGE' AND base_rate_status <> 'HIGH_BASE_RATE'), false) AS textual_bridge_required FROM allb GROUP BY 1, 2""",
)
def brg_summary(t: Tables) -> DataFrame:
    return bridges.bridge_summary(_found(t)).drop("audit_id")


@query(
    "brg_alias",
    """WITH a AS (SELECT 'P' || p_partkey AS paper_id, unnest([p_name, 'P' || p_partkey, 'p' || p_partkey, '10.1000/p' || p_partkey]) AS alias FROM part),
 u AS (SELECT alias, min(paper_id) AS paper_id FROM a GROUP BY 1 HAVING count(DISTINCT paper_id) = 1)
 SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 2 = 0 THEN coalesce(u.paper_id, p_name) ELSE 'P' || l_partkey END AS resolved
 FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN u ON u.alias = p_name""",
)
def brg_alias(t: Tables) -> DataFrame:
    named = t.part.select(
        F.lit("x").alias("audit_id"), F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("canonical_key"), F.concat(F.lit("10.1000/P"), "p_partkey").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"),
        F.create_map().cast("map<string,string>").alias("provider_ids"),
    )
    lines = t.lineitem.join(t.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    raw = S("CASE WHEN l_orderkey % 2 = 0 THEN p_name ELSE concat('doi:10.1000/P', l_partkey, '.') END")
    lines = lines.select(F.lit("x").alias("audit_id"), "l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return bridges.resolve_ids(lines, "raw", bridges.alias_index(named), "resolved").select("l_orderkey", "l_linenumber", "l_partkey", "resolved")


@query(
    "brg_route",
    GRAPH_SQL
    + """, sub AS (SELECT o, a, b, CASE WHEN o % 4 = 0 THEN o + 1 ELSE o END AS src FROM adj WHERE b IS NOT NULL),
 known AS (SELECT o_orderkey AS o FROM orders)
 SELECT sub.o || '-' || a || '-' || b AS bridge_id, (src IN (SELECT o FROM known) AND x.p IS NOT NULL AND y.p IS NOT NULL) AS route_exists
 FROM sub LEFT JOIN op x ON x.o = src AND x.p = a LEFT JOIN op y ON y.o = src AND y.p = b
 UNION ALL SELECT 'D' || o, true FROM prev""",
)
def brg_route(t: Tables) -> DataFrame:
    p = part_pairs(t)
    co = p.select(
        "audit_id", F.concat_ws("-", "l_orderkey", S("substring(paper_a, 2)"), S("substring(paper_b, 2)")).alias("bridge_id"), F.array("paper_a", "paper_b").alias("paper_ids"),
        S("concat('O', CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey + 1 ELSE l_orderkey END)").alias("source_paper_id"),
    )
    chain = previous_orders(t).select(F.lit("graph").alias("audit_id"), F.concat(F.lit("D"), "o_orderkey").alias("bridge_id"), S("array(concat('W', prev), concat('O', o_orderkey))").alias("paper_ids"), F.concat(F.lit("W"), "o_orderkey").alias("source_paper_id"))
    return bridges.route_exists(co.unionByName(chain), cut_lineage(works(t)), citations(t)).select("bridge_id", "route_exists")


@query(
    "brg_promote",
    """SELECT o_orderkey::varchar AS bridge_id, CASE WHEN o_orderkey % 5 = 3 THEN 'no textual bridge type: DIRECT_CITATION' WHEN o_orderkey % 3 = 0 THEN 'no evidence ids to promote the bridge' END AS reason,
   CASE WHEN o_orderkey % 5 <> 3 AND o_orderkey % 3 <> 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'EXPLICIT_EXTENSION' WHEN 1 THEN 'SHARED_BENCHMARK' WHEN 2 THEN 'TAXONOMY_BRIDGE' ELSE 'SYNTHESIS_BRIDGE' END END AS type FROM orders""",
)
def brg_promote(t: Tables) -> DataFrame:
    cand = t.orders.select(F.lit("x").alias("audit_id"), F.col("o_orderkey").cast("string").alias("bridge_id"), F.lit("CO_CITATION").alias("type"), F.lit(False).alias("text_verified"), F.array().cast("array<string>").alias("evidence_ids"))
    kinds = S("element_at(array('explicit_extension', 'SHARED_benchmark', 'TAXONOMY_BRIDGE', 'DIRECT_CITATION', 'synthesis_bridge'), cast(o_orderkey % 5 + 1 AS int))")
    asks = t.orders.select(F.lit("x").alias("audit_id"), F.col("o_orderkey").cast("string").alias("bridge_id"), kinds.alias("bridge_type"), S("CASE WHEN o_orderkey % 3 = 0 THEN cast(array() AS array<string>) ELSE array(o_orderstatus) END").alias("promoted_evidence_ids"))
    good, bad = bridges.promote(cand, asks)
    return good.select("bridge_id", F.lit(None).cast("string").alias("reason"), "type").unionByName(bad.select("bridge_id", "reason", F.lit(None).cast("string").alias("type")))


@query(
    "brg_policy",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'SENSITIVITY_CHECKED' WHEN c_custkey % 6 = 1 THEN 'DOCUMENTED_OVERRIDE' WHEN c_custkey % 6 = 2 THEN 'CALIBRATION_DECLARED' END AS status,
   CASE WHEN c_custkey % 6 IN (3, 4) THEN 'own threshold without a source' WHEN c_custkey % 6 = 5 THEN 'declared calibration is incomplete' END AS reason FROM customer""",
)
def brg_policy(t: Tables) -> DataFrame:
    k = "c_custkey % 6"
    p = t.customer.select(
        "c_custkey", F.col("c_custkey").cast("string").alias("audit_id"), S(f"CASE WHEN {k} IN (0, 4) THEN 500 ELSE 100 END").alias("high_citation_threshold"), S(f"CASE WHEN {k} IN (1, 2, 5) THEN c_name END").alias("source"),
        S(f"CASE WHEN {k} IN (2, 4, 5) THEN c_mktsegment END").alias("dataset"), S(f"CASE WHEN {k} = 2 THEN 'method' END").alias("method"), S(f"CASE WHEN {k} IN (2, 5) THEN true END").alias("preregistered"),
    )
    good, bad = bridges.label_policies(p)
    return good.select("c_custkey", "status", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("c_custkey", F.lit(None).cast("string").alias("status"), "reason"))


# ------------------------------------------------------------------ dates


def dated_orders(t: Tables) -> DataFrame:
    ship = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("ship"))
    o = t.orders.join(ship, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    own = S("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 2 THEN date_format(o_orderdate, 'yyyy') END")

    def entry(value, source):
        return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("boolean").alias("verified")))

    dates_ = F.array_compact(F.array(entry(F.col("ship").cast("string"), "publication"), entry(own, "arxiv_v1")))
    year = S("CASE WHEN o_orderkey % 8 = 3 THEN cast(year(o_orderdate) AS string) END")
    return o.select(F.lit("dates").alias("audit_id"), F.col("o_orderkey").alias("id"), dates_.alias("dates"), year.alias("year"))


DATES_SQL = """WITH s AS (SELECT l_orderkey, min(l_shipdate)::date AS ship FROM lineitem GROUP BY 1),
 o AS (SELECT o_orderkey AS id, o_orderdate::date AS d, o_orderkey % 4 AS k, ship, CASE o_orderkey % 4 WHEN 1 THEN date_trunc('month', o_orderdate)::date WHEN 2 THEN make_date(year(o_orderdate), 1, 1) END AS lo FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
 r AS (SELECT id, k, ship, lo, d, CASE WHEN k = 0 THEN CASE WHEN ship < d THEN ship ELSE d END WHEN ship IS NULL THEN NULL WHEN lo <= ship THEN NULL ELSE ship END AS e FROM o),
 f AS (SELECT id, e AS earliest_public_date, CASE WHEN e IS NULL THEN 'DATE_UNCERTAIN' ELSE 'RESOLVED' END AS date_status, CASE WHEN e IS NULL THEN 'DATE_UNCERTAIN' WHEN e <= DATE '1998-06-01' THEN 'ELIGIBLE' ELSE 'POST_CUTOFF' END AS cutoff_status,
   CASE WHEN e IS NOT NULL THEN CASE WHEN k = 0 AND NOT coalesce(ship < d, false) THEN 'arxiv_v1' ELSE 'publication' END WHEN k IN (1, 2) THEN 'arxiv_v1' WHEN id % 8 = 3 THEN 'year_only' END AS provenance FROM r)
"""


def _cut(t: Tables) -> DataFrame:
    audits = t.rows([("dates", CUTOFF)], "audit_id string, cutoff string")
    return dates.apply_cutoff(dated_orders(t), audits)[0]


@query("dat_cutoff", DATES_SQL + "SELECT id, earliest_public_date, date_status, cutoff_status, provenance FROM f")
def dat_cutoff(t: Tables) -> DataFrame:
    return _cut(t).select("id", "earliest_public_date", "date_status", "cutoff_status", F.col("date_provenance.source").alias("provenance"))


@query("met_leakage", DATES_SQL + "SELECT round(avg(CASE WHEN cutoff_status = 'ELIGIBLE' THEN 0.0 ELSE 1.0 END), 6) AS leakage FROM f")
def met_leakage(t: Tables) -> DataFrame:
    return temporal_leakage(_cut(t)).select(F.round("leakage", 6).alias("leakage"))


@query(
    "dat_cutoff_reject",
    """SELECT c_custkey::varchar AS audit_id, CASE c_custkey % 4 WHEN 1 THEN '2025' WHEN 2 THEN '2025-09' ELSE '' END AS value FROM customer WHERE c_custkey % 4 IN (1, 2, 3)""",
)
def dat_cutoff_reject(t: Tables) -> DataFrame:
    audits = t.customer.select(F.col("c_custkey").cast("string").alias("audit_id"), S("CASE c_custkey % 4 WHEN 0 THEN '2025-09-18' WHEN 1 THEN '2025' WHEN 2 THEN '2025-09' ELSE '' END").alias("cutoff"))
    return dates.apply_cutoff(dated_orders(t), audits)[1].select("audit_id", "value")


@query(
    "dat_window",
    GRAPH_SQL
    + """SELECT 'O' || o AS paper_a, 'O' || q AS paper_b, (DATE '1998-06-01' - greatest(d, qd))::int AS days, CASE WHEN DATE '1998-06-01' - greatest(d, qd) < 0 THEN 'POST_CUTOFF_ENDPOINT' WHEN DATE '1998-06-01' - greatest(d, qd) < 548 THEN 'BELOW_DIAGNOSTIC_THRESHOLD' ELSE 'MEETS_DIAGNOSTIC_THRESHOLD' END AS status,
   CASE WHEN DATE '1998-06-01' - greatest(d, qd) < 0 THEN 'POST_CUTOFF_PRIOR' WHEN DATE '1998-06-01' - greatest(d, qd) <= 180 THEN '0_TO_6_MONTHS' WHEN DATE '1998-06-01' - greatest(d, qd) <= 365 THEN '6_TO_12_MONTHS' WHEN DATE '1998-06-01' - greatest(d, qd) <= 548 THEN '12_TO_18_MONTHS'
     WHEN DATE '1998-06-01' - greatest(d, qd) <= 1095 THEN '18_TO_36_MONTHS' ELSE 'OVER_36_MONTHS' END AS bin FROM prev
   UNION ALL SELECT 'P' || a, 'P' || b, NULL, 'ENDPOINT_DATE_UNRESOLVED', 'UNKNOWN' FROM pp""",
)
def dat_window(t: Tables) -> DataFrame:
    p = pairs(t).withColumn("cutoff", F.lit(CUTOFF).cast("date"))
    out = dates.window_diagnostics(p, works(t))
    return out.select("paper_a", "paper_b", F.col("observation_window_days").alias("days"), F.col("observation_window_status").alias("status"), D.window_bin(F.col("observation_window_days")).alias("bin"))


# ------------------------------------------------------------------ versions


def short_name(key: str) -> Column:
    """Identifier as the twin of ``dat_versions_as_of`` spells it: keys beyond five digits are cut, so that orders share one."""
    return F.concat(F.lit("2001."), F.lpad(F.col(key).cast("string"), 5, "0"))


def own_name(key: str) -> Column:
    """The same for keys of five digits; larger ones go on in the following months, so that no two orders share one."""
    return S(arxiv_name(key))


def version_rows(t: Tables, name: Callable[[str], Column] = short_name) -> DataFrame:
    """Lines of an order by ship date are the versions of one arXiv work."""
    w = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    v = t.lineitem.select("l_orderkey", F.row_number().over(w).alias("version"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("submitted_at"), F.count("*").over(W.partitionBy("l_orderkey")).alias("n"))
    v = v.withColumn("base_id", name("l_orderkey")).withColumn("identifier", F.concat("base_id", F.lit("v"), "version"))
    return v.withColumn("pdf_url", S("concat(CASE WHEN l_orderkey % 3 = 0 THEN 'https://arxiv.org/pdf/' ELSE 'http://export.arxiv.org/pdf/' END, identifier, CASE WHEN l_orderkey % 3 = 1 THEN '.pdf' ELSE '' END)"))


def _version_struct():
    return F.struct("version", "identifier", "submitted_at", "pdf_url", F.lit(True).alias("verified"))


def histories(t: Tables, name: Callable[[str], Column] = short_name) -> DataFrame:
    """Complete histories, with version 2 missing for every tenth order."""
    kept = version_rows(t, name).filter("NOT (l_orderkey % 10 = 0 AND version = 2)")
    per = kept.groupBy("l_orderkey", "base_id").agg(F.collect_list(_version_struct()).alias("arxiv_versions"))
    return _record(per, F.lit(None).cast("int"), F.lit(False))


def local_records(t: Tables, name: Callable[[str], Column] = short_name) -> DataFrame:
    """What a provider record knows: the newest version only, vouched for on even orders."""
    newest = version_rows(t, name).filter("version = n").withColumn("arxiv_versions", F.array(_version_struct()))
    return _record(newest, F.col("n").cast("int"), F.col("l_orderkey") % 2 == 0)


def _record(df: DataFrame, version, vouched) -> DataFrame:
    return df.select(
        F.lit("v").alias("audit_id"), F.concat(F.lit("O"), "l_orderkey").alias("paper_id"), "base_id", F.lit(0).cast("bigint").alias("ordinal"), version.alias("arxiv_version"), vouched.alias("arxiv_latest_version_verified"), "arxiv_versions",
        F.array().cast("array<struct<value:string,source:string,url:string,verified:boolean>>").alias("dates"), F.array().cast("array<string>").alias("fulltext_urls"),
    )


def version_papers(t: Tables, name: Callable[[str], Column] = short_name) -> DataFrame:
    return t.orders.select(
        F.lit("v").alias("audit_id"), F.concat(F.lit("O"), "o_orderkey").alias("id"), F.concat(F.lit("arXiv:"), name("o_orderkey"), F.lit("v9")).alias("arxiv_id"),
        F.col("o_orderdate").cast("date").alias("cutoff"), S("CASE WHEN o_orderstatus = 'P' THEN 'POST_CUTOFF' ELSE 'ELIGIBLE' END").alias("cutoff_status"),
    )


VERSION_SQL = """WITH v AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS version, l_shipdate::date AS d, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
 h AS (SELECT * FROM v WHERE NOT (o % 10 = 0 AND version = 2)),
 s AS (SELECT o, max(version) AS latest, count(*) AS c FROM h GROUP BY 1),
 pick AS (SELECT h.o, max(version) AS version FROM h JOIN orders ON o_orderkey = h.o WHERE d <= o_orderdate::date GROUP BY 1)
"""


@query(
    "dat_versions_as_of",
    VERSION_SQL + "SELECT 'O' || pick.o AS paper_id, pick.version::int AS version, d AS submitted_at, 'https://arxiv.org/pdf/2001.' || lpad(pick.o::varchar, 5, '0') || 'v' || pick.version AS pdf_url FROM pick JOIN h ON h.o = pick.o AND h.version = pick.version",
)
def dat_versions_as_of(t: Tables) -> DataFrame:
    entries = versions.version_entries(histories(t))
    return versions.select_as_of(entries, version_papers(t).withColumnRenamed("id", "paper_id")).drop("audit_id")


@query(
    "dat_version_state",
    VERSION_SQL + "SELECT 'O' || o AS paper_id, latest::int AS latest, CASE WHEN o % 10 = 0 AND latest > 2 THEN '2' ELSE '' END AS missing, true AS monotonic FROM s",
)
def dat_version_state(t: Tables) -> DataFrame:
    state = versions.history_state(versions.version_entries(histories(t)))
    return state.select("paper_id", "latest", F.array_join("missing_versions", ",").alias("missing"), "monotonic")


@query(
    "dat_version_gaps",
    """WITH p AS (SELECT l_orderkey AS paper_id, max(l_linenumber) AS latest, count(*) - count(DISTINCT l_linenumber) AS duplicates, list_sort(list(DISTINCT l_linenumber)) AS have FROM lineitem GROUP BY 1),
 g AS (SELECT paper_id, v, coalesce(lag(v) OVER (PARTITION BY paper_id ORDER BY v), 0) + 1 AS a FROM (SELECT DISTINCT l_orderkey AS paper_id, l_linenumber AS v FROM lineitem)),
 m AS (SELECT paper_id, string_agg(CASE WHEN a = v - 1 THEN a::varchar ELSE a || '-' || (v - 1) END, ',' ORDER BY a) AS missing FROM g WHERE a < v GROUP BY 1)
 SELECT paper_id, latest, duplicates, coalesce(missing, '') AS missing FROM p LEFT JOIN m USING (paper_id)""",
)
def dat_version_gaps(t: Tables) -> DataFrame:
    out = versions.version_list_gaps(t.lineitem.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("version")))
    return out.select("paper_id", "latest", "duplicates", F.array_join("missing_versions", ",").alias("missing"))


@query(
    "dat_historical_source",
    VERSION_SQL
    + """, l AS (SELECT o, n, d FROM v WHERE version = n),
 k AS (SELECT o_orderkey AS o, o_orderdate::date AS cutoff, l.n, l.d AS last_d, s.latest, s.c, pick.version FROM orders LEFT JOIN l ON l.o = o_orderkey LEFT JOIN s ON s.o = o_orderkey LEFT JOIN pick ON pick.o = o_orderkey WHERE o_orderstatus <> 'P'),
 e AS (SELECT *, (o % 2 = 0 AND coalesce(last_d <= cutoff, false)) AS loc, CASE WHEN o % 2 = 0 AND coalesce(last_d <= cutoff, false) THEN NULL WHEN o % 2 = 0 AND n IS NOT NULL AND latest IS DISTINCT FROM n THEN 'history does not end at known version v' || n
   WHEN o % 10 = 0 AND latest > 2 THEN 'history has gaps at versions: 2' WHEN version IS NULL THEN 'no version was public by the cutoff' END AS error FROM k)
 SELECT 'O' || o AS paper_id, CASE WHEN error IS NULL THEN CASE WHEN loc THEN n ELSE version END END::int AS version, CASE WHEN error IS NULL THEN CASE WHEN loc THEN 'LOCAL_LATEST_VERSION_METADATA' ELSE 'ARXIV_API_COMPLETE_VERSION_HISTORY' END END AS selection_method,
   CASE WHEN error IS NULL THEN CASE WHEN loc THEN n = 1 ELSE true END END AS history_complete, error FROM e""",
)
def dat_historical_source(t: Tables) -> DataFrame:
    out = versions.historical_source(version_papers(t, own_name), local_records(t, own_name), histories(t, own_name))
    return out.select("paper_id", "version", "selection_method", "history_complete", "error")


# ------------------------------------------------------------------ expansion


def cut_calls(t: Tables) -> DataFrame:
    """Calls that a provider ended at its limit."""
    return t.part.filter("p_size = 17").select(
        F.lit("openalex").alias("provider"), F.lit("FORWARD").alias("direction"), F.concat(F.lit("p"), "p_partkey").alias("provider_id"), F.lit(200).alias("limit"), F.concat(F.lit("c"), "p_partkey").alias("next_token")
    )


def provider_papers(t: Tables) -> DataFrame:
    """Parts as endpoints known to one or both graph providers; dates from their first order."""
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    per = lines.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"), F.min("o_orderdate").cast("date").alias("first"))
    p = t.part.join(per, F.col("l_partkey") == F.col("p_partkey"), "left")
    return p.select(
        F.lit("graph").alias("audit_id"), F.concat(F.lit("P"), "p_partkey").alias("id"),
        S("CASE WHEN p_size % 5 = 0 THEN map() WHEN p_size % 5 = 1 THEN map('openalex', concat('p', p_partkey)) ELSE map('openalex', concat('p', p_partkey), 'semantic-scholar', concat('p', p_partkey)) END").cast("map<string,string>").alias("provider_ids"),
        S("CASE WHEN p_size % 5 = 0 AND p_size % 2 = 0 THEN array('openalex') ELSE array() END").cast("array<string>").alias("providers"),
        S("CASE WHEN p_size % 7 > 0 THEN n END").alias("citation_count"), S("CASE WHEN p_size % 11 > 0 THEN first END").alias("earliest_public_date"),
    )


def provider_edges(t: Tables) -> DataFrame:
    """Orders citing parts at both providers; the second one misses a third of the orders."""
    e = t.lineitem.select(F.concat(F.lit("O"), "l_orderkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), "l_orderkey").distinct()
    both = F.when(F.col("l_orderkey") % 3 == 0, F.array(F.lit("openalex"))).otherwise(F.array(F.lit("openalex"), F.lit("semantic-scholar")))
    refs = part_pairs(t).select(F.lower("paper_a").alias("source_id"), F.lower("paper_b").alias("target_id")).distinct().withColumn("provider", F.lit("openalex"))
    return e.select(F.explode(both).alias("provider"), "source_id", "target_id").unionByName(refs.select("provider", "source_id", "target_id"))


def provider_outages(t: Tables) -> DataFrame:
    return t.part.filter("p_size = 13").select(F.lit("semantic-scholar").alias("provider"), F.lit("FORWARD").alias("direction"), F.concat(F.lit("p"), "p_partkey").alias("provider_id"), F.lit("HTTP 503").alias("detail"))


def expansion_pairs(t: Tables) -> DataFrame:
    p = part_pairs(t).select("audit_id", "paper_a", "paper_b").distinct()
    override = S("CASE WHEN cast(substring(paper_a, 2) AS int) % 4 = 0 THEN array('openalex') ELSE array('openalex', 'semantic-scholar') END")
    return p.withColumn("cutoff", S(f"CASE WHEN cast(substring(paper_a, 2) AS int) % 9 > 0 THEN date'{CUTOFF}' END")).withColumn("selected", override)


def candidate_status(t: Tables) -> DataFrame:
    order = t.orders.select(F.explode(F.array(F.lit("openalex"), F.lit("semantic-scholar"))).alias("provider"), F.concat(F.lit("O"), "o_orderkey").alias("neighbour_id"), S(f"CASE WHEN cast(o_orderdate AS date) <= date'{CUTOFF}' THEN 'ELIGIBLE' ELSE 'POST_CUTOFF' END").alias("cutoff_status"))
    return order.withColumn("paper_id", F.col("neighbour_id"))


EXPANSION_SQL = """WITH cnt AS (SELECT l_partkey AS p, count(DISTINCT l_orderkey) AS n, min(o_orderdate)::date AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
 op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
 adj AS (SELECT o, p AS a, lead(p) OVER (PARTITION BY o ORDER BY p) AS b FROM op),
 pp AS (SELECT DISTINCT a, b FROM adj WHERE b IS NOT NULL),
 pr AS (SELECT p_partkey AS p, p_size AS z, CASE WHEN p_size % 7 > 0 THEN n END AS n, CASE WHEN p_size % 11 > 0 THEN f END AS f,
   CASE WHEN p_size % 5 > 0 THEN 'p' || p_partkey WHEN p_size % 2 = 0 THEN 'P' || p_partkey END AS oa, CASE WHEN p_size % 5 > 1 THEN 'p' || p_partkey END AS s2 FROM part LEFT JOIN cnt ON cnt.p = p_partkey),
 edges AS (SELECT 'openalex' AS provider, 'O' || o AS s, 'p' || p AS t FROM op UNION ALL SELECT 'semantic-scholar', 'O' || o, 'p' || p FROM op WHERE o % 3 <> 0 UNION ALL SELECT 'openalex', 'p' || a, 'p' || b FROM pp),
 base AS (SELECT pp.a, pp.b, x.z AS za, y.z AS zb, x.n AS na, y.n AS nb, x.f AS fa, y.f AS fb, x.oa AS oa_a, y.oa AS oa_b, CASE WHEN a % 4 > 0 THEN x.s2 END AS s2_a, CASE WHEN a % 4 > 0 THEN y.s2 END AS s2_b, x.s2 AS full_a, y.s2 AS full_b,
   CASE WHEN a % 9 > 0 THEN DATE '1998-06-01' END AS cutoff FROM pp JOIN pr x ON x.p = a JOIN pr y ON y.p = b),
 anc AS (SELECT a, b, unnest(CASE WHEN na IS NULL OR nb IS NULL THEN ['P' || a, 'P' || b] WHEN na < nb OR (na = nb AND 'P' || a < 'P' || b) THEN ['P' || a] ELSE ['P' || b] END) AS e FROM base),
 rt AS (SELECT a, b, 'P' || a AS e, 'openalex' AS provider, 'BACKWARD' AS direction, oa_a AS pid, NULL AS opid FROM base WHERE oa_a IS NOT NULL UNION ALL SELECT a, b, 'P' || b, 'openalex', 'BACKWARD', oa_b, NULL FROM base WHERE oa_b IS NOT NULL
   UNION ALL SELECT a, b, 'P' || a, 'semantic-scholar', 'BACKWARD', s2_a, NULL FROM base WHERE s2_a IS NOT NULL UNION ALL SELECT a, b, 'P' || b, 'semantic-scholar', 'BACKWARD', s2_b, NULL FROM base WHERE s2_b IS NOT NULL
   UNION ALL SELECT base.a, base.b, e, 'openalex', 'FORWARD', CASE WHEN e = 'P' || base.a THEN oa_a ELSE oa_b END, CASE WHEN e = 'P' || base.a THEN oa_b ELSE oa_a END FROM base JOIN anc USING (a, b) WHERE oa_a IS NOT NULL AND oa_b IS NOT NULL
   UNION ALL SELECT base.a, base.b, e, 'semantic-scholar', 'FORWARD', CASE WHEN e = 'P' || base.a THEN s2_a ELSE s2_b END, CASE WHEN e = 'P' || base.a THEN s2_b ELSE s2_a END FROM base JOIN anc USING (a, b) WHERE s2_a IS NOT NULL AND s2_b IS NOT NULL),
 outage AS (SELECT 'p' || p_partkey AS pid FROM part WHERE p_size = 13),
 rt2 AS (SELECT *, (provider = 'semantic-scholar' AND direction = 'FORWARD' AND pid IN (SELECT pid FROM outage)) AS failed FROM rt),
 deg AS (SELECT provider, 'BACKWARD' AS direction, s AS pid, count(*) AS total FROM edges GROUP BY 1, 3 UNION ALL SELECT provider, 'FORWARD', t, count(*) FROM edges GROUP BY 1, 3),
 calls AS (SELECT rt2.*, coalesce(total, 0) AS total, provider <> 'semantic-scholar' AND NOT (provider = 'openalex' AND direction = 'FORWARD' AND pid IN (SELECT 'p' || p_partkey FROM part WHERE p_size = 17)) AS done FROM rt2 LEFT JOIN deg USING (provider, direction, pid) WHERE NOT failed),
 fails AS (SELECT a, b, provider, direction, e FROM rt2 WHERE failed UNION ALL SELECT base.a, base.b, 'none', 'BACKWARD', x.e FROM base, unnest(['P' || base.a, 'P' || base.b]) AS x(e) WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.a = base.a AND rt.b = base.b AND rt.e = x.e AND direction = 'BACKWARD')
   UNION ALL SELECT anc.a, anc.b, 'none', 'FORWARD', anc.e FROM anc WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.a = anc.a AND rt.b = anc.b AND rt.e = anc.e AND direction = 'FORWARD')),
 fwd AS (SELECT provider, t AS pid, s AS nb FROM edges),
 cand AS (SELECT DISTINCT c.a, c.b, f.provider, f.nb FROM calls c JOIN fwd f ON f.provider = c.provider AND f.pid = c.pid AND c.direction = 'FORWARD' JOIN edges g ON g.provider = f.provider AND g.s = f.nb AND lower(g.t) = lower(CASE WHEN c.e = 'P' || c.a THEN 'P' || c.b ELSE 'P' || c.a END))
"""


def _expanded(t: Tables) -> dict[str, DataFrame]:
    pairs_, papers_, edges_ = (cut_lineage(f(t)) for f in (expansion_pairs, provider_papers, provider_edges))
    return expansion.expand_pairs(pairs_, papers_, edges_, provider_outages(t), candidate_status(t), cut_calls(t), ("semantic-scholar",))


def _ends(t: Tables, pairs_: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Ends of the pairs with what their calls show."""
    papers = cut_lineage(provider_papers(t))
    facts = cut_lineage(expansion.route_facts(papers, provider_edges(t) if edges is None else edges, provider_outages(t), cut_calls(t)))
    return expansion.pair_ends(pairs_, papers, facts)


def _calls(t: Tables, edges: DataFrame | None = None) -> DataFrame:
    return expansion.call_log(expansion.routes(_ends(t, expansion_pairs(t), edges)), ("semantic-scholar",))


@query(
    "grx_calls",
    EXPANSION_SQL
    + """SELECT 'P' || a AS paper_a, 'P' || b AS paper_b, provider, direction, e AS anchor_paper_id, pid AS provider_id, total::bigint AS returned_count, done AS exhausted, NOT done AS possibly_truncated,
   CASE WHEN provider = 'semantic-scholar' THEN 'UNREPORTED' WHEN NOT done THEN 'c' || substr(pid, 2) END AS next_token, CASE WHEN done THEN total END AS provider_total FROM calls""",
)
def grx_calls(t: Tables) -> DataFrame:
    return _calls(t).select(
        "paper_a", "paper_b", "provider", "direction", "anchor_paper_id", "provider_id", "returned_count", "exhausted", "possibly_truncated", "next_token", "provider_total"
    )


@query("grx_failures", EXPANSION_SQL + "SELECT 'P' || a AS paper_a, 'P' || b AS paper_b, provider, direction, e AS anchor_paper_id FROM fails")
def grx_failures(t: Tables) -> DataFrame:
    ends = cut_lineage(expansion.pair_ends(expansion_pairs(t), cut_lineage(provider_papers(t))))
    return expansion.call_failures(ends, provider_outages(t)).select("paper_a", "paper_b", "provider", "direction", "anchor_paper_id")


@query("grx_candidates", EXPANSION_SQL + "SELECT 'P' || a AS paper_a, 'P' || b AS paper_b, provider, nb AS paper_id FROM cand")
def grx_candidates(t: Tables) -> DataFrame:
    edges = cut_lineage(provider_edges(t))
    calls = cut_lineage(_calls(t, edges))
    hits = expansion.bridge_candidates(calls, edges)
    return hits.select("paper_a", "paper_b", "provider", F.col("neighbour_id").alias("paper_id"))


@query(
    "grx_observations",
    EXPANSION_SQL
    + """, ends AS (SELECT base.a, base.b, x.e FROM base, unnest(['P' || base.a, 'P' || base.b]) AS x(e)),
 ob AS (SELECT a, b, e, provider, total AS n FROM calls WHERE direction = 'BACKWARD' UNION ALL SELECT a, b, e, provider, NULL FROM fails WHERE direction = 'BACKWARD')
 SELECT 'P' || ends.a AS paper_a, 'P' || ends.b AS paper_b, ends.e AS paper_id, sum(n)::bigint AS returned, CASE WHEN sum(n) > 0 THEN 'NONEMPTY' WHEN bool_or(provider = 'none') OR sum(n) IS NULL THEN 'FAILED' ELSE 'EMPTY_AT_PROVIDER' END AS status,
   string_agg(provider || ':' || CASE WHEN n IS NULL THEN 'FAILED' WHEN n > 0 THEN 'NONEMPTY' ELSE 'EMPTY_AT_PROVIDER' END, ',' ORDER BY provider) AS detail
 FROM ends LEFT JOIN ob USING (a, b, e) GROUP BY 1, 2, 3""",
)
def grx_observations(t: Tables) -> DataFrame:
    pairs_ = cut_lineage(expansion_pairs(t))
    o = expansion.reference_observations(pairs_, _ends(t, pairs_))
    return o.select(
        "paper_a", "paper_b", "paper_id", F.col("provider_returned_count").alias("returned"), "status", F.array_join(F.transform("provider_observations", lambda p: F.concat_ws(":", p["provider"], p["status"])), ",").alias("detail")
    )


@query(
    "grx_expansions",
    EXPANSION_SQL
    + """, pc AS (SELECT a, b, bool_or(NOT done) AS cut FROM calls GROUP BY 1, 2), pf AS (SELECT a, b, count(*) AS n FROM fails GROUP BY 1, 2),
 hit AS (SELECT a, b, count(DISTINCT nb) AS cands, count(DISTINCT nb) FILTER (starts_with(nb, 'O') AND o_orderdate::date <= DATE '1998-06-01') AS hist FROM cand LEFT JOIN orders ON 'O' || o_orderkey = nb GROUP BY 1, 2),
 ne AS (SELECT base.a, base.b, bool_and(coalesce(x.n, 0) > 0) AS all_ne FROM base, unnest(['P' || base.a, 'P' || base.b]) AS q(e) LEFT JOIN (SELECT a, b, e, sum(total) AS n FROM calls WHERE direction = 'BACKWARD' GROUP BY 1, 2, 3) x ON x.a = base.a AND x.b = base.b AND x.e = q.e GROUP BY 1, 2),
 j AS (SELECT base.*, coalesce(pc.cut, false) AS cut, coalesce(pf.n, 0) AS nf, (a % 4 = 0 AND (full_a IS NOT NULL OR full_b IS NOT NULL)) AS omitted, coalesce(cands, 0) AS cands, CASE WHEN cutoff IS NULL THEN 0 ELSE coalesce(hist, 0) END AS hist, all_ne, (cutoff - greatest(fa, fb))::int AS w0 FROM base LEFT JOIN pc USING (a, b) LEFT JOIN pf USING (a, b) LEFT JOIN hit USING (a, b) LEFT JOIN ne USING (a, b)),
 k AS (SELECT *, CASE WHEN fa IS NULL OR fb IS NULL THEN NULL ELSE w0 END AS win, CASE WHEN nf > 0 THEN 'PROVIDER_FAILURE,' ELSE '' END || CASE WHEN cut THEN 'LIMIT_REACHED,' ELSE '' END || CASE WHEN omitted THEN 'PROVIDER_SCOPE_RESTRICTED,' ELSE '' END AS reasons FROM j)
 SELECT 'P' || a AS paper_a, 'P' || b AS paper_b, CASE WHEN reasons = '' THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, rtrim(reasons, ',') AS partial_reasons, win AS observation_window_days, cands::bigint AS candidates, hist::bigint AS historical,
   CASE WHEN na IS NULL OR nb IS NULL THEN 'CITATION_COUNT_INCOMPLETE_EXPAND_BOTH' ELSE 'LOWER_CITATION_COUNT' END AS anchor_selection,
   CASE WHEN cutoff IS NULL THEN 'NO_HISTORICAL_CUTOFF' WHEN reasons <> '' THEN 'INCOMPLETE_EXPANSION' WHEN hist > 0 THEN 'HISTORICAL_CANDIDATE_PRESENT' WHEN win IS NULL THEN 'NO_HISTORICAL_CANDIDATE_ENDPOINT_DATE_UNRESOLVED' WHEN win < 0 THEN 'NO_HISTORICAL_CANDIDATE_POST_CUTOFF_ENDPOINT'
     WHEN NOT all_ne THEN 'NO_HISTORICAL_CANDIDATE_PROVIDER_COVERAGE_LIMITED' ELSE 'NO_HISTORICAL_CANDIDATE_WITHIN_COMPLETE_EXPANSION' END AS scope FROM k""",
)
def grx_expansions(t: Tables) -> DataFrame:
    e = _expanded(t)["expansions"]
    return e.select(
        "paper_a", "paper_b", "status", F.array_join("partial_reasons", ",").alias("partial_reasons"), "observation_window_days", F.size("bridge_candidate_ids").cast("bigint").alias("candidates"),
        F.size("historical_bridge_candidate_ids").cast("bigint").alias("historical"), "anchor_selection", F.col("negative_result_scope").alias("scope"),
    )
