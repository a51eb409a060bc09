"""Search bookkeeping over events and documents.

View: an audit is a user, a run is (user, provider by hour, family by event
type), a page is a day of the run, the returned ids are the ``k`` of each event
with a value of at least 0.2 (the others were filtered locally).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import coverage, expansion, resolve, search
from ..operators.normalize import normalize_papers
from ..schemas import AUTHORS
from ..session import cut_lineage
from .registry import Tables, query
from .text_queries import TITLE_KEY_SQL

S = F.expr
PROVIDER = "CASE hour(ts) % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'semantic_scholar' ELSE CASE WHEN user_id % 11 = 0 THEN 'crossref' ELSE 'arxiv' END END"
FAMILY = "CASE event_type WHEN 'view' THEN 'literal' WHEN 'click' THEN 'mechanism' WHEN 'purchase' THEN 'problem_function' WHEN 'error' THEN 'ancestor' ELSE 'composition_bridge' END"


def run_events(t: Tables) -> DataFrame:
    e = t.events.select(
        F.col("user_id").cast("string").alias("audit_id"), "user_id", "event_id", "ts", "value", S(PROVIDER).alias("provider"), S(FAMILY).alias("family"), F.get_json_object("props", "$.k").alias("k"), F.col("ts").cast("date").alias("day")
    )
    return e.withColumn("query_id", F.concat_ws(":", "family", "provider"))


def pages(t: Tables) -> DataFrame:
    kept = F.col("value") >= 0.2
    ids = F.array_sort(F.collect_list(F.when(kept, F.struct("ts", "event_id", "k"))))
    per = run_events(t).groupBy("audit_id", "user_id", "query_id", "day").agg(F.count("*").alias("raw_returned_count"), F.count_if(kept).alias("returned_count"), ids.alias("_i"))
    w = W.partitionBy("audit_id", "query_id").orderBy("day")
    per = per.withColumn("page_index", F.row_number().over(w)).withColumn("last", F.lead("day").over(w).isNull())
    token = S("CASE WHEN NOT last THEN concat('d', page_index) WHEN user_id % 2 = 0 THEN NULL WHEN user_id % 4 = 1 THEN concat('d', page_index - 1) ELSE concat('d', page_index) END")
    return per.select("audit_id", "query_id", "page_index", token.alias("next_token"), "raw_returned_count", "returned_count", F.lit(None).cast("bigint").alias("total_count"), F.transform("_i", lambda i: i["k"]).alias("paper_ids"))


RUNS_SQL = """WITH e AS (SELECT user_id::varchar AS audit_id, user_id, event_id, ts, value, CASE hour(ts) % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'semantic_scholar' ELSE CASE WHEN user_id % 11 = 0 THEN 'crossref' ELSE 'arxiv' END END AS provider,
   CASE event_type WHEN 'view' THEN 'literal' WHEN 'click' THEN 'mechanism' WHEN 'purchase' THEN 'problem_function' WHEN 'error' THEN 'ancestor' ELSE 'composition_bridge' END AS family, json_extract_string(props, '$.k') AS k, ts::date AS day FROM events),
 q AS (SELECT *, family || ':' || provider AS query_id FROM e),
 pg AS (SELECT audit_id, user_id, query_id, day, count(*) AS raw, count_if(value >= 0.2) AS ret FROM q GROUP BY 1, 2, 3, 4),
 p AS (SELECT *, row_number() OVER w AS page, lead(day) OVER w IS NULL AS last FROM pg WINDOW w AS (PARTITION BY audit_id, query_id ORDER BY day)),
 pt AS (SELECT *, CASE WHEN NOT last THEN 'd' || page WHEN user_id % 2 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'd' || (page - 1) ELSE 'd' || page END AS token FROM p),
 occ AS (SELECT q.audit_id, q.query_id, q.k, page FROM q JOIN p ON p.audit_id = q.audit_id AND p.query_id = q.query_id AND p.day = q.day WHERE value >= 0.2),
 fresh AS (SELECT audit_id, query_id, page, count(*) AS nw FROM (SELECT *, min(page) OVER (PARTITION BY audit_id, query_id, k) AS f FROM occ) WHERE page = f GROUP BY 1, 2, 3),
 lg AS (SELECT pt.*, coalesce(nw, 0) AS nw, lag(token) OVER (PARTITION BY pt.audit_id, pt.query_id ORDER BY pt.page) AS asked FROM pt LEFT JOIN fresh USING (audit_id, query_id, page)),
 st AS (SELECT *, CASE WHEN token IS NULL THEN 'PROVIDER_EXHAUSTED' WHEN nw = 0 AND page > 1 AND raw <= ret THEN 'NO_NEW_RESULTS' WHEN token = asked THEN 'NO_NEW_RESULTS' END AS stop FROM lg),
 en AS (SELECT audit_id, query_id, min(page) FILTER (stop IS NOT NULL) AS e FROM st GROUP BY 1, 2),
 fold AS (SELECT audit_id, query_id, sum(nw)::bigint AS returned_count, max(page) AS pages_read, coalesce(max(stop) FILTER (page = e), 'PAGE_BUDGET_EXHAUSTED') AS stop FROM st JOIN en USING (audit_id, query_id) WHERE e IS NULL OR page <= e GROUP BY 1, 2),
 runs0 AS (SELECT audit_id, query_id, any_value(user_id) AS user_id, any_value(provider) AS provider, any_value(family) AS family, min(value) < 0.5 AS failed, min(event_id) AS ev FROM q GROUP BY 1, 2),
 runs AS (SELECT r.*, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS status, CASE WHEN failed THEN CASE WHEN ev % 2 = 0 THEN 'RATE_LIMIT' ELSE 'TIMEOUT' END END AS error_code, CASE WHEN failed THEN 0 ELSE f.returned_count END AS returned_count,
   NOT failed AND stop = 'PAGE_BUDGET_EXHAUSTED' AS truncated, CASE WHEN failed THEN 'PROVIDER_ERROR' ELSE stop END AS stop FROM runs0 r JOIN fold f USING (audit_id, query_id))
"""


@query("sch_pages", RUNS_SQL + "SELECT audit_id, query_id, returned_count, pages_read, stop AS saturation_stop_reason, stop = 'PAGE_BUDGET_EXHAUSTED' AS truncated FROM fold")
def sch_pages(t: Tables) -> DataFrame:
    return search.fold_pages(pages(t)).select("audit_id", "query_id", "returned_count", F.col("pages_read").cast("bigint").alias("pages_read"), "saturation_stop_reason", "truncated")


def runs(t: Tables) -> DataFrame:
    r = run_events(t).groupBy("audit_id", "query_id").agg(
        F.min("user_id").alias("user_id"), F.min("provider").alias("provider"), F.min("family").alias("family"), (F.min("value") < 0.5).alias("bad"), F.min("event_id").alias("ev")
    )
    errors = r.filter("bad").select("audit_id", "query_id", S("CASE WHEN ev % 2 = 0 THEN 'HTTP 429: slow down' ELSE 'URLError: timed out' END").alias("message"))
    base = r.select("audit_id", "user_id", "query_id", "provider", "family", F.lit(None).cast("date").alias("cutoff"), F.lit(False).alias("is_backstop"))
    out = search.account_runs(base, search.fold_pages(pages(t)), errors)
    return out.withColumn("corpus", S("CASE WHEN provider = 'openalex' THEN CASE WHEN user_id % 7 = 0 THEN 'core' ELSE 'all' END ELSE 'not_applicable' END")).withColumn("pagination", F.lit("{}"))


@query("sch_runs", RUNS_SQL + "SELECT audit_id, query_id, status, error_code, returned_count, truncated, stop AS saturation_stop_reason FROM runs")
def sch_runs(t: Tables) -> DataFrame:
    return runs(t).select("audit_id", "query_id", "status", "error_code", "returned_count", "truncated", "saturation_stop_reason")


@query(
    "sch_run_failures",
    RUNS_SQL
    + "SELECT audit_id, provider, CASE WHEN truncated THEN 'TRUNCATED' ELSE error_code END AS type, CASE WHEN truncated THEN query_id || ' stopped at page budget 10' WHEN ev % 2 = 0 THEN 'HTTP 429: slow down' ELSE 'URLError: timed out' END AS detail FROM runs WHERE failed OR truncated",
)
def sch_run_failures(t: Tables) -> DataFrame:
    return search.run_failures(runs(t))


@query(
    "sch_provider_states",
    RUNS_SQL
    + "SELECT audit_id, provider, CASE WHEN count_if(failed) = 0 THEN 'ok' WHEN count_if(NOT failed) > 0 THEN 'partial' ELSE 'failed' END AS status, count_if(NOT failed)::bigint AS successful_queries, count_if(failed)::bigint AS failed_queries FROM runs GROUP BY 1, 2",
)
def sch_provider_states(t: Tables) -> DataFrame:
    return search.provider_states(runs(t))


@query(
    "sch_overall",
    RUNS_SQL
    + """SELECT audit_id, CASE WHEN count_if(NOT failed) = 0 THEN 'FAILED' WHEN bool_or(failed OR truncated) THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, CASE WHEN count_if(NOT failed) = 0 THEN 'ALL_PROVIDERS_FAILED' WHEN bool_or(failed OR truncated) THEN 'BACKEND_DEGRADED' END AS error_code,
   bool_and(NOT failed AND stop IN ('PROVIDER_EXHAUSTED', 'NO_NEW_RESULTS')) AS saturated FROM runs GROUP BY 1""",
)
def sch_overall(t: Tables) -> DataFrame:
    r = runs(t)
    return search.overall_status(r).join(search.saturation(r), "audit_id")


def obligations(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id")).distinct().select(F.col("user_id").cast("string").alias("audit_id"), S("concat('o', user_id % 5)").alias("id"), S("CASE user_id % 5 WHEN 0 THEN 'INCOMPLETE' WHEN 1 THEN NULL ELSE 'COMPLETE' END").alias("status"))


def _listed(expr: str) -> str:
    return f"'[' || (SELECT string_agg('''' || x || '''', ', ' ORDER BY x) FROM unnest({expr}) AS u(x)) || ']'"


def coverage_sql(saturated: str = "sat") -> str:
    """The coverage derivation up to table ``lv``; ``saturated`` says where the saturation comes from."""
    return RUNS_SQL + f""", g AS (SELECT audit_id, any_value(user_id) AS user_id, coalesce(list(DISTINCT replace(provider, 'semantic_scholar', 'semantic-scholar')) FILTER (NOT failed), []) AS tried, coalesce(list(DISTINCT family) FILTER (NOT failed), []) AS fam, list(query_id) FILTER (failed) AS lf, list(query_id) FILTER (truncated) AS lt,
   list(query_id) FILTER (NOT failed AND stop = 'PAGE_BUDGET_EXHAUSTED') AS lu, list(query_id) FILTER (NOT failed AND provider = 'openalex' AND user_id % 7 = 0) AS lc, bool_and(NOT failed AND NOT truncated) AS sat FROM runs GROUP BY 1),
 h AS (SELECT *, list_filter(tried, lambda x: x <> 'crossref') AS prov, list_filter(['ancestor', 'composition_bridge', 'literal', 'mechanism', 'problem_function'], lambda x: NOT list_contains(fam, x)) AS miss FROM g),
 r AS (SELECT audit_id, prov, fam, list_filter([CASE WHEN len(prov) < 2 THEN 'fewer than two providers completed a query' END, CASE WHEN list_contains(tried, 'crossref') THEN 'unsupported primary search providers: [''crossref'']' END,
   CASE WHEN len(miss) > 0 THEN 'missing successful query families: ' || {_listed('miss')} END, CASE WHEN lf IS NOT NULL THEN 'failed query runs: ' || {_listed('lf')} END, CASE WHEN lt IS NOT NULL THEN 'truncated query runs: ' || {_listed('lt')} END,
   CASE WHEN lu IS NOT NULL THEN 'query runs lack a saturation stop: ' || {_listed('lu')} END, CASE WHEN user_id % 5 < 2 THEN 'incomplete search obligations: [''o' || user_id % 5 || ''']' END,
   CASE WHEN lc IS NOT NULL THEN 'OpenAlex did not search corpus=all: ' || {_listed('lc')} END, CASE WHEN NOT ({saturated}) THEN 'search saturation was not established' END], lambda x: x IS NOT NULL) AS reasons FROM h),
 lv AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'BROAD' WHEN len(prov) >= 2 AND len(fam) >= 3 THEN 'MODERATE' ELSE 'NARROW' END AS level FROM r)
"""


@query(
    "cov_levels",
    coverage_sql() + "SELECT audit_id, level, array_to_string(list_sort(prov), ',') AS providers, array_to_string(list_sort(fam), ',') AS families, array_to_string(reasons, '|') AS reasons FROM lv",
)
def cov_levels(t: Tables) -> DataFrame:
    r = runs(t)
    c = coverage.derive_coverage(search.saturation(r), r, obligations(t))
    return c.select("audit_id", "level", F.array_join("successful_providers", ",").alias("providers"), F.array_join("successful_families", ",").alias("families"), F.array_join("reasons", "|").alias("reasons"))


@query(
    "sch_page_arithmetic",
    """WITH p AS (SELECT o_orderkey AS id, o_custkey % 7 AS ret, o_orderkey % 5 AS k, o_custkey % 90 AS off, o_custkey AS total FROM orders),
 r AS (SELECT *, CASE WHEN k < 3 THEN ret + 2 ELSE ret END AS raw, CASE WHEN k = 4 AND off = 0 THEN 3 ELSE off END AS o FROM p)
 SELECT id, raw::bigint AS raw_count, (k = 0 OR k = 1 OR o + raw < total) AS page_truncated, CASE WHEN k = 0 THEN 'c' || id WHEN k = 1 THEN '7' WHEN o + raw < total AND raw > 0 THEN (o + raw)::varchar END AS next_token FROM r""",
)
def sch_page_arithmetic(t: Tables) -> DataFrame:
    p = t.orders.select(
        F.col("o_orderkey").alias("id"), S("o_custkey % 7").alias("returned_count"), S("CASE WHEN o_orderkey % 5 < 3 THEN o_custkey % 7 + 2 END").alias("raw_returned_count"), F.col("o_custkey").alias("total_count"),
        S("CASE WHEN o_orderkey % 5 = 0 THEN concat('c', o_orderkey) WHEN o_orderkey % 5 = 2 THEN '' END").alias("next_cursor"), S("CASE WHEN o_orderkey % 5 = 1 THEN 7 END").alias("next"), S("o_custkey % 90").alias("offset"), S("CASE WHEN o_orderkey % 5 = 4 THEN 3 END").alias("start"),
    )
    return search.page_arithmetic(p).select("id", F.col("raw_count").cast("bigint").alias("raw_count"), "page_truncated", "next_token")


@query(
    "sch_backstop",
    """WITH q AS (SELECT user_id::varchar AS audit_id, event_type, min(event_id) AS pos, user_id, max(value) > 200 AS flag FROM events GROUP BY 1, 2, 4),
 w AS (SELECT *, bool_or(flag) OVER (PARTITION BY audit_id) AS any_flag, coalesce(min(CASE WHEN event_type = 'error' THEN pos END) OVER (PARTITION BY audit_id), min(pos) OVER (PARTITION BY audit_id)) AS f FROM q)
 SELECT audit_id, event_type AS query_id, user_id % 6 <> 0 AND CASE WHEN any_flag THEN flag ELSE pos = f END AS is_backstop FROM w""",
)
def sch_backstop(t: Tables) -> DataFrame:
    q = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("pos"), (F.max("value") > 200).alias("flag"))
    q = q.select(
        F.col("user_id").cast("string").alias("audit_id"), F.col("event_type").alias("query_id"), "pos", S("CASE WHEN event_type = 'error' THEN 'ancestor' ELSE 'literal' END").alias("family"), S("CASE WHEN flag THEN true END").alias("temporal_recall_backstop"),
        S("CASE WHEN user_id % 6 <> 0 THEN date'2024-01-15' END").alias("cutoff"),
    )
    return search.choose_backstops(q).select("audit_id", "query_id", "is_backstop")


@query(
    "sch_plan_violations",
    """WITH c AS (SELECT c_custkey, c_custkey % 5 AS k, c_custkey % 103 AS lim, c_custkey % 104 AS mp FROM customer)
 SELECT c_custkey::varchar AS audit_id, NULL AS entity_id, 'plan without providers or queries' AS reason FROM c WHERE k = 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders)
 UNION ALL SELECT c_custkey::varchar, NULL, 'search plan limit must be an explicit integer between 1 and 100' FROM c WHERE lim = 0 OR lim > 100 UNION ALL SELECT c_custkey::varchar, NULL, 'search plan max_pages must be an integer between 1 and 100' FROM c WHERE mp = 0 OR mp > 100
 UNION ALL SELECT o_custkey::varchar, o_orderkey::varchar, 'planned query without query_id, family, query, reason, target_facets, removed_author_terms' FROM orders WHERE o_orderkey % 13 = 0""",
)
def sch_plan_violations(t: Tables) -> DataFrame:
    plans = t.customer.select(
        F.col("c_custkey").cast("string").alias("audit_id"), S("CASE WHEN c_custkey % 5 = 0 THEN cast(array() AS array<string>) ELSE array('openalex') END").alias("providers"), S("nullif(c_custkey % 103, 0)").alias("limit"), S("c_custkey % 104").alias("max_pages")
    )
    queries = t.orders.select(
        F.col("o_custkey").cast("string").alias("audit_id"), F.col("o_orderkey").cast("string").alias("query_id"), F.lit("literal").alias("family"), S("CASE WHEN o_orderkey % 13 > 0 THEN o_orderpriority END").alias("query"), F.lit("r").alias("reason"),
        F.array(F.lit("F1")).alias("target_facets"), F.lit(False).alias("removed_author_terms"),
    )
    return search.plan_violations(plans, queries)


@query(
    "sch_match",
    """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_.-]+')) AS ts FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_.-]+')) AS ds FROM documents)
 SELECT item_id AS query_key, doc_id FROM q, d WHERE list_has_all(ds, ts)""",
)
def sch_match(t: Tables) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("query_key"), search.terms("text").alias("terms"))
    return search.match_terms(q, t.documents.select("doc_id", search.terms("text").alias("terms")))


@query(
    "sch_top",
    """SELECT source AS query_id, doc_id, rn::int AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 5""",
)
def sch_top(t: Tables) -> DataFrame:
    hits = t.documents.select(F.lit("docs").alias("audit_id"), F.col("source").alias("query_id"), "doc_id", "n_chars")
    order = [F.desc("n_chars"), F.col("doc_id")]
    top = search.top_per_run(hits, 5, order)
    return top.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).alias("rank"))


@query(
    "sch_date_filter",
    """SELECT o_orderkey, l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey, l_shipdate::date AS d FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' OR d <= o_orderdate::date""",
)
def sch_date_filter(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", S("CASE WHEN o_orderstatus <> 'P' THEN cast(o_orderdate AS date) END").alias("cutoff"), (F.col("o_orderpriority") == "1-URGENT").alias("is_backstop"))
    hits = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("publication_date")).distinct().join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return search.within_cutoff(hits).select("o_orderkey", "l_partkey")


# ------------------------------------------------------------------ same work


def document_records(t: Tables) -> DataFrame:
    """Documents as records: the whole text is the title, the source the surname."""
    author = F.array(F.struct(F.col("source").alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("id"))).cast(AUTHORS)
    d = t.documents.select(
        F.lit("docs").alias("audit_id"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("D"), "doc_id").alias("id"), F.col("text").alias("title"), author.alias("authors"), F.array("lang").alias("providers"),
        F.array("lang", "source").alias("found_by_query_ids"), F.col("n_chars").alias("citation_count"),
    )
    return normalize_papers(d)


@query("ded_documents", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {TITLE_KEY_SQL}, source, CASE WHEN {TITLE_KEY_SQL} = '' THEN doc_id END) AS group_id FROM documents")
def ded_documents(t: Tables) -> DataFrame:
    g = resolve.group_works(document_records(t), fuzzy=False)
    return g.select(F.col("ordinal").alias("doc_id"), F.col("group_ordinal").alias("group_id"))


@query(
    "sch_lineage",
    f"""WITH g AS (SELECT doc_id, lang, source, min(doc_id) OVER (PARTITION BY {TITLE_KEY_SQL}, source, CASE WHEN {TITLE_KEY_SQL} = '' THEN doc_id END) AS gid FROM documents)
 SELECT DISTINCT query_id, 'D' || gid AS paper_id FROM (SELECT gid, unnest([lang, source]) AS query_id FROM g)""",
)
def sch_lineage(t: Tables) -> DataFrame:
    return search.run_lineage(resolve.group_works(document_records(t), fuzzy=False)).drop("audit_id")


def part_works(t: Tables) -> DataFrame:
    """Parts as records that repeat titles, surnames and identifiers a lot."""
    author = F.array(F.struct(F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("id"))).cast(AUTHORS)
    p = t.part.select(
        F.lit("parts").alias("audit_id"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("title"), author.alias("authors"),
        S("CASE WHEN p_partkey % 4 > 0 THEN cast(1970 + p_size AS string) END").alias("year"), S("CASE WHEN p_size % 9 = 0 THEN concat('10.5/', p_type, p_size) END").alias("doi"),
        S("CASE WHEN p_size % 8 = 0 THEN concat('2001.0000', p_size % 10) END").alias("arxiv_id"), F.array("p_type").alias("providers"), F.create_map("p_type", F.col("p_partkey").cast("string")).alias("provider_ids"),
        F.array(F.col("p_size").cast("string")).alias("references"), F.col("p_size").cast("bigint").alias("citation_count"), F.col("p_brand").alias("venue"), S("CASE WHEN p_size > 25 THEN repeat('x', p_size % 4) END").alias("abstract"),
    )
    return normalize_papers(p)


FIRST_FIT_SQL = """WITH RECURSIVE p AS (SELECT p_partkey AS i, p_name AS t, p_brand AS s, CASE WHEN p_partkey % 4 > 0 THEN 1970 + p_size END AS y, CASE WHEN p_size % 9 = 0 THEN '10.5/' || p_type || p_size END AS d, CASE WHEN p_size % 8 = 0 THEN p_size % 10 END AS a, p_type, p_size FROM part),
 e AS (SELECT x.i, y.i AS j FROM p x JOIN p y ON y.i < x.i AND x.d = y.d
   UNION SELECT x.i, y.i FROM p x JOIN p y ON y.i < x.i AND x.a = y.a AND (x.d IS NULL OR y.d IS NULL)
   UNION SELECT x.i, y.i FROM p x JOIN p y ON y.i < x.i AND x.t = y.t AND x.s = y.s AND (x.d IS NULL OR y.d IS NULL) AND (x.a IS NULL OR y.a IS NULL) AND (x.y IS NULL OR y.y IS NULL OR abs(x.y - y.y) <= 2)),
 r AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j),
 g AS (SELECT p.i, coalesce(min(r.j), p.i) AS g FROM p LEFT JOIN r ON r.i = p.i GROUP BY p.i)
"""


@query("ded_first_fit", FIRST_FIT_SQL + "SELECT i AS ordinal, g AS group_ordinal FROM g")
def ded_first_fit(t: Tables) -> DataFrame:
    return resolve.group_works(part_works(t), fuzzy=False).select("ordinal", "group_ordinal")


@query(
    "ded_merge",
    FIRST_FIT_SQL
    + """, m AS (SELECT g.g, p.*, CASE WHEN p_size > 25 AND p_size % 4 > 0 THEN repeat('x', p_size % 4) END AS ab FROM g JOIN p USING (i))
 SELECT 'P' || g AS id, count(*) AS version_count, max(p_size)::bigint AS citation_count, max(ab) AS abstract, arg_min(s, (-length(s), i)) AS venue, lower(arg_min(d, (-length(d), i))) AS doi, arg_min(y, i)::varchar AS year,
   (SELECT string_agg(pt, ',' ORDER BY f) FROM (SELECT p_type AS pt, min(i) AS f FROM m m2 WHERE m2.g = m.g GROUP BY 1)) AS providers, (SELECT string_agg(r::varchar, ',' ORDER BY f) FROM (SELECT p_size AS r, min(i) AS f FROM m m2 WHERE m2.g = m.g GROUP BY 1)) AS refs,
   (SELECT string_agg(pt || '=' || f, ',' ORDER BY pt) FROM (SELECT p_type AS pt, min(i) AS f FROM m m2 WHERE m2.g = m.g GROUP BY 1)) AS provider_ids FROM m GROUP BY g""",
)
def ded_merge(t: Tables) -> DataFrame:
    m = resolve.deduplicate(part_works(t), fuzzy=False)
    pids = F.array_sort(F.transform(F.map_entries("provider_ids"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return m.select("id", "version_count", "citation_count", "abstract", "venue", "doi", "year", F.array_join("providers", ",").alias("providers"), F.array_join("references", ",").alias("refs"), F.array_join(pids, ",").alias("provider_ids"))


@query(
    "ded_versions",
    FIRST_FIT_SQL
    + """SELECT 'P' || g.g AS id, count(*) AS version_count, string_agg('P' || i || ':' || coalesce(lower(d), '') || ':' || coalesce('2001.0000' || a, '') || ':' || p_type, ',' ORDER BY i) AS versions FROM g JOIN p USING (i) GROUP BY g.g""",
)
def ded_versions(t: Tables) -> DataFrame:
    """Merged works with the records behind them, in arrival order."""
    m = resolve.deduplicate(part_works(t), fuzzy=False, versions=True)
    shown = F.transform("versions", lambda v: F.concat_ws(":", v["id"], F.coalesce(v["doi"], F.lit("")), F.coalesce(v["arxiv_id"], F.lit("")), F.array_join(v["providers"], "+")))
    return m.select("id", "version_count", F.array_join(shown, ",").alias("versions"))


ADDED = 1 << 40  # places after all stored records
ADDED_SQL = FIRST_FIT_SQL.replace("p_partkey AS i", f"p_partkey + CASE WHEN p_partkey % 5 = 0 THEN {ADDED} ELSE 0 END AS i", 1)


@query("grx_merge", ADDED_SQL + f"SELECT 'P' || (g % {ADDED}) AS id, count(*) AS version_count, g >= {ADDED} AS is_new FROM g GROUP BY g")
def grx_merge(t: Tables) -> DataFrame:
    """Every fifth part arrives later and is merged into the stored groups of the others."""
    works = part_works(t)
    late = F.col("ordinal") % 5 == 0
    stored, added = works.filter(~late), works.filter(late).withColumn("ordinal", F.col("ordinal") + ADDED)
    groups = cut_lineage(resolve.group_works(stored, fuzzy=False).select("audit_id", "ordinal", "group_ordinal"))
    audits = works.select("audit_id").distinct().withColumn("cutoff", F.lit("2005-01-01"))
    merged, new = expansion.merge_additions(stored, added, audits, fuzzy=False, groups=groups)
    return merged.join(new.select("id", F.lit(True).alias("is_new")), "id", "left").select("id", "version_count", F.coalesce("is_new", F.lit(False)).alias("is_new"))


@query(
    "grx_log",
    """WITH e AS (SELECT o_custkey::varchar AS audit_id, 'P' || min(l_partkey) AS a, 'P' || max(l_partkey) AS b, max(o_orderpriority = '1-URGENT') AS urgent, max(o_orderstatus = 'F') AS old FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey)
 SELECT audit_id, count(*) FILTER (kind = 'log') AS logged, count(*) FILTER (kind = 'gap') AS gap_count, max(gap) AS last_gap
 FROM (SELECT audit_id, 'log' AS kind, NULL AS gap FROM e UNION ALL SELECT DISTINCT audit_id, 'gap', 'GRAPH_EXPANSION_INCOMPLETE:' || least(a, b) || ':' || greatest(a, b) FROM e WHERE urgent) GROUP BY 1""",
)
def grx_log(t: Tables) -> DataFrame:
    """Finished orders are the logged expansions of a customer, the others are appended; urgent ones are partial."""
    pairs = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(
        F.concat(F.lit("P"), F.min("l_partkey")).alias("paper_a"), F.concat(F.lit("P"), F.max("l_partkey")).alias("paper_b"),
        F.when(F.max(F.col("o_orderpriority") == "1-URGENT"), "PARTIAL").otherwise("COMPLETE").alias("status"), F.max(F.col("o_orderstatus") == "F").alias("old"),
    )
    rows = pairs.withColumn("audit_id", F.col("o_custkey").cast("string"))
    marker = expansion.gap_marker(F.least("paper_a", "paper_b"), F.greatest("paper_a", "paper_b")).alias("gap")
    gaps = rows.filter("old AND status = 'PARTIAL'").select("audit_id", marker)
    log, open_gaps = expansion.append_expansions(rows.filter("old"), rows.filter("NOT old").drop("old"), gaps)
    counted = log.groupBy("audit_id").agg(F.count("*").alias("logged"))
    per = open_gaps.groupBy("audit_id").agg(F.count("*").alias("gap_count"), F.max("gap").alias("last_gap"))
    return counted.join(per, "audit_id", "left").fillna(0, ["gap_count"])


def page_records(t: Tables) -> DataFrame:
    """Pages as records: the HTML title, the language as surname."""
    author = F.array(F.struct(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("id"))).cast(AUTHORS)
    return normalize_papers(
        t.pages.select(F.lit("pages").alias("audit_id"), F.col("page_id").alias("ordinal"), F.concat(F.lit("G"), "page_id").alias("id"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), author.alias("authors"))
    )


# Blocks part by part, as the matcher finds them; page titles are too short for popular characters.
SIMILAR_SQL = """tt AS (SELECT DISTINCT t, s FROM rec WHERE t <> '' AND s <> ''),
 cand AS (SELECT DISTINCT x.t AS a, y.t AS b FROM tt x JOIN tt y ON x.s = y.s AND x.t <> y.t AND abs(length(x.t) - length(y.t)) <= (length(x.t) + length(y.t)) * 0.03
   AND levenshtein(x.t, y.t) <= (length(x.t) + length(y.t)) * 0.03 + 1e-9),
 seg AS (SELECT a, b, 0::BIGINT AS al, length(a)::BIGINT AS ah, 0::BIGINT AS bl, length(b)::BIGINT AS bh, 0::BIGINT AS got FROM cand
   UNION ALL SELECT a, b, CASE c WHEN 0 THEN al ELSE i + k END, CASE c WHEN 0 THEN i ELSE ah END, CASE c WHEN 0 THEN bl ELSE j + k END, CASE c WHEN 0 THEN j ELSE bh END, CASE c WHEN 0 THEN k ELSE 0 END
   FROM (SELECT *, bl + strpos(part, substr(a, i + 1, k)) - 1 AS j, unnest([0, 1]) AS c
     FROM (SELECT *, list_filter(range(al, ah - k + 1), lambda x: contains(part, substr(a, x + 1, k)))[1] AS i
       FROM (SELECT *, coalesce(list_max(list_filter(range(1, least(ah - al, bh - bl) + 1), lambda n: len(list_filter(range(al, ah - n + 1), lambda x: contains(part, substr(a, x + 1, n)))) > 0)), 0) AS k
         FROM (SELECT *, substr(b, bl + 1, bh - bl) AS part FROM seg WHERE al < ah AND bl < bh)) WHERE k > 0))),
 sim AS (SELECT a, b FROM seg GROUP BY a, b HAVING 2.0 * sum(got) / (length(a) + length(b)) >= 0.97),
 e AS (SELECT x.i, y.i AS j FROM rec x JOIN rec y ON y.i < x.i AND x.s = y.s AND x.t = y.t WHERE x.t <> '' AND x.s <> ''
   UNION SELECT x.i, y.i FROM rec x JOIN sim ON sim.a = x.t JOIN rec y ON y.t = sim.b AND y.i < x.i AND x.s = y.s WHERE x.s <> ''),
 r AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j)
 SELECT 'G' || rec.i AS id, rec.i::BIGINT AS ordinal, coalesce(min(r.j), rec.i)::BIGINT AS group_ordinal FROM rec LEFT JOIN r ON r.i = rec.i GROUP BY rec.i"""
PAGE_SQL = rf"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS text, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS s FROM pages"""


@query("ded_similar_pages", f"WITH RECURSIVE rec AS (SELECT page_id AS i, {TITLE_KEY_SQL} AS t, s FROM ({PAGE_SQL})),\n {SIMILAR_SQL}")
def ded_similar_pages(t: Tables) -> DataFrame:
    return resolve.group_works(page_records(t)).select("id", "ordinal", "group_ordinal")


def page_spellings(t: Tables) -> DataFrame:
    """Every page twice: as it is, and as a second provider spells its title, with one letter lost or doubled."""
    at = "1 + cast(page_id % greatest(length(text), 1) AS int)"
    pages = t.pages.withColumn("text", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    spelled = pages.withColumn(
        "spelled",
        S(f"CASE WHEN page_id % 2 = 0 THEN concat(substr(text, 1, {at} - 1), substr(text, {at} + 1)) ELSE concat(substr(text, 1, {at}), substr(text, {at})) END"),
    )
    author = F.struct(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("id"))
    twice = spelled.select("page_id", F.array(author).cast(AUTHORS).alias("authors"), F.posexplode(F.array("text", "spelled")).alias("k", "title"))
    ordinal = F.col("page_id") * 2 + F.col("k")
    return normalize_papers(twice.select(F.lit("pages").alias("audit_id"), ordinal.alias("ordinal"), F.concat(F.lit("G"), ordinal).alias("id"), "title", "authors"))


SPELLING_SQL = f"""SELECT page_id * 2 + k AS i, s, CASE WHEN k = 0 THEN text WHEN page_id % 2 = 0 THEN substr(text, 1, spot - 1) || substr(text, spot + 1) ELSE substr(text, 1, spot) || substr(text, spot) END AS text
   FROM (SELECT *, 1 + (page_id % greatest(length(text), 1))::INT AS spot, unnest([0, 1]) AS k FROM ({PAGE_SQL}))"""


@query("ded_similar_spellings", f"WITH RECURSIVE rec AS (SELECT i, {TITLE_KEY_SQL} AS t, s FROM ({SPELLING_SQL})),\n {SIMILAR_SQL}")
def ded_similar_spellings(t: Tables) -> DataFrame:
    return resolve.group_works(page_spellings(t)).select("id", "ordinal", "group_ordinal")


@query(
    "ded_mentions",
    """WITH RECURSIVE m AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i, l_partkey AS p, l_suppkey AS s, l_returnflag AS rf, l_linestatus AS ls, l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 e AS (SELECT x.c, x.i, y.i AS j FROM m x JOIN m y ON x.c = y.c AND y.i < x.i AND x.p = y.p UNION SELECT x.c, x.i, y.i FROM m x JOIN m y ON x.c = y.c AND y.i < x.i AND x.s = y.s AND x.rf = 'R' AND y.rf = 'R'),
 r AS (SELECT c, i, j FROM e UNION SELECT r.c, r.i, e.j FROM r JOIN e ON e.c = r.c AND e.i = r.j),
 g AS (SELECT m.c, m.i, coalesce(min(r.j), m.i) AS g FROM m LEFT JOIN r ON r.c = m.c AND r.i = m.i GROUP BY m.c, m.i)
 SELECT g.c::varchar AS case_id, g.g AS group_ordinal, count(*) AS mention_count, arg_min(p, i) AS openalex_id, string_agg(DISTINCT ls, ',' ORDER BY ls) AS link_methods FROM g JOIN m USING (c, i) GROUP BY 1, 2""",
)
def ded_mentions(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    none = F.lit(None).cast("string")
    m = lines.select(
        F.col("o_custkey").cast("string").alias("audit_id"), n.cast("bigint").alias("ordinal"), none.alias("title"), F.col("l_partkey").alias("openalex_id"), S("CASE WHEN l_returnflag = 'R' THEN cast(l_suppkey AS string) END").alias("s2_id"),
        none.alias("doi"), none.alias("arxiv"), F.array("l_linestatus").alias("link_methods"),
    ).withColumn("openalex_id", F.col("openalex_id").cast("string"))
    out = resolve.merge_mentions(m)
    return out.select(F.col("audit_id").alias("case_id"), "group_ordinal", "mention_count", F.col("openalex_id").cast("bigint").alias("openalex_id"), F.array_join("link_methods", ",").alias("link_methods"))
