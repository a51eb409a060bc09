"""Claims, coverage, minimal sets and verdicts over the driver tables.

View: a claim is a brand, a facet is a part type within a size class, a paper is a
supplier within the brand, and every line item is evidence (returned R = EXACT,
accepted A = FUNCTIONAL, otherwise PARTIAL). A supplier's date is its first order for
the brand; the cutoff differs by brand. Adjacent suppliers of one order are candidate
pairs bridged by that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import expansion, setcover, verdict
from ..operators.bridges import base_rate_status, set_strength
from .registry import Tables, query

S = F.expr
CUTOFF = "make_date(1996 + cast(substring_index(p_brand, '#', -1) AS int) % 4, 1, 1)"
SUPPLIER_THRESHOLD = 600


FACET = "concat(p_type, '-', p_size % 8)"


def facets(t: Tables) -> DataFrame:
    """Facets of a brand in a fixed order; the first one to six are critical, by turns structurally."""
    own = t.part.select(F.col("p_brand").alias("audit_id"), S(FACET).alias("facet_id")).distinct()
    numbered = own.withColumn("rn", F.row_number().over(W.partitionBy("audit_id").orderBy(F.md5(F.concat("audit_id", "facet_id")))))
    numbered = numbered.withColumn("used", S("rn <= 1 + cast(substring_index(audit_id, '#', -1) AS int) % 6"))
    return numbered.select(
        "audit_id", "facet_id", S("CASE WHEN rn % 6 = 0 THEN 'outcome' ELSE 'mechanism' END").alias("type"), F.col("facet_id").alias("text"),
        S("used AND rn % 2 = 1").alias("critical"), S("used AND rn % 2 = 0").alias("structural_critical"),
    )


def coverage(t: Tables) -> DataFrame:
    """What every supplier covers of a brand, from all its lines."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select(
        F.col("p_brand").alias("audit_id"), F.concat(F.lit("S"), "l_suppkey").alias("paper_id"), S(FACET).alias("facet_id"), "l_returnflag",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus").alias("evidence_id"),
    )
    status = F.when(F.bool_or(F.col("l_returnflag") == "R"), "EXACT").when(F.bool_or(F.col("l_returnflag") == "A"), "FUNCTIONAL").otherwise("PARTIAL")
    return lines.groupBy("audit_id", "paper_id", "facet_id").agg(status.alias("status"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))


def papers(t: Tables) -> DataFrame:
    dated = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    per = dated.groupBy("p_brand", "l_suppkey").agg(F.min("o_orderdate").cast("date").alias("earliest_public_date"))
    return per.select(
        F.col("p_brand").alias("audit_id"), F.concat(F.lit("S"), "l_suppkey").alias("id"), "earliest_public_date", S(CUTOFF).alias("cutoff"),
        S(f"CASE WHEN earliest_public_date <= {CUTOFF} THEN 'ELIGIBLE' ELSE 'POST_CUTOFF' END").alias("cutoff_status"),
    )


def bridges(t: Tables) -> DataFrame:
    """Adjacent suppliers of an order, bridged by it for the brands of both lines."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand")
    lines = lines.withColumn("s2", F.lead("l_suppkey").over(w)).withColumn("b2", F.lead("p_brand").over(w)).filter("s2 <> l_suppkey")
    flat = lines.select(
        "l_orderkey", F.least("l_suppkey", "s2").alias("a"), F.greatest("l_suppkey", "s2").alias("b"), F.explode(F.array_distinct(F.array("p_brand", "b2"))).alias("p_brand")
    ).distinct()
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n"))
    flat = flat.join(counts.select(F.col("l_suppkey").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("l_suppkey").alias("b"), F.col("n").alias("nb")), "b")
    flat = flat.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority"), "l_orderkey")
    flat = flat.withColumn("status", S(f"CASE WHEN cast(o_orderdate AS date) <= {CUTOFF} THEN 'ELIGIBLE' ELSE 'POST_CUTOFF' END")).withColumn("text", F.col("o_orderpriority") == "1-URGENT")
    kind = F.when(F.col("status") != "ELIGIBLE", "LANDSCAPE_BRIDGE").when(F.col("text"), "SYNTHESIS_BRIDGE").otherwise("CO_CITATION")
    return flat.select(
        F.col("p_brand").alias("audit_id"), kind.alias("type"), F.when(F.col("status") != "ELIGIBLE", "CO_CITATION").alias("underlying_type"), F.when(F.col("text"), "text").otherwise("graph").alias("provenance_type"),
        F.array(F.concat(F.lit("S"), "a"), F.concat(F.lit("S"), "b")).alias("paper_ids"), F.concat(F.lit("O"), "l_orderkey").alias("source_paper_id"), F.col("status").alias("cutoff_status"),
        (~F.col("text")).alias("graph_verified"), F.col("text").alias("text_verified"), F.when(F.col("text"), F.array(F.col("l_orderkey").cast("string"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
        base_rate_status(F.lit("CO_CITATION"), F.col("na"), F.col("nb"), F.lit(SUPPLIER_THRESHOLD)).alias("base_rate_status"),
    )


VIEW_SQL = """WITH brand AS (SELECT DISTINCT p_brand AS audit_id, split_part(p_brand, '#', 2)::int AS n FROM part),
 every AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY md5(audit_id || facet_id)) AS rn FROM (SELECT DISTINCT p_brand AS audit_id, p_type || '-' || (p_size % 8) AS facet_id FROM part)),
 facets AS (SELECT audit_id, facet_id, rn - 1 AS b FROM every JOIN brand USING (audit_id) WHERE rn <= 1 + n % 6),
 fullm AS (SELECT audit_id, bit_or(1::bigint << b::int) AS f FROM facets GROUP BY 1),
 lines AS (SELECT p_brand AS audit_id, 'S' || l_suppkey AS paper_id, p_type || '-' || (p_size % 8) AS facet_id, l_returnflag AS rf, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_linestatus AS ev FROM lineitem JOIN part ON l_partkey = p_partkey),
 cov AS (SELECT audit_id, paper_id, facet_id, CASE WHEN bool_or(rf = 'R') THEN 'EXACT' WHEN bool_or(rf = 'A') THEN 'FUNCTIONAL' ELSE 'PARTIAL' END AS status, list_sort(list(DISTINCT ev)) AS evs FROM lines GROUP BY 1, 2, 3),
 papers AS (SELECT p_brand AS audit_id, 'S' || l_suppkey AS paper_id, min(o_orderdate)::date AS d, make_date(1996 + split_part(p_brand, '#', 2)::int % 4, 1, 1) AS cutoff
   FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 4),
 hard AS (SELECT c.*, b FROM cov c JOIN facets USING (audit_id, facet_id) JOIN papers p USING (audit_id, paper_id) WHERE status IN ('EXACT', 'FUNCTIONAL') AND d <= cutoff),
 pm AS (SELECT audit_id, paper_id, bit_or(1::bigint << b::int) AS m FROM hard GROUP BY 1, 2),
 s1 AS (SELECT audit_id, [paper_id] AS ids FROM pm JOIN fullm USING (audit_id) WHERE m = f),
 s2 AS (SELECT a.audit_id, [a.paper_id, b.paper_id] AS ids FROM pm a JOIN pm b ON a.audit_id = b.audit_id AND a.paper_id < b.paper_id JOIN fullm u ON u.audit_id = a.audit_id
   WHERE (a.m | b.m) = f AND a.audit_id NOT IN (SELECT audit_id FROM s1)),
 s3 AS (SELECT a.audit_id, [a.paper_id, b.paper_id, c.paper_id] AS ids FROM pm a JOIN pm b ON a.audit_id = b.audit_id AND a.paper_id < b.paper_id JOIN pm c ON c.audit_id = a.audit_id AND b.paper_id < c.paper_id
   JOIN fullm u ON u.audit_id = a.audit_id WHERE (a.m | b.m | c.m) = f AND a.audit_id NOT IN (SELECT audit_id FROM s1) AND a.audit_id NOT IN (SELECT audit_id FROM s2)),
 sets AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3),
 w AS (SELECT l_orderkey, l_suppkey AS s1_, p_brand AS b1, lead(l_suppkey) OVER o AS s2_, lead(p_brand) OVER o AS b2 FROM lineitem JOIN part ON l_partkey = p_partkey WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
 cnt AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
 br AS (SELECT DISTINCT l_orderkey, least(s1_, s2_) AS a, greatest(s1_, s2_) AS b, unnest([b1, b2]) AS audit_id FROM w WHERE s2_ <> s1_),
 links AS (SELECT DISTINCT br.audit_id, least('S' || a, 'S' || b) AS x, greatest('S' || a, 'S' || b) AS y, CASE WHEN o_orderpriority = '1-URGENT' THEN 'TEXTUAL' ELSE 'GRAPH' END AS sup
   FROM br JOIN orders ON o_orderkey = l_orderkey JOIN cnt c1 ON c1.l_suppkey = a JOIN cnt c2 ON c2.l_suppkey = b JOIN brand USING (audit_id)
   WHERE o_orderdate::date <= make_date(1996 + brand.n % 4, 1, 1) AND (o_orderpriority = '1-URGENT' OR greatest(c1.n, c2.n) < 600)),
 sp AS (SELECT audit_id, ids, len(ids) AS k, unnest(CASE len(ids) WHEN 2 THEN [[ids[1], ids[2]]] WHEN 3 THEN [[ids[1], ids[2]], [ids[1], ids[3]], [ids[2], ids[3]]] ELSE [] END) AS pr FROM sets),
 lk AS (SELECT sp.audit_id, ids, count(DISTINCT CASE WHEN sup = 'TEXTUAL' THEN pr END) AS tx, count(DISTINCT CASE WHEN sup = 'GRAPH' THEN pr END) AS gr FROM sp JOIN links l ON l.audit_id = sp.audit_id AND x = least(pr[1], pr[2]) AND y = greatest(pr[1], pr[2]) GROUP BY 1, 2),
 strength AS (SELECT s.audit_id, s.ids, CASE WHEN len(s.ids) = 1 OR coalesce(tx, 0) >= len(s.ids) - 1 THEN 'TEXTUAL' WHEN coalesce(gr, 0) >= len(s.ids) - 1 THEN 'GRAPH' ELSE 'NONE' END AS strength FROM sets s LEFT JOIN lk ON lk.audit_id = s.audit_id AND lk.ids = s.ids)
"""

ROW_SQL = """, ev AS (SELECT s.audit_id, s.ids, array_to_string(list_sort(list(DISTINCT e)), ',') AS evidence, count(DISTINCT e) AS n_evidence FROM (SELECT audit_id, ids, unnest(ids) AS paper_id FROM sets) s
   JOIN (SELECT audit_id, paper_id, unnest(evs) AS e FROM hard) h ON h.audit_id = s.audit_id AND h.paper_id = s.paper_id GROUP BY 1, 2),
 dt AS (SELECT s.audit_id, s.ids, list_sort(list(d::varchar)) AS dates FROM (SELECT audit_id, ids, unnest(ids) AS paper_id FROM sets) s JOIN papers p ON p.audit_id = s.audit_id AND p.paper_id = s.paper_id GROUP BY 1, 2),
 full_rows AS (SELECT e.audit_id, e.ids, e.evidence, e.n_evidence, dt.dates, st.strength FROM ev e JOIN dt ON dt.audit_id = e.audit_id AND dt.ids = e.ids JOIN strength st ON st.audit_id = e.audit_id AND st.ids = e.ids),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY CASE strength WHEN 'TEXTUAL' THEN 0 WHEN 'GRAPH' THEN 1 ELSE 2 END, -n_evidence, dates, ids) AS rank FROM full_rows)
"""


def _sets(t: Tables) -> DataFrame:
    return setcover.minimal_sets(facets(t), papers(t), coverage(t))


@query("mps_sets", VIEW_SQL + ROW_SQL + "SELECT audit_id, len(ids)::bigint AS size, array_to_string(ids, ',') AS paper_ids, evidence, array_to_string(dates, ',') AS dates FROM full_rows")
def mps_sets(t: Tables) -> DataFrame:
    s = _sets(t)
    return s.select("audit_id", "size", F.array_join(F.array_sort("paper_ids"), ",").alias("paper_ids"), F.array_join("evidence_ids", ",").alias("evidence"), F.array_join("dates", ",").alias("dates"))


@query("mps_ranking", VIEW_SQL + ROW_SQL + "SELECT audit_id, rank::bigint AS rank, array_to_string(ids, ',') AS paper_ids, strength FROM ranked")
def mps_ranking(t: Tables) -> DataFrame:
    ranked = setcover.rank_sets(_sets(t).withColumn("paper_ids", F.array_sort("paper_ids")), bridges(t))
    return ranked.select("audit_id", "rank", F.array_join("paper_ids", ",").alias("paper_ids"), "strength")


@query(
    "mps_best",
    VIEW_SQL + ROW_SQL + "SELECT audit_id, count(*) AS set_count, max(CASE WHEN rank = 1 THEN array_to_string(ids, ',') END) AS paper_ids, max(CASE WHEN rank = 1 THEN strength END) AS strength FROM ranked GROUP BY 1",
)
def mps_best(t: Tables) -> DataFrame:
    best = setcover.best_sets(_sets(t).withColumn("paper_ids", F.array_sort("paper_ids")), bridges(t))
    return best.select("audit_id", "set_count", F.array_join("paper_ids", ",").alias("paper_ids"), "strength")


@query("mps_counts", VIEW_SQL + "SELECT audit_id, len(ids)::bigint AS size, count(*) AS set_count FROM sets GROUP BY 1, 2")
def mps_counts(t: Tables) -> DataFrame:
    return setcover.set_counts(facets(t), papers(t), coverage(t))


LENIENT_SQL = (
    VIEW_SQL.replace("d <= cutoff)", "d <= cutoff + 200)")
    .replace("list_sort(list(DISTINCT ev)) AS evs", "list_sort(list(DISTINCT ev) FILTER (rf <> 'A')) AS evs")
)


def uncertain_papers(t: Tables) -> DataFrame:
    """Suppliers that began within 200 days after the cutoff count as uncertain."""
    late = S("CASE WHEN earliest_public_date <= cutoff THEN 'ELIGIBLE' WHEN earliest_public_date <= date_add(cutoff, 200) THEN 'ELIGIBILITY_UNCERTAIN' ELSE 'POST_CUTOFF' END")
    return papers(t).withColumn("cutoff_status", late)


@query("mps_lenient_counts", LENIENT_SQL + "SELECT audit_id, len(ids)::bigint AS size, count(*) AS set_count FROM sets GROUP BY 1, 2")
def mps_lenient_counts(t: Tables) -> DataFrame:
    """Uncertain works and coverage without evidence count as well; accepted lines are no evidence here."""
    bare = coverage(t).withColumn("evidence_ids", F.when(F.col("status") == "EXACT", F.col("evidence_ids")).otherwise(F.array().cast("array<string>")))
    return setcover.set_counts(facets(t), uncertain_papers(t), bare, strict=False, require_evidence=False)


@query(
    "mps_sensitivity",
    VIEW_SQL
    + """, v AS (SELECT f.audit_id, f.facet_id, u.f & ~(1::bigint << f.b::int) AS f FROM facets f JOIN fullm u USING (audit_id)),
 a1 AS (SELECT DISTINCT v.audit_id, v.facet_id FROM v JOIN pm ON pm.audit_id = v.audit_id WHERE v.f <> 0 AND (pm.m & v.f) = v.f),
 a2 AS (SELECT DISTINCT v.audit_id, v.facet_id FROM v JOIN pm a ON a.audit_id = v.audit_id JOIN pm b ON b.audit_id = v.audit_id WHERE v.f <> 0 AND ((a.m | b.m) & v.f) = v.f),
 dm AS (SELECT DISTINCT audit_id, m FROM pm),
 a3 AS (SELECT DISTINCT v.audit_id, v.facet_id FROM v JOIN dm a ON a.audit_id = v.audit_id JOIN dm b ON b.audit_id = v.audit_id JOIN dm c ON c.audit_id = v.audit_id WHERE v.f <> 0 AND ((a.m | b.m | c.m) & v.f) = v.f),
 alt AS (SELECT audit_id, facet_id, min(k) AS k FROM (SELECT *, 1 AS k FROM a1 UNION ALL SELECT *, 2 FROM a2 UNION ALL SELECT *, 3 FROM a3) GROUP BY 1, 2),
 base AS (SELECT audit_id, min(len(ids)) AS k FROM sets GROUP BY 1)
 SELECT v.audit_id, v.facet_id AS removed_facet, base.k::bigint AS baseline_size, alt.k::bigint AS alternative_size,
   CASE WHEN alt.k = 1 THEN 'DIRECT_PRECEDENT' WHEN alt.k IN (2, 3) THEN 'COMPOSITION_CANDIDATE' ELSE 'NO_COMPLETE_SET' END AS alternative_classification
 FROM v LEFT JOIN base ON base.audit_id = v.audit_id LEFT JOIN alt ON alt.audit_id = v.audit_id AND alt.facet_id = v.facet_id""",
)
def mps_sensitivity(t: Tables) -> DataFrame:
    return setcover.sensitivity(facets(t), papers(t), coverage(t))


@query(
    "verdict_classes",
    VIEW_SQL
    + """, k AS (SELECT audit_id, min(len(ids)) AS size, min(CASE strength WHEN 'TEXTUAL' THEN 0 WHEN 'GRAPH' THEN 1 ELSE 2 END) AS s FROM strength JOIN (SELECT audit_id AS a2, ids AS i2 FROM sets) z ON z.a2 = audit_id AND z.i2 = ids GROUP BY 1)
 SELECT brand.audit_id, size::bigint AS size, CASE WHEN n % 7 = 3 THEN 'INCONCLUSIVE' WHEN size IS NULL THEN 'RESIDUAL_NOVELTY' WHEN size = 1 THEN 'DIRECT_PRECEDENT' WHEN s = 0 THEN 'STRONG_COMPOSITION_RISK' WHEN s = 1 THEN 'PLAUSIBLE_COMPOSITION_RISK' ELSE 'FRAGMENTED_PRECEDENT' END AS classification,
   3 AS search_bound, size IS NULL AS no_result FROM brand LEFT JOIN k ON k.audit_id = brand.audit_id""",
)
def verdict_classes(t: Tables) -> DataFrame:
    audits = t.part.select(F.col("p_brand").alias("audit_id"), S("cast(substring_index(p_brand, '#', -1) AS int) % 7 = 3").alias("unresolved")).distinct()
    out = verdict.classify(audits, facets(t), papers(t), coverage(t), bridges(t))
    return out.select("audit_id", "size", "classification", "search_bound", F.col("no_result_explanation").isNotNull().alias("no_result"))


@query("brg_strength", VIEW_SQL + "SELECT audit_id, array_to_string(ids, ',') AS paper_ids, strength FROM strength")
def brg_strength(t: Tables) -> DataFrame:
    s = _sets(t)
    out = set_strength(s.withColumn("paper_ids", F.array_sort("paper_ids")), bridges(t))
    return out.select("audit_id", F.array_join("paper_ids", ",").alias("paper_ids"), "strength")


@query(
    "mps_verified_coverage",
    """WITH ty AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY md5(audit_id || facet_id)) AS rn FROM (SELECT DISTINCT p_brand AS audit_id, p_type || '-' || (p_size % 8) AS facet_id FROM part)),
 lines AS (SELECT p_brand AS audit_id, 'S' || l_suppkey AS paper_id, p_type || '-' || (p_size % 8) AS facet_id, l_returnflag AS rf, l_orderkey, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey),
 strong AS (SELECT audit_id, paper_id, facet_id, CASE WHEN bool_or(rf = 'R') THEN 'EXACT' WHEN bool_or(rf = 'A') THEN 'FUNCTIONAL' ELSE 'PARTIAL' END AS status,
   bool_and(l_orderkey % 10 <> 3 AND (l_linestatus = 'F' OR rn % 6 = 0) AND l_orderkey % 7 <> 0) AS sound FROM lines JOIN ty USING (audit_id, facet_id) GROUP BY 1, 2, 3)
 SELECT audit_id, paper_id, facet_id, CASE WHEN status = 'PARTIAL' OR sound THEN status ELSE 'UNKNOWN' END AS status, (status = 'PARTIAL' OR sound) AS kept FROM strong""",
)
def mps_verified_coverage(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    ev = joined.select(
        F.col("p_brand").alias("audit_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus").alias("id"), F.concat(F.lit("S"), "l_suppkey").alias("own"), "l_orderkey", "l_linestatus", S(FACET).alias("facet")
    )
    ev = ev.groupBy("audit_id", "id", "facet").agg(F.min("own").alias("own"), F.min("l_orderkey").alias("l_orderkey"), F.min("l_linestatus").alias("l_linestatus"), F.count("*").alias("copies"))
    evidence = ev.select(
        "audit_id", "id", F.col("own").alias("canonical_paper_id"), S("CASE WHEN l_orderkey % 10 = 3 THEN 'TIER_1_METADATA' ELSE 'TIER_2_FULLTEXT' END").alias("source_level"),
        S("CASE WHEN l_linestatus = 'F' THEN 'METHOD' ELSE 'RESULT' END").alias("evidence_kind"), S("CASE WHEN l_orderkey % 7 = 0 THEN array('x') ELSE array(facet) END").alias("supports"),
    )
    out = setcover.verified_coverage(coverage(t), evidence, facets(t))
    return out.select("audit_id", "paper_id", "facet_id", "status", (F.size("evidence_ids") > 0).alias("kept"))


@query(
    "grx_obligations",
    VIEW_SQL
    + """SELECT DISTINCT sp.audit_id, least(pr[1], pr[2]) AS a, greatest(pr[1], pr[2]) AS b, 'GRAPH_EXPANSION_INCOMPLETE:' || least(pr[1], pr[2]) || ':' || greatest(pr[1], pr[2]) AS gap
 FROM sp WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.audit_id = sp.audit_id AND x = least(pr[1], pr[2]) AND y = greatest(pr[1], pr[2]))""",
)
def grx_obligations(t: Tables) -> DataFrame:
    done = bridges(t).filter("type <> 'LANDSCAPE_BRIDGE' AND (type = 'SYNTHESIS_BRIDGE' OR base_rate_status = 'PASSED')").select("audit_id", "paper_ids", F.lit("COMPLETE").alias("status"))
    return expansion.expansion_obligations(_sets(t), done)
