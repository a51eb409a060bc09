"""Plans of registered queries over a few rows: what is joined how, and how often it is worked out."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from priorlens.functions.dates import parse_date
from priorlens.operators import expansion
from priorlens.operators.checks import Context, document
from priorlens.plans import all_queries, audit_queries as A, graph_queries as G  # noqa: F401  (registers the queries)
from priorlens.plans.registry import Tables, spark_queries

DAY = datetime.datetime(1996, 1, 2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve customers with four orders of three lines each."""
    out = str(tmp_path_factory.mktemp("tables"))
    orders = [(k, k % 12, "F", DAY + datetime.timedelta(days=40 * k)) for k in range(48)]
    lines = [(o, p, p % 3, n, "N", "O", d + datetime.timedelta(days=20 * n - 15)) for o, _, _, d in orders for n in range(3) for p in [(o + 5 * n) % 20]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").coalesce(1).write.parquet(f"{out}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp").coalesce(1).write.parquet(f"{out}/lineitem.parquet")
    spark.createDataFrame([(k, f"Customer#{k}") for k in range(12)], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{out}/customer.parquet")
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dat_cutoff", "met_leakage", "val_dates"])
def test_one_cutoff_joins_without_a_product(spark, folder, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # as if the works were many: they cannot be sent
    try:
        text = plan(spark_queries()[name](spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in text and "ExistingRDD" not in text


def test_rows_keep_values_types_and_nulls(spark, folder):
    rows = Tables(spark, folder).rows([(1, "a'b\\", None), (2, None, 3)], "n int, s string, k long")
    assert rows.collect() == [(1, "a'b\\", None), (2, None, 3)] and [t for _, t in rows.dtypes] == ["int", "string", "bigint"]


def test_each_date_of_a_paper_is_parsed_once(spark, folder):
    text = G._cut(Tables(spark, folder)).select("earliest_public_date", "cutoff_status")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RLIKE") <= 10  # each place names the pattern twice: entries, the bare year's two bounds, the cutoff and its filter


def test_dates_at_the_edges(spark):
    day = datetime.date
    cases = {
        " 1996-2-3\n": (day(1996, 2, 3), "day", day(1996, 2, 3), day(1996, 2, 3)), "1996-02-30": (None, "invalid", None, None), "1996-2": (None, "month", day(1996, 2, 1), day(1996, 2, 29)),
        "1996-13": (None, "invalid", None, None), "1996": (None, "year", day(1996, 1, 1), day(1996, 12, 31)), "0000-01-01": (None, "invalid", None, None),
        "19960": (None, "invalid", None, None), "1996-1-1T00": (None, "invalid", None, None), "-1996": (None, "invalid", None, None), "1996-": (None, "invalid", None, None), "": (None, "missing", None, None), "  ": (None, "invalid", None, None), None: (None, "missing", None, None),
    }
    found = spark.createDataFrame([(c,) for c in cases], "c string").select("c", parse_date("c").alias("p")).select("c", "p.parsed", "p.precision", "p.lower_bound", "p.upper_bound").collect()
    assert {r[0]: tuple(r[1:]) for r in found} == cases
    assert spark.range(1).select(parse_date(F.lit("0000"))["lower_bound"].cast("string")).first()[0] == "0000-01-01"
    inside = spark.range(1).select(F.transform(F.array(*[F.lit(c).cast("string") for c in cases]), lambda c: parse_date(c)).alias("p")).first()[0]
    assert [tuple(p) for p in inside] == list(cases.values())


def test_documents_are_dealt_over_all_parts(spark, folder):
    docs = A.audit_documents(Tables(spark, folder))
    text = plan(docs)
    assert "ExistingRDD" not in text and "REPARTITION_BY_NUM" in text
    assert docs.count() == 12


def test_shape_reads_all_sections_of_a_document_in_one_pass(spark):
    rules = Context({"reports": spark.createDataFrame([("a", '{"search": {"providers": [{"name": 1}, 2]}, "papers": [null], "evidence": "x", "claim_map": 3}')], "audit_id string, doc string")})
    items = document._missing_item_keys(rules.reports, document.REQUIRED_ITEM_KEYS)
    text = items._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in text and text.count("LogicalRDD") == 1
    found = {(r.entity_id, r.detail) for r in items.collect()}
    assert {e for e, _ in found} == {"search.providers.0", "search.providers.1", "papers.0"}
    assert ("search.providers.0", "absent field: name") not in found and ("search.providers.0", "absent field: status") in found and ("search.providers.1", "absent field: name") in found


def test_calls_of_a_pair_need_no_join_but_that_with_its_ends(spark):
    """Calls and failures by hand: an unknown end, an end without a count, a provider of one end only, a work with itself."""
    papers = spark.createDataFrame(
        [("q", "A", ["openalex"], {"semantic-scholar": "sa"}, 3), ("q", "B", [], {"openalex": "wb"}, 5), ("q", "C", [], {"semantic-scholar": "sc"}, None)],
        "audit_id string, id string, providers array<string>, provider_ids map<string,string>, citation_count long",
    )
    both = ["openalex", "semantic-scholar"]
    pairs = spark.createDataFrame([("q", "A", "B", both), ("q", "A", "C", both), ("q", "B", "Z", both), ("q", "A", "A", ["openalex"])], "audit_id string, paper_a string, paper_b string, selected array<string>")
    ends = expansion.pair_ends(pairs, papers)
    stored = spark.createDataFrame(ends.collect(), ends.schema)
    assert "Join" not in plan(expansion.routes(stored))
    calls = {(r.paper_a + r.paper_b, r.endpoint, r.provider[0], r.direction[0], r.provider_id, r.other_provider_id) for r in expansion.routes(stored).collect()}
    assert calls == {
        ("AB", "A", "o", "B", "A", None), ("AB", "A", "s", "B", "sa", None), ("AB", "B", "o", "B", "wb", None), ("AB", "A", "o", "F", "A", "wb"),
        ("AC", "A", "o", "B", "A", None), ("AC", "A", "s", "B", "sa", None), ("AC", "C", "s", "B", "sc", None), ("AC", "A", "s", "F", "sa", "sc"), ("AC", "C", "s", "F", "sc", "sa"),
        ("BZ", "B", "o", "B", "wb", None), ("AA", "A", "o", "B", "A", None),
    }
    outage = spark.createDataFrame([("semantic-scholar", "FORWARD", "sc", "HTTP 503")], "provider string, direction string, provider_id string, detail string")
    failed = {(r.paper_a + r.paper_b, r.provider, r.direction[0], r.anchor_paper_id) for r in expansion.call_failures(stored, outage).collect()}
    assert failed == {("AC", "semantic-scholar", "F", "C"), ("BZ", "none", "B", "Z"), ("AA", "none", "F", "A")}


def test_what_calls_show_comes_with_the_ends(spark):
    """Degrees, failures and cuts meet the papers, so that calls, failures and observations of the pairs join none of them."""
    papers = spark.createDataFrame([("q", "A", {"openalex": "wa", "semantic-scholar": "sa"}, 3), ("q", "B", {"openalex": "wb"}, 5), ("q", "C", {}, 1)], "audit_id string, id string, provider_ids map<string,string>, citation_count long")
    papers = papers.withColumn("providers", F.array().cast("array<string>"))
    edges = spark.createDataFrame([("openalex", "wa", "x"), ("openalex", "wa", "y"), ("openalex", "z", "wa"), ("semantic-scholar", "u", "sa")], "provider string, source_id string, target_id string")
    down = spark.createDataFrame([("semantic-scholar", "BACKWARD", "sa", None), ("semantic-scholar", "BACKWARD", "sa", "HTTP 503"), ("openalex", "FORWARD", None, "x")], "provider string, direction string, provider_id string, detail string")
    cuts = spark.createDataFrame([("openalex", "FORWARD", "wa", 1, "next"), ("openalex", "FORWARD", "wa", 1, "more"), ("openalex", "BACKWARD", "other", 1, "t")], "provider string, direction string, provider_id string, limit int, next_token string")
    pairs = spark.createDataFrame([("q", "A", "B", ["openalex", "semantic-scholar"]), ("q", "A", "C", ["openalex"])], "audit_id string, paper_a string, paper_b string, selected array<string>")
    ends = expansion.pair_ends(pairs, papers, expansion.route_facts(papers, edges, down, cuts))
    stored = spark.createDataFrame(ends.collect(), ends.schema)
    calls, failed = expansion.call_log(expansion.routes(stored)), expansion.call_failures(stored)
    assert "Join" not in plan(calls) and "Exchange" not in plan(calls) and "Join" not in plan(failed)
    assert sorted((r.paper_b, r.direction, r.provider_id, r.returned_count, r.exhausted, r.next_token or "") for r in calls.collect()) == [
        ("B", "BACKWARD", "wa", 2, True, ""), ("B", "BACKWARD", "wb", 0, True, ""), ("B", "FORWARD", "wa", 1, False, "more"), ("B", "FORWARD", "wa", 1, False, "next"), ("C", "BACKWARD", "wa", 2, True, ""),
    ]
    assert sorted((r.paper_b, r.provider, r.direction, r.anchor_paper_id, r.detail or "") for r in failed.collect()) == [
        ("B", "semantic-scholar", "BACKWARD", "A", ""), ("B", "semantic-scholar", "BACKWARD", "A", "HTTP 503"), ("C", "none", "BACKWARD", "C", "no chosen provider knows the endpoint"), ("C", "none", "FORWARD", "C", "no chosen provider knows both endpoints"),
    ]
    seen = {(r.paper_b, r.paper_id): (r.status, r.provider_returned_count, [o.status for o in r.provider_observations]) for r in expansion.reference_observations(pairs, stored).collect()}
    assert seen == {
        ("B", "A"): ("NONEMPTY", 2, ["NONEMPTY", "FAILED", "FAILED"]), ("B", "B"): ("EMPTY_AT_PROVIDER", 0, ["EMPTY_AT_PROVIDER"]),
        ("C", "A"): ("NONEMPTY", 2, ["NONEMPTY"]), ("C", "C"): ("FAILED", None, ["FAILED"]),
    }


def test_abstract_index_is_built_in_the_row(spark, tmp_path):
    """A text without words keeps its row, as in the SQL; no word is shuffled."""
    texts = [(1, "b a  b\tc a b"), (2, " "), (3, None), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = spark_queries()["src_abstract"](spark, str(tmp_path))
    assert "Exchange" not in plan(out)
    got = {r["doc_id"]: r["abstract_md5"] for r in out.collect()}
    assert got == {k: hashlib.md5(" ".join(t.split()).encode()).hexdigest() if t is not None else None for k, t in texts}
