"""Small fixtures for dates, versions, bridges, expansion, search, study, sources and sinks."""

import json

from pyspark.sql import functions as F

from priorlens.operators import bridges, dates, diff, expansion, metrics, search, study, versions
from priorlens.operators.coverage import derive_coverage
from priorlens.schemas import ARXIV_VERSIONS, AUTHORS, DATES
from priorlens.sources import records, sinks


def test_dates(spark):
    cases = [
        ("v1", [("2024-12-15", "arxiv_v1", None, None), ("2025-08-01", "publisher_online", None, True)], None, "2024-12-15", "ELIGIBLE"),
        ("year", [], "2020", None, "DATE_UNCERTAIN"),
        ("late", [("2025-10-01", "publication", None, None)], None, "2025-10-01", "POST_CUTOFF"),
        ("month", [("2025-01", "publication", None, None), ("2025-03-15", "publication", None, None)], None, None, "DATE_UNCERTAIN"),
        ("unverified", [("2019-01-01", "publication", None, False), ("2021-1-5", "publication", None, None)], "1999", "2021-01-05", "ELIGIBLE"),
        ("none", [], None, None, "DATE_UNCERTAIN"),
    ]
    df = spark.createDataFrame([("a", c[0], c[1], c[2]) for c in cases], f"audit_id string, id string, dates {DATES}, year string")
    audits = spark.createDataFrame([("a", "2025-09-18"), ("b", "2025")], "audit_id string, cutoff string")
    out, bad = dates.apply_cutoff(df, audits)
    got = {r["id"]: r for r in out.collect()}
    for name, _, _, day, status in cases:
        assert (str(got[name]["earliest_public_date"]) if day else got[name]["earliest_public_date"], got[name]["cutoff_status"]) == (day, status), name
    assert got["month"]["date_provenance"]["precision"] == "month"
    assert [r["value"] for r in bad.collect()] == ["2025"]
    lenient, _ = dates.apply_cutoff(df, audits, strict=False)
    assert {r["cutoff_status"] for r in lenient.collect()} == {"ELIGIBLE", "POST_CUTOFF", "ELIGIBILITY_UNCERTAIN"}


def _version(v, day, base="1706.03762"):
    return (v, f"{base}v{v}", day, f"https://arxiv.org/pdf/{base}v{v}", True)


def test_versions(spark):
    full = [_version(1, "2017-06-12"), _version(2, "2019-01-15"), _version(3, "2020-01-01")]
    schema = f"audit_id string, paper_id string, base_id string, ordinal bigint, arxiv_version int, arxiv_latest_version_verified boolean, arxiv_versions {ARXIV_VERSIONS}, dates {DATES}, fulltext_urls array<string>"
    papers = spark.createDataFrame([("a", p, "1706.03762", c, "ELIGIBLE") for p, c in (("mid", "2019-06-01"), ("gap", "2019-06-01"), ("local", "2021-01-01"), ("early", "2010-01-01"))], "audit_id string, id string, arxiv_id string, cutoff string, cutoff_status string")
    papers = papers.withColumn("arxiv_id", F.when(F.col("id") == "gap", "1706.00000").otherwise(F.col("arxiv_id")))
    local = spark.createDataFrame([("a", "local", "1706.03762", 0, 3, True, [_version(3, "2019-01-01")], [], [])], schema)
    history = spark.createDataFrame(
        [("-", "-", "1706.03762", 0, None, False, full, [], []), ("-", "-", "1706.00000", 0, None, False, [_version(1, "2017-06-12", "1706.00000"), _version(3, "2020-01-01", "1706.00000")], [], [])], schema
    )
    got = {r["paper_id"]: r for r in versions.historical_source(papers, local, history).collect()}
    assert got["mid"]["version"] == 2 and got["mid"]["selection_method"] == versions.HISTORY_METHOD
    assert "gaps at versions: 2" in got["gap"]["error"]
    assert got["local"]["version"] == 3 and got["local"]["selection_method"] == versions.LOCAL_METHOD and got["local"]["history_complete"] is False
    assert got["early"]["error"].startswith("no version was public")
    row = spark.range(1).select(versions.same_version(F.lit("https://arxiv.org/pdf/1.2v3"), F.lit("https://arxiv.org/pdf/1.2v4")).alias("x")).first()
    assert row["x"] is False


def test_bridges(spark):
    rows = [("a", "A", None, "10.1/a", {"openalex": "W1"}, 10000, "ELIGIBLE"), ("a", "B", None, None, {}, 4, "ELIGIBLE"), ("a", "C", None, None, {}, None, "ELIGIBLE"), ("a", "D", None, None, {}, None, "POST_CUTOFF")]
    papers = spark.createDataFrame(rows, "audit_id string, id string, arxiv_id string, doi string, provider_ids map<string,string>, citation_count bigint, cutoff_status string")
    papers = papers.withColumns({"canonical_key": F.concat(F.lit("k:"), "id"), "earliest_public_date": F.lit(None).cast("date"), "cutoff": F.lit("2025-01-01").cast("date")})
    edges = spark.createDataFrame([("a", "B", "https://openalex.org/W1"), ("a", "C", "https://doi.org/10.1/A"), ("a", "C", "B"), ("a", "D", "A"), ("a", "D", "B")], "audit_id string, source_id string, target_raw string")
    pairs = spark.createDataFrame([("a", "A", "B"), ("a", "A", "Z")], "audit_id string, paper_a string, paper_b string")
    got = {(r["type"], r["underlying_type"], r["source_paper_id"], r["base_rate_status"]) for r in bridges.find_bridges(pairs, papers, edges, 100).collect()}
    assert got == {("DIRECT_CITATION", None, "B", "NOT_APPLICABLE"), ("CO_CITATION", None, "C", "HIGH_BASE_RATE"), ("LANDSCAPE_BRIDGE", "CO_CITATION", "D", "HIGH_BASE_RATE")}
    assert bridges.unknown_pairs(pairs, papers).count() == 1


def _expand(spark, cut=(), silent=()):
    papers = spark.createDataFrame([("a", "A", {"openalex": "WA", "semantic-scholar": "SA"}, [], 5, "2022-03-01"), ("a", "B", {"openalex": "WB"}, ["semantic-scholar"], 9, "2023-04-02")], "audit_id string, id string, provider_ids map<string,string>, providers array<string>, citation_count bigint, d string")
    papers = papers.withColumn("earliest_public_date", F.col("d").cast("date"))
    edges = spark.createDataFrame([("openalex", "WC", "WA"), ("openalex", "WC", "https://openalex.org/WB"), ("openalex", "WX", "WA"), ("openalex", "WB", "WA"), ("openalex", "WA", "W0")], "provider string, source_id string, target_id string")
    pairs = spark.createDataFrame([("a", "A", "B", "2024-04-03", ["openalex", "semantic-scholar"])], "audit_id string, paper_a string, paper_b string, c string, selected array<string>").withColumn("cutoff", F.col("c").cast("date"))
    none = spark.createDataFrame([], "provider string, direction string, provider_id string, detail string")
    cuts = spark.createDataFrame(list(cut), "provider string, direction string, provider_id string, limit int, next_token string")
    return {k: v.collect() for k, v in expansion.expand_pairs(pairs, papers, edges, none, cuts=cuts, silent_providers=silent).items()}


def test_expansion(spark):
    out = _expand(spark)
    e = out["expansions"][0]
    assert [r["neighbour_id"] for r in out["candidates"]] == ["WC"] and {r["anchor_paper_id"] for r in out["calls"] if r["direction"] == "FORWARD"} == {"A"}
    assert e["status"] == "COMPLETE" and e["observation_window_days"] == 367 and e["anchor_selection"] == "LOWER_CITATION_COUNT" and e["provider"] == "multi-provider"
    short = _expand(spark, [("openalex", "FORWARD", "WA", 2, "next")])["expansions"][0]
    assert [r["neighbour_id"] for r in _expand(spark, [("openalex", "FORWARD", "WA", 2, "next")])["candidates"]] == ["WC"]
    assert short["status"] == "PARTIAL" and short["partial_reasons"] == ["LIMIT_REACHED"] and short["negative_result_scope"] == "INCOMPLETE_EXPANSION"
    assert _expand(spark, (), ("semantic-scholar",))["expansions"][0]["partial_reasons"] == ["LIMIT_REACHED"]


def test_search_coverage(spark):
    families = ["literal", "mechanism", "problem_function", "ancestor", "composition_bridge"]
    base = [("a", f"q{i}", "openalex", f, "ok", 1, False, "{}", "all", "PROVIDER_EXHAUSTED") for i, f in enumerate(families)] + [("a", "s", "semantic_scholar", "literal", "ok", 0, False, "{}", "not_applicable", "NO_NEW_RESULTS")]
    schema = "audit_id string, query_id string, provider string, family string, status string, returned_count bigint, truncated boolean, pagination string, corpus string, saturation_stop_reason string"
    audits = spark.createDataFrame([("a", True)], "audit_id string, saturated boolean")
    none = spark.createDataFrame([], "audit_id string, id string, status string")

    def level(rows, obligations=none):
        return derive_coverage(audits, spark.createDataFrame(rows, schema), obligations).first()

    assert level(base)["level"] == "BROAD" and level(base)["reasons"] == []
    assert level([r if r[1] != "s" else (*r[:2], "fake", *r[3:]) for r in base])["level"] == "NARROW"
    assert level([r if r[1] != "q0" else (*r[:8], "core", r[9]) for r in base])["level"] == "MODERATE"
    assert "incomplete search obligations: ['o']" in level(base, spark.createDataFrame([("a", "o", "INCOMPLETE")], "audit_id string, id string, status string"))["reasons"]


def test_page_folding(spark):
    pages = [("a", "filtered", i, str(100 * i) if i < 3 else None, 100, 0 if i < 3 else 2, None, [] if i < 3 else ["x", "y"]) for i in (1, 2, 3)]
    pages += [("a", "stale", i, str(i), 2, 2, None, ["x", "y"]) for i in (1, 2, 3)] + [("a", "long", i, str(i), 1, 1, None, [f"p{i}"]) for i in range(1, 5)]
    df = spark.createDataFrame(pages, "audit_id string, query_id string, page_index int, next_token string, raw_returned_count bigint, returned_count bigint, total_count bigint, paper_ids array<string>")
    got = {r["query_id"]: (r["returned_count"], r["saturation_stop_reason"], r["truncated"]) for r in search.fold_pages(df).collect()}
    assert got == {"filtered": (2, "PROVIDER_EXHAUSTED", False), "stale": (2, "NO_NEW_RESULTS", False), "long": (4, "PAGE_BUDGET_EXHAUSTED", True)}


def test_named_priors(spark):
    cases = [
        ("c1", "Target Paper Title", "Smithson et al. and MEMX already do this.", "Reviews.\n[1] Something."),
        ("c2", "Target Paper Title", "covered by [1-2]", "[1] A. Compressed memory for agents. 2020.\n[2] \"A quoted earlier study of things\". 2021.\n[3] Selection of evidence in context. 2022."),
        ("c3", "Target Paper Title", "see [A linked paper](https://arxiv.org/abs/2401.00001)", ""),
        ("c4", "Target Paper Title", "This lacks novelty.", ""),
        ("c5", "Target Paper Title", "Nice.", ""),
    ]
    cands = [("c1", 0, "MEMX: a memory module", "s1", ["Jones"]), ("c1", 1, "Another thing entirely here", "s2", ["Smithson"]), ("c1", 2, "Unrelated topic of study", "s3", ["Brown"]), ("c1", 3, "Target paper title", "s0", ["Smithson2"]),
             ("c2", 0, "Compressed memory for agents", "s4", ["Lee"]), ("c2", 1, "Selection of evidence in context", "s5", ["Kim"])]
    cdf = spark.createDataFrame(cases, "case_id string, target_title string, novelty string, review string")
    df = spark.createDataFrame([(*c, None, None, None, None) for c in cands], "case_id string, ordinal bigint, title string, s2_id string, authors array<string>, publication_date string, doi string, arxiv string, s2_reference_count bigint")
    priors = study.named_priors(study.named_mentions(cdf, df))
    got = {(r["case_id"], r["title"], tuple(r["link_methods"])) for r in priors.collect()}
    assert got == {
        ("c1", "MEMX: a memory module", ("DISTINCTIVE_TITLE_ALIAS",)), ("c1", "Another thing entirely here", ("REVIEWER_AUTHOR_LINK",)), ("c2", "Compressed memory for agents", ("NUMBERED_REFERENCE",)),
        ("c2", "A quoted earlier study of things", ("NUMBERED_REFERENCE_TITLE_2",)), ("c3", "A linked paper", ("IDENTIFIER_ARXIV", "MARKDOWN_IDENTIFIER")),
    }
    status = {r["case_id"]: r["extraction_status"] for r in study.extraction_status(cdf, priors).collect()}
    assert status == {"c1": "EXTRACTED", "c2": "EXTRACTED", "c3": "EXTRACTED", "c4": "POTENTIAL_MISSED_MENTIONS", "c5": "NO_EXPLICIT_WORK_DETECTED"}


def test_interval_and_interpretation(spark):
    row = spark.createDataFrame([(4, 18), (0, 0), (0, 5), (5, 5)], "k bigint, n bigint").select(study.exact_interval("k", "n").alias("i")).collect()
    assert [(r["i"]["lower"], r["i"]["upper"]) for r in row] == [(0.0641, 0.4764), (None, None), (0.0, 0.5218), (0.4782, 1.0)]
    want = [("PARTIAL", 0, 0, 9, False, "UNINTERPRETABLE_INCOMPLETE_QUERY"), ("COMPLETE", 2, 1, None, True, "BRIDGE_PRESENT"), ("COMPLETE", 0, 1, 9, True, "UNINTERPRETABLE_BRIDGE_DATE_MISSING"), ("COMPLETE", 0, 0, None, True, "UNINTERPRETABLE_ENDPOINT_DATE_MISSING"),
            ("COMPLETE", 0, 0, -1, True, "UNINTERPRETABLE_POST_CUTOFF_ENDPOINT"), ("COMPLETE", 0, 0, 100, True, "ZERO_WITH_SHORT_WINDOW_AND_COVERAGE_CAVEAT"), ("COMPLETE", 0, 0, 600, True, "ZERO_WITH_PROVIDER_COVERAGE_CAVEAT"),
            ("COMPLETE", 0, 0, 100, False, "ZERO_WITH_SHORT_OBSERVATION_WINDOW"), ("COMPLETE", 0, 0, 600, False, "ZERO_UNDER_MEASURED_PROVIDER_SNAPSHOT")]
    df = spark.createDataFrame(want, "s string, b bigint, u bigint, d int, g boolean, w string")
    assert df.filter(study.zero_interpretation(F.col("s"), F.col("b"), F.col("u"), F.col("d"), F.col("g")) != F.col("w")).count() == 0


def test_metrics(spark):
    cases = spark.createDataFrame([(["g1", "g2", "g3"], ["g1"], ["x", "g1", "y"]), ([], ["g9"], ["x"])], "bibliography_absent_gold array<string>, gold array<string>, ranked_papers array<string>")
    assert abs(metrics.recall_at_k(cases, 2).first()["recall"] - 1 / 3) < 1e-12 and metrics.mean_reciprocal_rank(cases).first()["mrr"] == 0.25
    assert metrics.recall_at_k(cases.limit(0)).first()["recall"] == 0.0


def test_diff_causes(spark):
    schema = "audit_id string, classification string, novelty_risk string, search_coverage string, evidence_confidence string"
    a, b = (spark.createDataFrame([("a", c, "HIGH", "BROAD", "MIXED")], schema) for c in ("X", "Y"))
    v = diff.diff_verdicts(a, b)
    audits = a.select("audit_id")
    assert diff.change_causes(audits, audits.limit(0), v).first()["change_cause"] == "MODEL_OR_REASONING_CHANGE"
    assert diff.change_causes(audits, audits, v).first()["change_cause"] == "LITERATURE_SNAPSHOT_CHANGE"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([{"id": "1", "title": "x"}, {"id": "2"}]))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"results": [{"id": "3", "provider_ids": {"openalex": "W"}}]}))
    df = records.read_records(spark, str(tmp_path / "in"))
    assert sorted((r["id"], r["ordinal"]) for r in df.collect()) == [("1", 0), ("2", 1), ("3", 0)]
    atom = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.00001v2</id><updated>2024-02-01T00:00:00Z</updated><published>2024-01-01T00:00:00Z</published>
    <title>A  title</title><summary>S</summary><author><name>A B</name></author><arxiv:doi>10.1/X</arxiv:doi><link href="http://arxiv.org/abs/2401.00001v2" rel="alternate" type="text/html"/><link title="pdf" href="http://arxiv.org/pdf/2401.00001v2" rel="related" type="application/pdf"/></entry></feed>"""
    (tmp_path / "feed.xml").write_text(atom)
    p = records.from_arxiv(records.read_arxiv_atom(spark, str(tmp_path / "feed.xml"))).first()
    assert (p["id"], p["doi"], p["arxiv_version"], p["fulltext_urls"]) == ("2401.00001v2", "10.1/x", 2, ["https://arxiv.org/pdf/2401.00001v2"])
    assert [(d["value"], d["source"]) for d in p["dates"]] == [("2024-01-01", "arxiv_v1"), ("2024-02-01", "arxiv_v2")]
    case = tmp_path / "cases" / "k1"
    (case / "ours").mkdir(parents=True)
    (case / "annotation.json").write_text(json.dumps({"input": {"title": "T"}, "publicationDate": "2025-01-01", "output": [{"novelty_statements": ["n1", "n2"], "review": "r"}]}))
    (case / "ours" / "structured_representation.json").write_text(json.dumps({"a": [{"title": "Deep one two", "paperId": "p", "related": {"title": "deep ONE two", "year": 2020, "authors": ["Ann Lee"]}}], "title": "x"}))
    notes, docs = records.read_cases(spark, str(tmp_path / "cases"))
    assert study.novelty_payload(records.case_outputs(notes)).first()["novelty"] == "n1\nn2"
    c = records.candidate_records(docs).collect()
    assert [(r["case_id"], r["title"], r["s2_id"], r["year"], r["authors"]) for r in c] == [("k1", "Deep one two", "p", "2020", ["Lee"])]
    head = spark.createDataFrame([("a", 1)], "audit_id string, n int")
    doc = sinks.audit_documents(head, {"rows": spark.createDataFrame([("a", "y"), ("a", "x")], "audit_id string, v string"), "none": spark.createDataFrame([], "audit_id string, v string")})
    assert json.loads(doc.first()["document"]) == {"audit_id": "a", "n": 1, "rows": [{"v": "x"}, {"v": "y"}], "none": []}
    sinks.write_records(head, str(tmp_path / "out"), buckets=4)
    sinks.write_documents(doc, str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 and spark.read.text(str(tmp_path / "docs")).count() == 1


def test_co_citation_pairs_are_listed_by_their_sources(spark, monkeypatch):
    import random

    rng = random.Random(7)
    edges = {("q", f"s{s}", f"t{rng.randrange(12)}") for s in range(30) for _ in range(rng.choice([1, 3, 9]))} | {("r", "s1", "t1"), ("r", "s1", "t2"), ("q", "t1", "t2"), ("q", "t1", "t1")}
    pairs = {("q", f"t{a}", f"t{b}") for a in range(6) for b in range(12) if (a + b) % 2} | {("q", "t3", "t3"), ("r", "t2", "t1"), ("r", "t1", "t9"), ("q", "t1", "t2"), ("q", "t2", "t1")}
    want = {(q, a, b, s) for q, a, b in pairs for p, s, t in edges if p == q and t == a and (q, s, b) in edges and s not in (a, b)}
    p = spark.createDataFrame(sorted(pairs), "audit_id string, paper_a string, paper_b string")
    e = spark.createDataFrame(sorted(edges), "audit_id string, source_id string, target_id string")
    for most in (0, 3, 64):  # all, some and no sources go through the lesser endpoint
        monkeypatch.setattr(bridges, "PAIRED", most)
        got = [tuple(r)[:4] for r in bridges.co_citation_routes(p, e).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # an endpoint cited by every source, named by every pair: a source of two endpoints still lists one pair
    cited = spark.createDataFrame([("q", f"s{s}", n, False) for s in range(50) for n in (0, s + 1)], "audit_id string, source_id string, node bigint, alone boolean")
    assert bridges.source_pairs(cited).count() == 50


def test_keys_of_six_digits_have_their_own_arxiv_ids(spark, tmp_path):
    from pyspark.sql import functions as F

    from priorlens.plans import all_queries  # noqa: F401
    from priorlens.plans.registry import spark_queries

    keys = [10_000, 100_000, 100_001, 1_200_000, 10_000_001]
    frame = spark.createDataFrame([(k,) for k in keys], "k bigint")
    day = lambda c: F.to_timestamp(F.lit(c))
    frame.select(F.col("k").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), day("1998-01-02").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = frame.select(F.col("k").alias("l_orderkey"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in keys])).alias("l_partkey"), F.lit(1).cast("bigint").alias("l_suppkey"))
    lines = lines.filter("l_partkey <= 100001").withColumn("l_linenumber", (F.col("l_partkey") % 7).cast("int")).withColumn("l_shipdate", F.to_timestamp(F.date_add(F.lit("1997-01-01"), F.col("l_linenumber"))))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    frame.select(F.col("k").alias("p_partkey"), F.lit(7).alias("p_size"), F.lit("thing").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: spark_queries()[name](spark, str(tmp_path)).collect()
    assert not [r for r in run("dat_historical_source") if r["error"] and "two records" in r["error"]]
    found = run("stu_resolution")
    assert len(found) == 15 and all(r["work_id"] == f"W{r['group_ordinal']}" and r["resolution_method"] == "ARXIV_DOI" for r in found)


def test_pairs_count_their_citing_works_by_day(spark):
    """Every pair against its definition; a pair named by many cases and cited by many works meets them as one row."""
    import random
    from datetime import date, timedelta

    from priorlens.operators import study

    rng, start = random.Random(11), date(2020, 1, 1)
    works = {f"s{s}": None if s % 7 == 0 else start + timedelta(days=rng.randrange(9)) for s in range(300)}
    edges = {(s, f"t{n}") for s in works for n in (0, 1, rng.randrange(2, 90))} | {("s1", f"t{n}") for n in range(90)} | {("t0", "t1"), ("t0", "t0")}
    cases = {f"c{k}": (start + timedelta(days=k % 9), ["t0", "t1", f"t{rng.randrange(2, 90)}"][:: (-1) ** k] + (["t0"] if k == 5 else [])) for k in range(200)}
    priors = [(c, i, w, start, 3, "NONEMPTY" if w != "t1" else "UNRESOLVED") for c, (_, named) in cases.items() for i, w in enumerate(named)]
    p = spark.createDataFrame(priors, "case_id string, pos int, work_id string, earliest_public_date date, cited_by_count bigint, reference_coverage_status string")
    pairs = study.prior_pairs(p, spark.createDataFrame([(c, cut) for c, (cut, _) in cases.items()], "case_id string, cutoff date"))
    lost = spark.createDataFrame([("t0", "t1")], "work_lo string, work_hi string")
    listed = study.citing_works(pairs, spark.createDataFrame(sorted(edges), "source_id string, target_id string"), spark.createDataFrame(list(works.items()), "work_id string, publication_date date"))
    found = study.pair_bridges(pairs, listed, lost).collect()
    want = []
    for c, (cut, named) in cases.items():
        for i, a in enumerate(named):
            for b in named[i + 1 :]:
                both = [s for s in {*works, "t0"} if (s, a) in edges and (s, b) in edges and s not in (a, b)]
                undated = sum(works.get(s) is None for s in both)
                want.append((c, a, b, len(both), sum(works.get(s) is not None and works[s] <= cut for s in both), undated, "PARTIAL" if {a, b} == {"t0", "t1"} else "COMPLETE", "t1" in (a, b)))
    assert sorted((r.case_id, r.work_a, r.work_b, r.total, r.pre_cutoff_bridge_count, r.date_uncertain_count, r.status, r.coverage_gap) for r in found) == sorted(want)


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    from priorlens.session import SHUFFLE_CLEANUP, cut_lineage

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before, setting = files(), spark.conf.get(SHUFFLE_CLEANUP)
    cut_lineage(spark.range(1000).groupBy("id").count())
    until = time.time() + 10
    while files() > before and time.time() < until:  # deleted in the background
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(SHUFFLE_CLEANUP) == setting
