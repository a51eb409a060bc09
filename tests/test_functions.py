"""Column functions against hand-checked values."""

import pytest
from pyspark.sql import functions as F

from priorlens.functions import dates as D
from priorlens.functions import ids as I
from priorlens.functions import text as X
from priorlens.functions.ratio import title_ratio, titles_alike


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("r")).first()
    return row["r"]


def test_doi_forms(spark):
    for raw in ("https://doi.org/10.1000/ABC.", "DOI: 10.1000/ＡＢＣ。", " http://dx.doi.org/10.1000/abc;) "):
        assert one(spark, I.doi_key("v"), v=raw) == "10.1000/abc"
    assert one(spark, I.doi_key("v"), v="") is None
    assert one(spark, I.doi_key("v", exact=True), v="doi:10.1/ﬁx") == "10.1/fix"


def test_arxiv_forms(spark):
    r = one(spark, I.arxiv_parts("v"), v="arXiv:2401.01234v3")
    assert (r["base"], r["version"]) == ("2401.01234", 3)
    r = one(spark, I.arxiv_parts("v"), v="https://export.arxiv.org/pdf/cs/0101001v2.pdf")
    assert (r["base"], r["version"]) == ("cs/0101001", 2)
    r = one(spark, I.arxiv_parts("v"), v="")
    assert (r["base"], r["version"]) == (None, None)


def test_title_keys(spark):
    assert one(spark, X.title_key("v"), v="Ａ Method:  Memory—Update") == "a method memory update"
    assert one(spark, X.title_key("v"), v="snake_case Straße") == "snake_case strasse"
    assert one(spark, X.ascii_title_key("v"), v="Under review as a conference paper at ICLR 2025 Foo-Bar é") == "foo bar"


def test_canonical_key(spark):
    authors = F.expr("array(named_struct('name','Ada  Lovelace','orcid',cast(null as string),'id',cast(null as string)))")
    none = F.lit(None).cast("string")
    assert one(spark, I.canonical_key(F.lit("10.1/X."), none, F.lit("T"), authors, none)) == "doi:10.1/x"
    assert one(spark, I.canonical_key(none, F.lit("2401.00001v2"), F.lit("T"), authors, none)) == "arxiv:2401.00001"
    assert one(spark, I.canonical_key(none, none, F.lit("A T!"), authors, none)) == "title:a t|ada lovelace|unknown"
    assert one(spark, I.canonical_key(none, none, F.lit("A T!"), F.expr("cast(array() as array<struct<name:string>>)"), F.lit(2020))) == "title:a t||2020"


def test_alias_forms(spark):
    assert one(spark, I.alias_forms("v"), v="https://openalex.org/W12") == ["https://openalex.org/W12", "https://openalex.org/w12", "W12", "w12"]
    got = one(spark, I.alias_forms("v"), v="https://doi.org/10.5/AB")
    assert {"10.5/ab", "doi:10.5/ab", "AB", "ab"} <= set(got)
    assert "arxiv:2401.00001" in one(spark, I.alias_forms("v"), v="2401.00001v1")


def test_reference_numbers_and_blocks(spark):
    assert one(spark, I.reference_numbers("v"), v="see [1-3, 7] and [9] but not [5-90]") == [1, 2, 3, 7, 9]
    blocks = one(spark, I.reference_blocks("v"), v="[1] First one.\n[2] Second\nline\n [3] Third")
    assert [(b["n"], b["block"]) for b in blocks] == [(1, "First one."), (2, "Second\nline"), (3, "Third")]


def test_text_identifiers(spark):
    v = "as in arXiv:2301.00001v2 and arxiv.org/abs/2302.12345, doi 10.1234/AbC-9)."
    assert one(spark, I.text_arxiv_ids("v"), v=v) == ["2301.00001", "2302.12345"]
    assert one(spark, I.text_dois("v"), v=v) == ["10.1234/abc-9"]
    links = one(spark, I.markdown_links("v"), v="x [A paper](https://arxiv.org/abs/2401.00001) y")
    assert [(k["label"], k["url"]) for k in links] == [("A paper", "https://arxiv.org/abs/2401.00001")]
    assert one(spark, I.title_alias("v"), v="BERT: pre-training") == "BERT"
    assert one(spark, I.title_alias("v"), v="Bert: pre-training") is None


def test_urls(spark):
    good = ["https://example.org/a", "http://8.8.8.8/x", "https://[2606:4700::1]/"]
    bad = ["ftp://example.org", "http://localhost/x", "http://a.localhost/", "http://127.0.0.1/", "http://10.2.3.4/",
           "http://user:pw@example.org/", "not a url", "http://192.168.1.1/", "http://[::1]/"]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string").select("u", I.is_public_url("u").alias("ok"))
    got = {r["u"]: r["ok"] for r in df.collect()}
    assert [u for u in good if not got[u]] == []
    assert [u for u in bad if got[u]] == []
    r = one(spark, I.arxiv_url_parts("v"), v="https://arxiv.org/pdf/1706.03762v2.pdf")
    assert (r["base"], r["version"]) == ("1706.03762", 2)
    assert one(spark, I.arxiv_url_parts("v"), v="https://example.org/pdf/1706.03762v2") is None


def test_error_class(spark):
    for msg, want in {
        "HTTP 429 from x": "RATE_LIMIT", "HTTP 503": "HTTP_5XX", "URLError: t": "TIMEOUT", "ParseError": "MALFORMED_RESPONSE",
        "HTTP 403": "AUTH", "nope": "OTHER", "HTTP 429 Timeout": "RATE_LIMIT",
    }.items():
        assert one(spark, I.error_class("v"), v=msg) == want


def test_date_precision(spark):
    def parts(v):
        r = one(spark, D.parse_date("v"), v=v)
        return r["precision"], str(r["parsed"]), str(r["lower_bound"]), str(r["upper_bound"])

    assert parts("2024-1-5")[:2] == ("day", "2024-01-05")
    assert parts("2024-02") == ("month", "None", "2024-02-01", "2024-02-29")
    assert parts("2023") == ("year", "None", "2023-01-01", "2023-12-31")
    assert parts("2023-13-01")[0] == "invalid" and parts("2023-13")[0] == "invalid"
    assert parts("")[0] == "missing" and parts(None)[0] == "missing" and parts("May 2020")[0] == "invalid"


def test_window_labels(spark):
    cut = F.lit("2025-01-01").cast("date")
    for days, want in [(None, "ENDPOINT_DATE_UNRESOLVED"), (-1, "POST_CUTOFF_ENDPOINT"), (547, "BELOW_DIAGNOSTIC_THRESHOLD"), (548, "MEETS_DIAGNOSTIC_THRESHOLD")]:
        assert one(spark, D.window_status(F.lit(days).cast("int"), cut)) == want
    assert one(spark, D.observation_window(F.lit("2022-03-01").cast("date"), F.lit("2023-04-02").cast("date"), F.lit("2025-09-18").cast("date"))) == 900


def test_html(spark):
    page = "<html><style>p{}</style><body><p>Adaptive &amp; memory</p>\n\n<script>x</script><b>two</b></body></html>"
    assert one(spark, X.html_to_text("v"), v=page).split() == ["Adaptive", "&", "memory", "two"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a &mdash; b &#8212; c &eacute; &#xe9; &copy2 &AMP; &nosuch; &#150; &#0; x&y</p>", "a — b — c é é ©2 & &nosuch; – � x&y"),
        ("<p>one</p><svg>x<svg>y</svg>z</svg><noscript>a<svg>b</svg></noscript>two", "one two"),
        ("one<svg/>two<script>var a = '</p>';", "one two"),
        ("one<noscript>hidden to the end", "one"),
        ("</svg>one<!-- a > b --><b>two</b>\n \n<i>three</i>", "one two three"),
        (None, None),
        ("", ""),
    ],
)
def test_html_text(spark, page, text):
    got = spark.createDataFrame([(page,)], "v string").select(X.html_to_text("v")).first()[0]
    assert (got.split() if got else got) == (text.split() if text else text)


def test_leaks(spark):
    assert one(spark, X.leaked_fields("v"), v="novelty 99.99%") == ["novelty_number"]
    assert one(spark, X.leaked_fields("v"), v="has Similarity_Score in it") == ["similarity_score"]
    assert one(spark, X.leaked_fields("v"), v="novelty is residual") == []


def test_title_ratio(spark):
    """Blocks, bounds and popular characters, against the standard matcher."""
    import difflib
    import random

    rng = random.Random(1)
    rows = [("abcd efgh", "abcd efgi"), ("a b", "b a"), ("", ""), ("", "a"), ("x" * 250, "x" * 249 + "y"), ("ab" * 120, "ba" * 120)]
    for _ in range(400):
        letters = rng.choice(["ab ", "abcdefghij ", "abcdefghijklmnop é漢🙂 "])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 20, 60, 199, 200, 260])))
        b = list(a)
        for _ in range(rng.randrange(8)):
            b[rng.randrange(len(b))] = rng.choice(["", "x", "yy"])
        rows.append((a, "".join(b) if rng.random() < 0.8 else "".join(rng.choice(letters) for _ in a)))
    df = spark.createDataFrame(rows, "a string, b string").repartition(8)
    got = df.select("a", "b", title_ratio("a", "b").alias("r"), title_ratio("a", "b", 0.97).alias("q"), titles_alike("a", "b", 0.9).alias("s")).collect()
    for r in got:
        want = difflib.SequenceMatcher(None, r.a, r.b).ratio()
        assert r.r == pytest.approx(want, abs=1e-12) and (r.q >= 0.97) == (want >= 0.97) and r.s == (want >= 0.9)
    nulls = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert [tuple(r) for r in nulls.select(title_ratio("a", "b"), titles_alike("a", "b", 0.9)).collect()] == [(None, False)] * 2


def test_exact_interval(spark):
    """Against sums of binomial terms, bisected in plain Python."""
    import math

    from priorlens.functions.binomial import exact_interval, log_gamma

    def tail(k, n, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(v + 1) - math.lgamma(n - v + 1) + v * math.log(p) + (n - v) * math.log1p(-p)) for v in range(k, n + 1))

    def solve(k, n, target):
        lo, hi = 0.0, 1.0
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if tail(k, n, mid) < target else (lo, mid)
        return lo

    rows = [(4, 18), (1, 1), (0, 5), (5, 5), (1, 2), (7, 1000), (500, 1000), (999, 1000), (3000, 9000), (1, 9000)]
    for r in spark.createDataFrame(rows, "k bigint, n bigint").select("k", "n", exact_interval("k", "n").alias("i")).collect():
        assert r.i.lower == pytest.approx(0.0 if r.k == 0 else solve(r.k, r.n, 0.025), abs=6e-5)
        assert r.i.upper == pytest.approx(1.0 if r.k == r.n else solve(r.k + 1, r.n, 0.975), abs=6e-5)
    odd = spark.createDataFrame([(None, 3), (3, None), (0, 0), (4, 3), (-1, 3)], "k bigint, n bigint").select(exact_interval("k", "n").alias("i")).collect()
    assert all(r.i.lower is None and r.i.upper is None for r in odd)
    got = spark.createDataFrame([(float(x),) for x in (1, 2, 3.5, 10, 171, 1e6)], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in got)
