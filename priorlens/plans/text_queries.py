"""Identifier, title, date and provider-record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import ids, text
from ..operators.normalize import normalize_papers
from ..schemas import AUTHORS
from ..sources import records
from .registry import Tables, query

S = F.expr

# ------------------------------------------------------------------ identifiers

RAW_DOI = """CASE p_size % 4
 WHEN 0 THEN concat('https://doi.org/10.1000/', upper(replace(p_brand, '#', '-')), '.', p_partkey, '.')
 WHEN 1 THEN concat('DOI: 10.1000/', replace(p_brand, '#', '-'), '.', p_partkey)
 WHEN 2 THEN concat(' http://dx.doi.org/10.1000/', replace(p_brand, '#', '－'), '.', p_partkey, '。')
 ELSE '' END"""


@query(
    "nrm_doi",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE '10.1000/' || lower(replace(p_brand, '#', '-')) || '.' || p_partkey END AS doi FROM part""",
)
def nrm_doi(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", ids.doi_key(S(RAW_DOI)).alias("doi"))


RAW_ARXIV = """CASE p_size % 4
 WHEN 0 THEN concat('arXiv:', lpad(cast(1000 + p_size AS string), 4, '0'), '.', lpad(cast(p_partkey AS string), 5, '0'), 'v', p_size)
 WHEN 1 THEN concat('https://arxiv.org/abs/', 1000 + p_size, '.', lpad(cast(p_partkey AS string), 5, '0'))
 WHEN 2 THEN concat('http://export.arxiv.org/pdf/Cs/', lpad(cast(p_partkey AS string), 7, '0'), 'V', p_size, '.PDF')
 ELSE '' END"""


@query(
    "nrm_arxiv",
    """SELECT p_partkey,
      CASE p_size % 4 WHEN 0 THEN (1000 + p_size)::varchar || '.' || lpad(p_partkey::varchar, 5, '0') WHEN 1 THEN (1000 + p_size)::varchar || '.' || lpad(p_partkey::varchar, 5, '0')
        WHEN 2 THEN 'cs/' || lpad(p_partkey::varchar, 7, '0') END AS base,
      CASE WHEN p_size % 4 IN (0, 2) THEN p_size END AS version FROM part""",
)
def nrm_arxiv(t: Tables) -> DataFrame:
    parts = ids.arxiv_parts(S(RAW_ARXIV))
    return t.part.select("p_partkey", parts["base"].alias("base"), parts["version"].alias("version"))


TITLE_KEY_SQL = "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"


@query("nrm_title", f"SELECT doc_id, md5({TITLE_KEY_SQL}) AS key_md5, length({TITLE_KEY_SQL}) AS key_chars FROM documents")
def nrm_title(t: Tables) -> DataFrame:
    key = text.title_key("text")
    return t.documents.select("doc_id", F.md5(key).alias("key_md5"), F.char_length(key).cast("bigint").alias("key_chars"))


@query(
    "nrm_ascii_title",
    """SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))) AS key_md5 FROM documents""",
)
def nrm_ascii_title(t: Tables) -> DataFrame:
    banner = F.concat(F.lit("Under review as a conference paper at "), F.upper("source"), F.lit(" 2025 "), F.col("text"))
    return t.documents.select("doc_id", F.md5(text.ascii_title_key(banner)).alias("key_md5"))


def part_authors():
    names = F.array(F.concat(F.lit("  "), F.col("p_name"), F.lit("  ")), F.col("p_type"), F.col("p_brand"), F.col("p_name"))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("").alias("orcid"), F.lit(None).cast("string").alias("id"))).cast(AUTHORS)


@query(
    "nrm_surnames",
    """SELECT p_partkey, split_part(p_name, ' ', 2) || ',' || lower(p_type) || ',' || split_part(p_brand, '#', 2) AS surnames, p_name AS first_author FROM part""",
)
def nrm_surnames(t: Tables) -> DataFrame:
    clean = ids.clean_names(part_authors())
    return t.part.select("p_partkey", F.array_join(ids.surnames(clean), ",").alias("surnames"), clean[0]["name"].alias("first_author"))


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_returnflag"


@query(
    "nrm_string_list",
    f"""WITH o AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS n FROM lineitem),
      f AS (SELECT l_orderkey, l_returnflag, min(n) AS n FROM o WHERE l_returnflag <> 'N' GROUP BY 1, 2)
      SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY n) AS flags FROM f GROUP BY 1""",
)
def nrm_string_list(t: Tables) -> DataFrame:
    blanked = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", blanked.alias("flag"))))
    lists = t.lineitem.groupBy("l_orderkey").agg(rows.alias("r"))
    flags = ids.distinct_strings(F.transform("r", lambda r: r["flag"]))
    return lists.select("l_orderkey", F.array_join(flags, ",").alias("flags")).filter("flags <> ''")


def part_records(t: Tables) -> DataFrame:
    """Parts as raw paper records: some with a DOI, some with an arXiv id, some with neither."""
    return t.part.select(
        F.lit("parts").alias("audit_id"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("P"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("title"), part_authors().alias("authors"),
        S("CASE WHEN p_partkey % 3 <> 1 THEN cast(1990 + p_size AS string) END").alias("year"), S(f"CASE WHEN p_partkey % 3 = 0 THEN {RAW_DOI} END").alias("doi"),
        S(f"CASE WHEN p_partkey % 3 = 1 THEN map('ArXiv', {RAW_ARXIV}) END").alias("external_ids"), F.array(F.lit(""), F.col("p_type"), F.col("p_type")).alias("providers"), S("cast(p_size AS int)").alias("arxiv_version"),
    )


@query(
    "nrm_record",
    """WITH k AS (SELECT *, CASE WHEN p_partkey % 3 = 0 AND p_size % 4 <> 3 THEN '10.1000/' || lower(replace(p_brand, '#', '-')) || '.' || p_partkey END AS doi,
        CASE WHEN p_partkey % 3 = 1 THEN CASE p_size % 4 WHEN 0 THEN (1000 + p_size)::varchar || '.' || lpad(p_partkey::varchar, 5, '0') WHEN 1 THEN (1000 + p_size)::varchar || '.' || lpad(p_partkey::varchar, 5, '0')
        WHEN 2 THEN 'cs/' || lpad(p_partkey::varchar, 7, '0') END END AS arxiv FROM part)
      SELECT 'P' || p_partkey AS id, doi, arxiv AS arxiv_id, p_size AS arxiv_version,
        coalesce('doi:' || doi, 'arxiv:' || arxiv, 'title:' || p_name || '|' || p_name || '|' || CASE WHEN p_partkey % 3 <> 1 THEN (1990 + p_size)::varchar ELSE 'unknown' END) AS canonical_key,
        p_type || ',source' AS providers, 'P' || p_partkey AS provider_id FROM k""",
)
def nrm_record(t: Tables) -> DataFrame:
    p = normalize_papers(part_records(t), "source")
    return p.select("id", "doi", "arxiv_id", "arxiv_version", "canonical_key", F.array_join("providers", ",").alias("providers"), F.col("provider_ids")["source"].alias("provider_id"))


@query(
    "nrm_alias_forms",
    """WITH r AS (SELECT page_id, url AS raw, lower(url) AS low FROM pages),
      k AS (SELECT *, split_part(raw, '/', -1) AS tail, CASE WHEN contains(low, 'doi') OR starts_with(low, '10.') THEN regexp_replace(low, '[.,;):]+$', '') END AS doi,
        CASE WHEN contains(low, 'arxiv') OR regexp_matches(raw, '^\\d{4}') THEN trim(regexp_replace(regexp_replace(low, '\\.pdf$', ''), 'v\\d+$', '')) END AS arxiv FROM r),
      f AS (SELECT page_id, unnest([raw, low, doi, 'doi:' || doi, arxiv, 'arxiv:' || arxiv, tail, lower(tail)]) AS form FROM k)
      SELECT DISTINCT page_id, form FROM f WHERE form <> ''""",
)
def nrm_alias_forms(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(ids.alias_forms("url")).alias("form"))


def order_text(t: Tables) -> DataFrame:
    """Per order: a review sentence with bracketed references and a numbered bibliography."""
    per = t.lineitem.groupBy("l_orderkey").agg(
        F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.count("*").alias("n"), F.sum("l_partkey").alias("parts"),
        F.array_sort(F.collect_set(F.struct("l_linenumber", "l_partkey"))).alias("lines"),
    )
    cite = F.concat(F.lit("prior ["), F.col("lo"), F.lit(" - "), F.col("hi"), F.lit(", "), F.col("n") + 10, F.lit("] but not [1-99] nor [x]; see ["), F.col("n"), F.lit("]"))
    blocks = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("["), x["l_linenumber"], F.lit("] Part "), x["l_partkey"], F.lit(".\n  cont"))), "\n")
    return per.select("l_orderkey", "lo", "hi", "n", "parts", cite.alias("novelty"), blocks.alias("review"))


@query(
    "nrm_reference_numbers",
    """WITH p AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(*) AS n FROM lineitem GROUP BY 1),
      x AS (SELECT l_orderkey, unnest(list_concat(range(lo, hi + 1), [n + 10, n])) AS v FROM p)
      SELECT l_orderkey, string_agg(DISTINCT v::varchar, ',' ORDER BY lpad(v::varchar, 6, '0')) AS numbers FROM (SELECT DISTINCT l_orderkey, v FROM x) GROUP BY 1""".replace("string_agg(DISTINCT v::varchar,", "string_agg(v::varchar,"),
)
def nrm_reference_numbers(t: Tables) -> DataFrame:
    return order_text(t).select("l_orderkey", F.array_join(ids.reference_numbers("novelty").cast("array<string>"), ",").alias("numbers"))


@query(
    "nrm_reference_blocks",
    """SELECT DISTINCT l_orderkey, l_linenumber::bigint AS n, 'Part ' || l_partkey || '.' || chr(10) || '  cont' AS block FROM lineitem""",
)
def nrm_reference_blocks(t: Tables) -> DataFrame:
    return order_text(t).select("l_orderkey", F.explode(ids.reference_blocks("review")).alias("b")).select("l_orderkey", "b.n", "b.block")


PROSE = """concat('As in arXiv:', 2000 + o_custkey % 300, '.', lpad(cast(o_orderkey AS string), 5, '0'), 'v2 and doi 10.', 1000 + o_custkey, '/X-', o_orderkey,
 '), see [order ', o_orderkey, '](https://arxiv.org/abs/', 2000 + o_custkey % 300, '.', lpad(cast(o_orderkey AS string), 5, '0'), ') or [xy](http://h/', o_custkey, ').')"""


@query(
    "nrm_text_ids",
    """SELECT o_orderkey, (2000 + o_custkey % 300)::varchar || '.' || lpad(o_orderkey::varchar, 5, '0') AS arxiv, '10.' || (1000 + o_custkey) || '/x-' || o_orderkey AS doi,
      'order ' || o_orderkey || '=https://arxiv.org/abs/' || (2000 + o_custkey % 300) || '.' || lpad(o_orderkey::varchar, 5, '0') || ';xy=http://h/' || o_custkey AS links FROM orders""",
)
def nrm_text_ids(t: Tables) -> DataFrame:
    o = t.orders.withColumn("prose", S(PROSE))
    links = F.transform(ids.markdown_links("prose"), lambda k: F.concat_ws("=", k["label"], k["url"]))
    return o.select("o_orderkey", F.array_join(ids.text_arxiv_ids("prose"), ",").alias("arxiv"), F.array_join(ids.text_dois("prose"), ",").alias("doi"), F.array_join(links, ";").alias("links"))


@query(
    "nrm_title_alias",
    """SELECT p_partkey, CASE WHEN p_size % 3 <> 2 THEN upper(p_type) END AS alias FROM part""",
)
def nrm_title_alias(t: Tables) -> DataFrame:
    title = S("CASE p_size % 3 WHEN 0 THEN concat(p_type, ': a ', p_name, ': again') WHEN 1 THEN p_type ELSE concat(p_brand, ': ', p_name) END")
    return t.part.select("p_partkey", ids.title_alias(title).alias("alias"))


@query(
    "nrm_error_class",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'RATE_LIMIT' WHEN o_orderkey % 6 = 1 THEN 'HTTP_5XX' WHEN o_orderkey % 6 = 2 THEN 'TIMEOUT' WHEN o_orderkey % 6 = 3 THEN 'MALFORMED_RESPONSE'
      WHEN o_orderkey % 6 = 4 THEN 'AUTH' ELSE 'OTHER' END AS error_code FROM orders""",
)
def nrm_error_class(t: Tables) -> DataFrame:
    message = S(
        """concat(o_orderpriority, ' ', element_at(array('HTTP 429 URLError', 'HTTP 503', 'URLError <Timeout>', 'JSONDecodeError: x', 'HTTP 403', 'HTTP 404'), cast(o_orderkey % 6 + 1 AS int)))"""
    )
    return t.orders.select("o_orderkey", ids.error_class(message).alias("error_code"))


@query(
    "nrm_urls",
    """WITH k AS (SELECT page_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS kind FROM pages)
      SELECT page_id, kind, kind IN (0, 6, 7) AS is_public, CASE WHEN kind = 6 THEN (2000 + page_id % 300) || '.' || lpad(page_id::varchar, 5, '0') END AS arxiv_base,
        CASE WHEN kind = 6 THEN (1 + page_id % 9)::int END AS arxiv_version FROM k""",
)
def nrm_urls(t: Tables) -> DataFrame:
    host = "regexp_replace(url, '^https?://', '')"
    forms = S(
        f"""array(url, concat('ftp://', {host}), concat('http://user:pw@', {host}), concat('http://localhost/', page_id), concat('http://10.', page_id % 250, '.1.2/'),
        concat('https://a.localhost/', page_id), concat('https://www.arxiv.org/pdf/', 2000 + page_id % 300, '.', lpad(cast(page_id AS string), 5, '0'), 'v', 1 + page_id % 9, '.pdf'), concat('http://8.8.', page_id % 250, '.8/x'))"""
    )
    u = t.pages.select("page_id", F.posexplode(forms).alias("kind", "u"))
    arxiv = ids.arxiv_url_parts("u")
    return u.select("page_id", "kind", ids.is_public_url("u").alias("is_public"), arxiv["base"].alias("arxiv_base"), arxiv["version"].alias("arxiv_version"))


# ------------------------------------------------------------------ dates

DATE_TEXT = """CASE o_orderkey % 7 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy-M-d') WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM')
 WHEN 3 THEN date_format(o_orderdate, 'yyyy') WHEN 4 THEN concat(year(o_orderdate), '-13-', day(o_orderdate)) WHEN 5 THEN '' ELSE date_format(o_orderdate, 'dd/MM/yyyy') END"""


@query(
    "dat_parse",
    """WITH d AS (SELECT o_orderkey, o_orderdate::date AS d, o_orderkey % 7 AS k FROM orders)
      SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN 'day' WHEN k = 2 THEN 'month' WHEN k = 3 THEN 'year' WHEN k = 5 THEN 'missing' ELSE 'invalid' END AS precision,
        CASE WHEN k IN (0, 1) THEN d END AS parsed, CASE WHEN k IN (0, 1) THEN d WHEN k = 2 THEN date_trunc('month', d)::date WHEN k = 3 THEN make_date(year(d), 1, 1) END AS lower_bound,
        CASE WHEN k IN (0, 1) THEN d WHEN k = 2 THEN last_day(d) WHEN k = 3 THEN make_date(year(d), 12, 31) END AS upper_bound FROM d""",
)
def dat_parse(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", D.parse_date(S(DATE_TEXT)).alias("p")).select("o_orderkey", "p.precision", "p.parsed", "p.lower_bound", "p.upper_bound")


# ------------------------------------------------------------------ provider records


def inverted_index(docs: DataFrame) -> DataFrame:
    """``(doc_id, index)``: the places of each word of a text, found by sorting the row's own words."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    placed = docs.select("doc_id", F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p")))).alias("s"))
    new = lambda k: (k == 0) | (F.get("s", k)["w"] != F.get("s", k - 1)["w"])
    found = placed.withColumn("starts", F.when(F.size("s") > 0, F.filter(F.sequence(F.lit(0), F.size("s") - 1), new)).when(F.col("s").isNotNull(), F.array().cast("array<int>")))
    entry = F.transform(
        "starts",
        lambda k, i: F.struct(F.get("s", k)["w"].alias("w"), F.transform(F.slice("s", k + 1, F.coalesce(F.get("starts", i + 1), F.size("s")) - k), lambda x: x["p"]).alias("ps")),
    )
    return found.select("doc_id", F.map_from_entries(entry).alias("index"))


@query(
    "src_abstract",
    """SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ')) AS abstract_md5 FROM documents""",
)
def src_abstract(t: Tables) -> DataFrame:
    return inverted_index(t.documents).select("doc_id", F.md5(F.coalesce(records.rebuild_abstract(F.col("index")), F.when(F.col("index").isNotNull(), ""))).alias("abstract_md5"))


def openalex_works(t: Tables) -> DataFrame:
    """Orders as OpenAlex works: parts are referenced works, suppliers authors."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"), F.array_sort(F.collect_set("l_suppkey")).alias("supps"))
    return t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.concat(F.lit("https://openalex.org/W"), F.col("o_orderkey")).alias("id"), S("CASE WHEN o_orderkey % 2 = 0 THEN concat('Order  ', o_orderkey) ELSE '' END").alias("display_name"),
        S("concat('Fallback ', o_orderkey)").alias("title"), S("map(o_orderstatus, array(1, 3), 'x', array(0, 2))").alias("abstract_inverted_index"),
        F.transform("supps", lambda s: F.struct(F.struct(F.concat(F.lit("Supplier "), s).alias("display_name"), s.cast("string").alias("id")).alias("author"))).alias("authorships"),
        F.year("o_orderdate").alias("publication_year"), S("CASE WHEN o_orderkey % 5 > 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') END").alias("publication_date"),
        S("named_struct('landing_page_url', concat('https://h/', o_orderkey), 'source', named_struct('display_name', o_orderpriority))").alias("primary_location"),
        S("named_struct('doi', CASE WHEN o_orderkey % 3 = 0 THEN concat('https://doi.org/10.7/', o_orderkey) END)").alias("ids"), F.col("o_custkey").alias("cited_by_count"),
        S("named_struct('oa_url', cast(null as string), 'is_oa', false)").alias("open_access"), F.transform("parts", lambda p: F.concat(F.lit("https://openalex.org/W"), p)).alias("referenced_works"),
    )


@query(
    "src_openalex",
    """WITH l AS (SELECT l_orderkey, string_agg('W' || l_partkey, ',' ORDER BY l_partkey) AS refs FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1),
      a AS (SELECT l_orderkey, min(l_suppkey) AS s, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
      SELECT 'W' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || o_orderkey ELSE 'Fallback ' || o_orderkey END AS title, 'x ' || o_orderstatus || ' x ' || o_orderstatus AS abstract,
        year(o_orderdate)::varchar AS year, o_orderpriority AS venue, coalesce(n, 0)::bigint AS n_authors, coalesce(refs, '') AS refs, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_value,
        CASE WHEN o_orderkey % 3 = 0 THEN 'doi:10.7/' || o_orderkey ELSE 'title:' || CASE WHEN o_orderkey % 2 = 0 THEN 'order ' ELSE 'fallback ' END || o_orderkey || '|' || coalesce('supplier ' || s, '') || '|' || year(o_orderdate) END AS canonical_key,
        'https://openalex.org/W' || o_orderkey AS provider_id
      FROM orders LEFT JOIN l ON l.l_orderkey = o_orderkey LEFT JOIN a ON a.l_orderkey = o_orderkey""",
)
def src_openalex(t: Tables) -> DataFrame:
    p = records.from_openalex(openalex_works(t))
    return p.select(
        "id", "title", "abstract", "year", "venue", F.size("authors").cast("bigint").alias("n_authors"), F.array_join("references", ",").alias("refs"), F.get("dates", F.lit(0))["value"].alias("date_value"),
        "canonical_key", F.get("raw_provenance", F.lit(0))["provider_id"].alias("provider_id"),
    )


@query(
    "src_semantic_scholar",
    """SELECT 's' || p_partkey AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN '10.9/' || p_partkey END AS doi, CASE WHEN p_size % 5 = 0 THEN '2101.' || lpad(p_partkey::varchar, 5, '0') END AS arxiv_id,
      CASE WHEN p_size % 5 = 0 THEN p_size END AS arxiv_version, 's1' AS refs, p_brand || ',' || p_type AS authors, (2000 + p_size)::varchar AS year FROM part""",
)
def src_semantic_scholar(t: Tables) -> DataFrame:
    rows = t.part.select(
        S("concat('s', p_partkey)").alias("paperId"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("abstract"), S("array(named_struct('name', p_brand, 'authorId', '1'), named_struct('name', p_type, 'authorId', '2'))").alias("authors"),
        (F.col("p_size") + 2000).alias("year"), F.col("p_type").alias("venue"), F.lit("https://h").alias("url"),
        S("map_concat(map('MAG', 'm'), CASE WHEN p_size % 2 = 0 THEN map('DOI', concat('10.9/', p_partkey, '.')) ELSE map() END, CASE WHEN p_size % 5 = 0 THEN map('ArXiv', concat('2101.', lpad(cast(p_partkey AS string), 5, '0'), 'v', p_size)) ELSE map() END)").alias("externalIds"),
        F.col("p_size").cast("bigint").alias("citationCount"), F.lit("2020-01-01").alias("publicationDate"), S("named_struct('url', 'https://h/x.pdf')").alias("openAccessPdf"),
        S("array(named_struct('paperId', 's1'), named_struct('paperId', cast(null as string)), named_struct('paperId', 's1'))").alias("references"), F.lit(1).cast("bigint").alias("referenceCount"),
    )
    p = records.from_semantic_scholar(rows)
    return p.select("id", "title", "doi", "arxiv_id", "arxiv_version", F.array_join("references", ",").alias("refs"), F.array_join(F.transform("authors", lambda a: a["name"]), ",").alias("authors"), "year")


@query(
    "src_crossref",
    """WITH d AS (SELECT *, o_orderdate::date AS d, o_orderkey % 4 AS k FROM orders)
      SELECT '10.5/' || o_orderkey AS doi, CASE k WHEN 0 THEN strftime(d, '%Y-%m') WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 2 THEN strftime(d, '%Y') END AS date_value,
        CASE k WHEN 0 THEN 'crossref_published_online' WHEN 1 THEN 'crossref_issued' WHEN 2 THEN 'year_only' END AS date_source, CASE WHEN k < 3 THEN strftime(d, '%Y') END AS year, 'Ann B' || o_custkey AS author FROM d""",
)
def src_crossref(t: Tables) -> DataFrame:
    y, m, d = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"
    parts = "struct<`date-parts`:array<array<int>>>"
    rows = t.orders.select(
        S("concat('10.5/', o_orderkey)").alias("DOI"), S("array(o_orderstatus)").alias("title"), F.lit(None).cast("string").alias("abstract"), S("array(named_struct('given', 'Ann', 'family', concat('B', o_custkey), 'ORCID', cast(null as string)))").alias("author"),
        S(f"CASE WHEN o_orderkey % 4 = 0 THEN named_struct('date-parts', array(array({y}, {m}))) END").cast(parts).alias("published-online"), S(f"CASE WHEN o_orderkey % 4 < 2 THEN named_struct('date-parts', array(array({y}, {m}, {d}))) WHEN o_orderkey % 4 = 3 THEN named_struct('date-parts', array(array())) END").cast(parts).alias("issued"),
        S(f"CASE WHEN o_orderkey % 4 = 2 THEN named_struct('date-parts', array(array({y}))) END").cast(parts).alias("published-print"), S("array(o_orderpriority)").alias("container-title"), F.lit("https://h").alias("URL"),
        F.lit(1).cast("bigint").alias("is-referenced-by-count"), S("array(named_struct('DOI', cast(null as string)))").alias("reference"),
    )
    p = records.from_crossref(rows)
    first = F.get("dates", F.lit(0))
    return p.select("doi", first["value"].alias("date_value"), first["source"].alias("date_source"), "year", F.get("authors", F.lit(0))["name"].alias("author"))


@query(
    "src_arxiv",
    """WITH d AS (SELECT *, (1 + o_orderkey % 4)::int AS v, '2001.' || lpad(o_orderkey::varchar, 5, '0') AS base, strftime(o_orderdate, '%Y-%m-%d') AS pub, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS upd FROM orders)
      SELECT base || 'v' || v AS id, base AS arxiv_id, v AS arxiv_version, 'Order ' || o_orderkey AS title, 'arxiv_v1=' || pub || CASE WHEN v > 1 THEN ';arxiv_v' || v || '=' || upd ELSE '' END AS dates,
        'https://arxiv.org/pdf/' || base || 'v' || v AS pdf, upd AS submitted_at, left(pub, 4) AS year FROM d""",
)
def src_arxiv(t: Tables) -> DataFrame:
    base = "concat('2001.', lpad(cast(o_orderkey AS string), 5, '0'))"
    rows = t.orders.select(
        S(f"concat('http://arxiv.org/abs/', {base}, CASE WHEN o_orderkey % 2 = 0 THEN concat('v', 1 + o_orderkey % 4) ELSE '' END)").alias("id"), S("concat(' Order\n ', o_orderkey)").alias("title"), F.col("o_orderstatus").alias("summary"),
        S("date_format(o_orderdate, 'yyyy-MM-dd\\'T\\'HH:mm:ss\\'Z\\'')").alias("published"), S("date_format(o_orderdate + interval 30 days, 'yyyy-MM-dd\\'T\\'HH:mm:ss\\'Z\\'')").alias("updated"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("journal_ref"),
        S("array(named_struct('name', 'A B'))").alias("author"),
        S(f"array(named_struct('_href', concat('http://arxiv.org/abs/', {base}), '_rel', 'alternate', '_title', cast(null as string), '_type', 'text/html'), named_struct('_href', concat('http://arxiv.org/pdf/', {base}, 'v', 1 + o_orderkey % 4), '_rel', 'related', '_title', 'pdf', '_type', 'application/pdf'))").alias("link"),
    )
    p = records.from_arxiv(rows)
    return p.select(
        "id", "arxiv_id", "arxiv_version", "title", F.array_join(F.transform("dates", lambda d: F.concat_ws("=", d["source"], d["value"])), ";").alias("dates"), F.get("fulltext_urls", F.lit(0)).alias("pdf"),
        F.get("arxiv_versions", F.lit(0))["submitted_at"].alias("submitted_at"), "year",
    )
