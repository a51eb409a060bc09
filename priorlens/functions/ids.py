"""Identifiers: DOI, arXiv, alias forms, canonical keys, URLs, references in free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, compat, fold_case, strip, squeeze, title_key

# Link and scheme prefixes, trailing punctuation of cited identifiers.
DOI_PREFIX = r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)"
DOI_TAIL = "[.,;):。；，）]+$"
ARXIV_PREFIX = r"(?i)^(https?://((www|export)\.)?arxiv\.org/(abs|pdf)/|arxiv:\s*)"
ARXIV_VERSION = r"(?i)v(\d+)$"
ARXIV_HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org")
# Identifiers as they occur in prose.
TEXT_ARXIV = r"(?i)(?:arxiv(?:\.org/(?:abs|pdf)/|\s*(?::|preprint\s+arxiv:)?\s*))(\d{4}\.\d{4,5}(?:v\d+)?)"
TEXT_DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
MARKDOWN_LINK = r"\[([^\]]{2,200})\]\((https?://[^)]+)\)"
BIBLIOGRAPHY_DOI = r"(?i)10\.\d{4,9}/[^\s\]\[<>\"']+"
BIBLIOGRAPHY_ARXIV = r"(?i)(?:arxiv:\s*)?([a-z-]+/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?"


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def doi_key(c: Column | str, exact: bool = False) -> Column:
    """Normalised DOI or null."""
    text = strip(compat(c, exact))
    text = strip(F.regexp_replace(text, DOI_PREFIX, ""))
    return _blank_to_null(fold_case(F.regexp_replace(text, DOI_TAIL, "")))


def arxiv_parts(c: Column | str, exact: bool = False) -> Column:
    """``struct(base, version)`` of an arXiv identifier or link."""
    text = F.regexp_replace(strip(compat(c, exact)), ARXIV_PREFIX, "")
    text = F.regexp_replace(text, r"(?i)\.pdf$", "")
    version = F.regexp_extract(text, ARXIV_VERSION, 1).try_cast("int")
    base = _blank_to_null(fold_case(strip(F.regexp_replace(text, ARXIV_VERSION, ""))))
    return F.struct(base.alias("base"), version.alias("version"))


def arxiv_key(c: Column | str, exact: bool = False) -> Column:
    return arxiv_parts(c, exact)["base"]


def clean_names(authors: Column) -> Column:
    """Author structs with squeezed names; orcid and id become null when blank."""
    return F.transform(
        F.coalesce(authors, F.array().cast("array<struct<name:string,orcid:string,id:string>>")),
        lambda a: F.struct(
            squeeze(F.coalesce(a["name"], F.lit(""))).alias("name"),
            _blank_to_null(a["orcid"]).alias("orcid"),
            _blank_to_null(a["id"]).alias("id"),
        ),
    )


def surnames(authors: Column) -> Column:
    """Distinct last tokens of the normalised author names, without blanks."""
    keys = F.filter(F.transform(authors, lambda a: title_key(a["name"])), lambda k: k != "")
    return F.array_distinct(F.transform(keys, lambda k: F.element_at(F.split(k, " "), -1)))


def study_surnames(names: Column) -> Column:
    """Last Latin token of each name, original order and spelling (study variant)."""
    tokens = F.transform(names, lambda n: F.regexp_extract_all(n, F.lit(r"[A-Za-z][A-Za-z'-]+"), F.lit(0)))
    return F.transform(F.filter(tokens, lambda t: F.size(t) > 0), lambda t: F.element_at(t, -1))


def distinct_strings(values: Column) -> Column:
    """Drop null and blank entries, keep first occurrences in order."""
    return F.array_distinct(F.array_remove(F.array_compact(F.coalesce(values, F.array().cast("array<string>"))), ""))


def canonical_key(doi: Column, arxiv_id: Column, title: Column, authors: Column, year: Column) -> Column:
    first = F.when(F.size(authors) > 0, title_key(F.get(authors, F.lit(0))["name"])).otherwise(F.lit(""))
    year = year.cast("string")
    shown = F.when(year.isNull() | year.isin("", "0"), F.lit("unknown")).otherwise(year)
    by_title = F.concat(F.lit("title:"), title_key(title), F.lit("|"), first, F.lit("|"), shown)
    return F.coalesce(
        F.concat(F.lit("doi:"), doi_key(doi)), F.concat(F.lit("arxiv:"), arxiv_key(arxiv_id)), by_title
    )


def alias_forms(c: Column | str) -> Column:
    """Every spelling under which an identifier may be looked up, in fixed priority.

    Order: raw, lower case, DOI, arXiv, last path segment, its lower case. The
    order is ours: where two spellings point at different works, the earlier wins.
    """
    raw = strip(_col(c).cast("string"))
    low = fold_case(raw)
    doi = F.when(low.contains("doi") | low.startswith("10."), doi_key(raw))
    arxiv = F.when(low.contains("arxiv") | raw.rlike(r"^\p{Nd}{4}"), arxiv_key(raw))
    tail = F.element_at(F.split(raw, "/"), -1)
    forms = F.array(
        raw, low, doi, F.concat(F.lit("doi:"), doi), arxiv, F.concat(F.lit("arxiv:"), arxiv), tail, fold_case(tail)
    )
    return distinct_strings(forms)


def edge_forms(c: Column | str) -> Column:
    """Narrower spellings used when provider references are compared with an endpoint."""
    raw = strip(_col(c).cast("string"))
    low = fold_case(raw)
    doi = F.when(low.startswith("10.") | low.contains("doi"), doi_key(raw))
    return distinct_strings(F.array(low, fold_case(F.element_at(F.split(raw, "/"), -1)), doi, F.concat(F.lit("doi:"), doi)))


def title_alias(title: Column | str) -> Column:
    """Upper-case prefix before the first colon (2 to 15 characters), or null."""
    prefix = strip(F.get(F.split(_col(title), ":", 2), F.lit(0)))
    return F.when(prefix.rlike(r"^[A-Z][A-Z0-9-]{1,14}$"), prefix)


# ----------------------------------------------------------- references in text
# The patterns below must cut the same numbers and blocks as the format they read.


def reference_numbers(text: Column | str) -> Column:
    """Sorted distinct numbers cited as ``[1-3, 7]``; ranges wider than 25 are ignored."""
    groups = F.regexp_extract_all(_col(text), F.lit(r"\[([0-9,\-\s]+)\]"), F.lit(1))
    ranges = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+\s*-\s*\d+"), F.lit(0))))
    bounds = F.transform(ranges, lambda r: F.transform(F.split(r, r"\s*-\s*"), lambda n: n.try_cast("bigint")))
    spans = F.filter(bounds, lambda b: F.abs(b[0] - b[1]) <= 25)
    from_ranges = F.flatten(F.transform(spans, lambda b: F.sequence(F.least(b[0], b[1]), F.greatest(b[0], b[1]))))
    bare = F.transform(groups, lambda g: F.regexp_replace(g, r"\d+\s*-\s*\d+", ""))
    singles = F.flatten(F.transform(bare, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0))))
    numbers = F.concat(from_ranges, F.transform(singles, lambda n: n.try_cast("bigint")))
    return F.array_sort(F.array_distinct(numbers))


def reference_blocks(review: Column | str) -> Column:
    """``array<struct(n, block)>`` of a numbered bibliography, in text order."""
    pattern = r"(?s)(?:^|\n)\s*\[(\d+)\]\s*(.*?)(?=(?:\n\s*\[\d+\])|\z)"
    review = _col(review)
    numbers = F.regexp_extract_all(review, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(review, F.lit(pattern), F.lit(2))
    return F.transform(
        F.arrays_zip(numbers.alias("n"), bodies.alias("b")),
        lambda z: F.struct(z["n"].try_cast("bigint").alias("n"), strip(z["b"]).alias("block")),
    )


def text_arxiv_ids(text: Column | str) -> Column:
    ids = F.regexp_extract_all(_col(text), F.lit(TEXT_ARXIV), F.lit(1))
    return F.array_distinct(F.transform(ids, lambda i: F.get(F.split(i, "v", 2), F.lit(0))))


def text_dois(text: Column | str, fold: bool = True) -> Column:
    found = F.transform(
        F.regexp_extract_all(_col(text), F.lit(TEXT_DOI), F.lit(0)), lambda d: F.regexp_replace(d, r"[.,;)]+$", "")
    )
    return F.array_distinct(F.transform(found, fold_case) if fold else found)


def markdown_links(text: Column | str) -> Column:
    text = _col(text)
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(1)).alias("label"),
        F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(2)).alias("url"),
    )


# ------------------------------------------------------------------------- URLs


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def arxiv_url_parts(url: Column | str, paths: tuple[str, ...] = ("/pdf/", "/abs/")) -> Column:
    """``struct(base, version)`` when the URL is an arXiv paper page or file, else null."""
    hosts = "|".join(h.replace(".", r"\.") for h in ARXIV_HOSTS)
    pattern = rf"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:{hosts})(?::\d*)?(?:{'|'.join(paths)})([^?#]*)"
    parts = arxiv_parts(F.regexp_replace(F.regexp_extract(_col(url), pattern, 1), r"(?i)\.pdf$", ""))
    return F.when(parts["base"].isNotNull(), parts)


# IPv4 blocks that are not globally reachable (first address, prefix bits).
PRIVATE_IPV4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("240.0.0.0", 4),
)


def _ipv4_value(octets: Column) -> Column:
    return reduce(lambda acc, i: acc * 256 + octets[i].try_cast("bigint"), range(4), F.lit(0).cast("bigint"))


def is_public_url(url: Column | str) -> Column:
    """http(s), a host, no credentials, not localhost, no non-global literal address.

    Host names are not resolved. Literal IPv6 hosts count as public only inside
    2000::/3 and outside the documentation block.
    """
    url = _col(url)
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = url_host(url)
    user = F.coalesce(F.try_parse_url(url, F.lit("USERINFO")), F.lit(""))
    literal = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    octets = F.split(host, r"\.")
    value = F.when(literal, _ipv4_value(octets))
    private = reduce(
        lambda a, b: a | b,
        [
            value.between(_network(first), _network(first) + 2 ** (32 - bits) - 1)
            for first, bits in PRIVATE_IPV4
        ],
    )
    v6 = host.startswith("[")
    v6_global = host.rlike(r"^\[[23][0-9a-f]{3}:") & ~host.startswith("[2001:db8:")
    return F.coalesce(
        scheme.isin("http", "https")
        & (F.coalesce(host, F.lit("")) != "")
        & (user == "")
        & (host != "localhost")
        & ~host.endswith(".localhost")
        & F.when(literal, ~private).when(v6, v6_global).otherwise(F.lit(True)),
        F.lit(False),
    )


def _network(address: str) -> int:
    a, b, c, d = (int(x) for x in address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def error_class(message: Column | str) -> Column:
    """Failure type named by a provider error message; the order of the tests matters."""
    m = _col(message)

    def has(*parts: str) -> Column:
        return reduce(lambda a, b: a | b, [m.contains(p) for p in parts])

    # Marks in the messages and the types they stand for.
    return (
        F.when(has("HTTP 429"), "RATE_LIMIT")
        .when(has("HTTP 500", "HTTP 502", "HTTP 503", "HTTP 504"), "HTTP_5XX")
        .when(has("Timeout", "URLError"), "TIMEOUT")
        .when(has("JSONDecodeError", "ParseError"), "MALFORMED_RESPONSE")
        .when(has("HTTP 401", "HTTP 403"), "AUTH")
        .otherwise("OTHER")
    )
