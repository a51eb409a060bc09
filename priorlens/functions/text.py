"""Text keys: width folding, title keys, text of HTML."""

from __future__ import annotations

import json
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Compatibility forms folded without a UDF: full-width ASCII and the
# ideographic space. ``exact=True`` switches to full NFKC through Arrow.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\u00a0"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "

WORD_CLASS = r"[^\p{L}\p{N}_]+"
# Characters that count as white space at the ends of a string.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfkc_exact(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def compat(c: Column | str, exact: bool = False) -> Column:
    """Compatibility-fold a string (full-width forms by default, NFKC when exact)."""
    c = _col(c).cast("string")
    return _nfkc_exact(c) if exact else F.translate(c, _WIDE, _NARROW)


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def fold_case(c: Column | str) -> Column:
    """Lower-case with the one casefold expansion that occurs in prose (sharp s)."""
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), r"[\s\p{Z}]+", " ")


def title_key(c: Column | str, exact: bool = False) -> Column:
    """Matching key of a title; null becomes the empty string."""
    folded = fold_case(compat(F.coalesce(_col(c).cast("string"), F.lit("")), exact))
    return F.trim(F.regexp_replace(folded, WORD_CLASS, " "))


def ascii_title_key(c: Column | str) -> Column:
    """Title key of the named-prior study: ASCII words only, review banner removed."""
    lowered = fold_case(F.coalesce(_col(c).cast("string"), F.lit("")))
    # Fixed value: the banner of papers under review.
    bare = F.regexp_replace(lowered, r"under review as a conference paper at \S+ \d{4}", "")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def word_count(key: Column) -> Column:
    return F.when(key == "", F.lit(0)).otherwise(F.size(F.split(key, " ")))


# ---------------------------------------------------------------- HTML to text

# Elements whose bodies never reach the reader.
HIDDEN_ELEMENTS = ("script", "style", "noscript", "svg")

# Names of character references with and without their semicolon, from the standard table.
_NAMED = json.dumps({name[:-1]: char for name, char in html5.items() if name.endswith(";")})
_BARE = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True))
# What numeric references 128 to 159 stand for: the characters of code page 1252, or themselves.
_CONTROLS = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(128, 160))


def _character(code: Column) -> Column:
    """The character of a numeric reference."""
    point = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    lost = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(lost, "\ufffd").when(code.between(128, 159), F.substring(F.lit(_CONTROLS), (code - 127).cast("int"), 1)).otherwise(point)


def _reference(part: Column) -> Column:
    """What follows an ampersand, with the reference it may begin with expanded."""
    decimal = F.regexp_extract(part, r"^#([0-9]{1,9})", 1)
    digits = F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,7})", 1)
    code = F.coalesce(F.when(decimal != "", decimal).try_cast("bigint"), F.when(digits != "", F.conv(digits, 16, 10)).try_cast("bigint"))
    number = F.regexp_extract(part, r"^(#(?:[0-9]{1,9}|[xX][0-9a-fA-F]{1,7});?)", 1)
    closed, bare = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*);", 1), F.regexp_extract(part, f"^({_BARE})", 1)
    named = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), F.coalesce(closed, F.lit("")))

    def rest(taken: Column) -> Column:
        return F.substring(part, F.char_length(taken) + F.lit(1), F.char_length(part))

    return (
        F.when(code.isNotNull(), F.concat(_character(code), rest(number)))
        .when((closed != "") & named.isNotNull(), F.concat(named, F.substring(part, F.char_length(closed) + F.lit(2), F.char_length(part))))
        .when(bare != "", F.concat(F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), bare), rest(bare)))
        .otherwise(F.concat(F.lit("&"), part))
    )


def unescape(c: Column) -> Column:
    """All named and numeric character references expanded, once."""
    parts = F.split(c, "&")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), _reference)
    return F.when(c.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))).otherwise(c)


def drop_blank_lines(c: Column) -> Column:
    lines = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.array_join(F.filter(lines, lambda line: strip(line) != ""), "\n")


# Elements whose body is raw text up to their own end tag; the other hidden ones nest.
_RAW = [e for e in HIDDEN_ELEMENTS if e in ("script", "style")]
_NESTING = "|".join(e for e in HIDDEN_ELEMENTS if e not in _RAW)


def _outside_nested(c: Column) -> Column:
    """The page without what stands inside nesting hidden elements, closed or not."""
    pieces = F.split(c, rf"(?i)(?=</?(?:{_NESTING})\b)")

    def step(state: Column, piece: Column) -> Column:
        opens = piece.rlike(rf"(?is)^<(?:{_NESTING})\b") & ~piece.rlike(r"(?s)^<[^>]*/>")
        closes = piece.rlike(rf"(?is)^</(?:{_NESTING})\b")
        depth = F.greatest(state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), F.lit(0))
        shown = F.when(depth == 0, piece).otherwise("\u0001")
        return F.struct(depth.alias("depth"), F.concat(state["shown"], shown).alias("shown"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("shown"))
    return F.when(c.rlike(rf"(?i)<(?:{_NESTING})\b"), F.aggregate(pieces, start, step)["shown"]).otherwise(c)


def html_to_text(c: Column | str) -> Column:
    """Visible text of an HTML page as a JVM expression: nodes joined by blanks, blank lines dropped."""
    c = F.regexp_replace(_col(c), r"(?s)<!--.*?(?:-->|\z)", "\u0001")
    for element in _RAW:
        c = F.regexp_replace(c, rf"(?is)<{element}\b[^>]*>.*?(?:</{element}\s*>|\z)", "\u0001")
    c = F.regexp_replace(_outside_nested(c), r"(?s)<[!/?a-zA-Z][^>]*>", "\u0001")
    c = F.regexp_replace(F.regexp_replace(c, "\u0001+", "\u0001"), "^\u0001|\u0001$", "")
    return drop_blank_lines(unescape(F.replace(c, F.lit("\u0001"), F.lit(" "))))


# ------------------------------------------------------------------- leak lint

# A percentage or two-decimal number near the word "novelty".
NOVELTY_NUMBER = (
    r"(?is)novelty.{0,40}(?:\d+(?:\.\d{2})?\s*%|\b\d+\.\d{2}\b)"
    r"|(?:\d+(?:\.\d{2})?\s*%|\b\d+\.\d{2}\b).{0,40}novelty"
)
# Ranking fields that must not reach a reader.
INTERNAL_FIELDS = ("embedding_score", "similarity_score", "ranking_feature", "bridge_rank", "internal_score")


def visible_markup(c: Column) -> Column:
    """What a reader sees of a marked-up text: style blocks and tags become blanks."""
    c = F.regexp_replace(c, r"(?is)<style\b.*?</style>", " ")
    return unescape(F.regexp_replace(c, r"<[^>]+>", " "))


def leaked_fields(c: Column | str) -> Column:
    """Names of the leak rules a reader-facing text breaks."""
    c = _col(c)
    low = F.lower(c)
    found = [F.when(c.rlike(NOVELTY_NUMBER), F.lit("novelty_number"))]
    found += [F.when(low.contains(name), F.lit(name)) for name in INTERNAL_FIELDS]
    return F.array_compact(F.array(*found))
