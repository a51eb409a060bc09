"""Secret scans: fixed patterns, and password guess cost in credential contexts.

Three fixed patterns give the base spans. Besides, values that stand in a wider
credential context (``CONTEXT``) are priced by the guess-cost dynamic programme of
``guesscost``; a value that needs ``10 ** STRONG`` guesses or more becomes a span of
kind ``guess`` unless a base span covers it whole. Its words are the fixed list and,
ranked by their count, the letter runs that stand in ``LEAST_VALUES`` or more different
values of all documents; a value counts once, however many copies there are of it.

Defined cases: a null or empty text has no spans; positions count code points and
ends are exclusive; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .guesscost import lexicon, log_guesses

STRONG, LEAST_VALUES, LEAST_VALUE = 8.0, 3, 6
REDACTED = "[SECRET]"

# The base patterns.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?ai)(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|secret|auth|client)[_-]?(?:key|token|secret)|credentials?|auth(?:orization)?)"""
    r"""["']?\x20{0,4}[:=]\x20{0,4}(?:bearer\x20+|basic\x20+)?["']?([!-~]+)"""
)
_EDGE = "\"'`,;.()[]{}<>"
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[ord(":"), ord("=")]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_CAPS = np.zeros(256, bool)
_CAPS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True

DIGEST = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _suspects(block: pa.RecordBatch, text: str) -> np.ndarray:
    """Rows that can hold a span at all: a separator, or a long enough run of hex digits or capitals."""
    data, offsets = tk.text_bytes(block.column(text))
    found = tk.per_row(_TRIGGER[data], offsets) > 0
    for table, least in ((_HEX, LEAST["hex"]), (_CAPS, LEAST["access"])):
        starts, ends, _ = tk.runs(table[data], offsets)
        found[np.searchsorted(offsets, starts[ends - starts >= least], side="right") - 1] = True
    return np.flatnonzero(found)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns as (start, end, kind)."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def context_values(text: str) -> list[tuple[int, int]]:
    """Values in credential contexts, without the punctuation around them."""
    out = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        if b - a >= LEAST_VALUE:
            out.append((a, b))
    return out


def all_spans(text: str, words: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and these with the values that are costly to guess."""
    base = base_spans(text)
    added = [
        (a, b, "guess") for a, b in context_values(text)
        if not any(x <= a and b <= y for x, y, _ in base) and log_guesses(text[a:b], words) >= STRONG
    ]
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


def value_words(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """The letter runs that recur in different credential values of all documents, with the number of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            seen: set[tuple[str, str]] = set()
            column = block.column("text")
            for i in _suspects(block, "text").tolist():
                text = column[i].as_py()
                for a, b in context_values(text):
                    value = text[a:b].lower()
                    digest = hashlib.blake2b(value.encode(), digest_size=16).hexdigest()
                    seen.update((word, digest) for word in re.findall("[a-z]{3,24}", value))
            pairs = sorted(seen)
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in pairs], pa.string()), "value": pa.array([v for _, v in pairs], pa.string())})

    pairs = docs.selectExpr(f"`{text_col}` as text").mapInArrow(run, "word string, value string").distinct()
    counted = pairs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_VALUES)
    return {r["word"]: r["n"] for r in counted.collect()}


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans."""
    source = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    words = lexicon(value_words(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            n = block.num_rows
            counts = {k: [0] * n for k in KINDS[:3]}
            digest, listed = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
            column = block.column("text")
            for i in _suspects(block, "text").tolist():
                base, spans = all_spans(column[i].as_py(), words)
                for _, _, kind in base:
                    counts[kind][i] += 1
                digest[i], listed[i] = hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": block.column("doc_id")} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
                | {"base_sha256": pa.array(digest, pa.string()), "spans": pa.array(listed, pa.string())}
            )

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {DIGEST}")


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by a mark; every row and column stays."""
    words = lexicon(value_words(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, text_col):
            column, new = block.column(text_col), {}
            for i in _suspects(block, text_col).tolist():
                text = column[i].as_py()
                out, at = [], 0
                for a, b, _ in all_spans(text, words)[1]:
                    if b <= at:
                        continue
                    out += [text[at:a], REDACTED] if a >= at else []
                    at = b
                if at:
                    new[i] = "".join([*out, text[at:]])
            yield tk.rewritten(block, text_col, chars_col, new)

    return docs.mapInArrow(run, docs.schema)
