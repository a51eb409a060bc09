"""Fill-in-the-middle: rearranged texts for training on infilling, and the way back.

A text is cut into units, runs of ASCII letters or single other characters. Hashes of
the document id choose two cuts and a form. Units are counted and found in the UTF-8
bytes viewed as 64-bit words: the bytes that end a unit are marked arithmetically,
eight at a time; a population count per word gives ranks; a place is found by a search
over the cumulative counts and then within its word. Nothing is shuffled.

Forms, with ``<P>``, ``<S>`` and ``<M>`` as marks:

- ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
- ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
- ``plain``: the text as it is, for empty texts, texts that hold a mark already, and a
  share of the others

A null text reads as empty, a null id as an empty string; repeated rows give repeated
rows. Only the id and the text are read, so other columns cannot clash. Memory follows
the block of a few MB, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import textkernel as tk

SEED = 1
PLAIN_PERCENT, SPM_PERCENT = 10, 20
MARKS = "<[PSM]>"

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_CASE = _ONES * np.uint64(0x20)
_FROM_A, _PAST_Z = _ONES * np.uint64(0x80 - 0x61), _ONES * np.uint64(0x80 - 0x7B)


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, with at least one zero word at the end."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def _next_byte(marks: np.ndarray) -> np.ndarray:
    """For every byte the mark of the byte after it."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


def mark_characters(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a character."""
    return (~words | words << np.uint64(1)) & _HIGH


def mark_unit_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that ends a run of letters or another character."""
    folded = words & ~_HIGH | _CASE
    letter = (folded + _FROM_A) & ~(folded + _PAST_Z) & ~words & _HIGH
    begins = mark_characters(words)
    return letter & ~_next_byte(letter) | ~letter & _next_byte(begins)


class Marked:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marks stand before each byte place."""
        word = at >> 3
        below = (np.uint64(1) << ((at & 7) << 3).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th mark, counted from one."""
        word = np.searchsorted(self.before, k) - 1
        upto = (self.marks[word] >> np.uint64(7)) * _ONES  # byte i: marks in bytes 0 to i of the word
        reached = (upto | _HIGH) - (k - self.before[word]).astype(np.uint64) * _ONES
        return (word << 3) + np.bitwise_count(~reached & _HIGH)


def _hashes(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers for each id."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def _strings(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.StringArray.from_buffers(len(parts), pa.py_buffer(offsets), pa.py_buffer(b"".join(parts)))


def _rearrange(batch: pa.RecordBatch, seed: int) -> list[pa.Array]:
    data, offsets = tk.text_bytes(batch.column(1))
    start, end = offsets[:-1], offsets[1:]
    words = as_words(data)
    units, chars = mark_unit_ends(words), mark_characters(words)
    units.view(np.uint8)[end[end > start] - 1] |= 0x80  # a text's last byte ends a unit whatever follows it
    units.view(np.uint8)[len(data) :] = 0
    units, chars = Marked(units), Marked(chars)
    first = units.rank(start)
    n = units.rank(end) - first
    h1, h2, h3, h4 = _hashes(batch.column(0).to_pylist(), seed).T
    cuts = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
    places = np.repeat(start[None], 2, axis=0)
    inner = cuts > 0
    places[inner] = units.select((first + cuts)[inner]) + 1
    to, frm = places
    marked = pc.match_substring_regex(pc.fill_null(batch.column(1), ""), MARKS).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h3 % 100 >= 100 - PLAIN_PERCENT)
    spm = ~plain & (h4 % 100 < SPM_PERCENT)
    raw = data.tobytes()
    out = []
    for a, b, c, e, whole, turned in zip(*(x.tolist() for x in (start, to, frm, end, plain, spm)), strict=True):
        if whole:
            out.append(raw[a:e])
        elif turned:
            out.append(b"<S>%b<P>%b<M>%b" % (raw[c:e], raw[a:b], raw[b:c]))
        else:
            out.append(b"<P>%b<S>%b<M>%b" % (raw[a:b], raw[c:e], raw[b:c]))
    at = chars.rank(start), chars.rank(to), chars.rank(frm)
    return [
        batch.column(0),
        pa.array(n, pa.int64()),
        pa.array(np.select([plain, spm], ["plain", "spm"], "psm")),
        pa.array(at[1] - at[0], pa.int64(), mask=plain),
        pa.array(at[2] - at[1], pa.int64(), mask=plain),
        _strings(out),
    ]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Per row: id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``."""
    schema = StructType(
        [
            StructField(doc_id, docs.schema[doc_id].dataType),
            StructField("n", LongType()),
            StructField("form", StringType()),
            StructField("prefix_chars", LongType()),
            StructField("middle_chars", LongType()),
            StructField("output", StringType()),
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays(_rearrange(batch, seed), names=schema.names)

    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(rows, schema)


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text from ``output`` and ``form`` alone; each mark stands once in a form that is not plain."""
    part = F.split(output, MARKS, -1)
    at = lambda i: F.get(part, F.lit(i))
    return (
        F.when(form == "psm", F.concat(at(1), at(3), at(2)))
        .when(form == "spm", F.concat(at(2), at(3), at(1)))
        .otherwise(output)
    )
