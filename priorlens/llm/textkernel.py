"""Array helpers that the text operators share.

Texts stay in the Arrow buffers they arrive in: one UTF-8 byte array and the
offsets of the rows. A null text reads as an empty one. Work goes through blocks
of a few MB, so memory depends on the block (or on one very long text) only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 2 * len(_powers[i]), (1 << 20) + 64), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span_hash`` reads any span from them."""
    power, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    terms = values.astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[: len(values)]
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal content wherever it stands."""
    _, inverse = powers(len(sums))
    h = sums[end] - sums[start]
    h *= inverse[start]
    h += (end - start).astype(np.uint64) * _M2
    return mix(h)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross rows: starts, ends, and for each row the index of its first run."""
    n = len(inside)
    edge = np.zeros(n + 1, np.int8)
    edge[:n] = inside
    edge[1:] -= inside
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def per_row(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` over the rows that ``offsets`` delimit."""
    sums = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` elements lie in any of the spans."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(start, start + count)``."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before, counts) + np.repeat(starts, counts)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less the byte spans, which fall on character borders."""
    raw, at, kept = text.encode(), 0, []
    for start, end in spans:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]]).decode()


def rewritten(batch: pa.RecordBatch, text: str, chars: str, new: dict[int, str]) -> pa.RecordBatch:
    """The batch with other texts in some rows, and their character counts if it has such a column."""
    if not new:
        return batch
    names, columns = batch.schema.names, list(batch.columns)
    texts = columns[names.index(text)].to_pylist()
    for i, value in new.items():
        texts[i] = value
    columns[names.index(text)] = pa.array(texts, batch.schema.field(text).type)
    if chars in names:
        counts = columns[names.index(chars)].to_pylist()
        for i, value in new.items():
            counts[i] = len(value)
        columns[names.index(chars)] = pa.array(counts, batch.schema.field(chars).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
