"""Benchmark decontamination with an FM-index per training shard.

A shard is what one task reads, cut into index blocks of bounded size. Its text
becomes a sequence over the benchmark's own alphabet: every word of the benchmark
is a symbol, any other word separates, and runs shorter than the shortest window
are left out because no window fits in them. Over that sequence stand a suffix
array (rank doubling), its Burrows-Wheeler transform in a wavelet matrix, and
suffix positions sampled at every ``SAMPLE``-th place and at the start of each run.
All windows are searched backward at once; matching rows walk to the next sampled
suffix, and the spans they cover are merged.

The benchmark is a query set: the driver reads it in blocks of ``ITEMS_PER_BLOCK``
items, each shipped as one broadcast of bounded size and searched in turn, so the
benchmark may be of any size and documents are read once.

Defined cases: a null or empty text has no words and no hits; a null benchmark text
has no window; a null item id is listed as ``null``; item ids that repeat count
once; without documents or benchmark the result is empty or all clean. Columns
other than the two named ones are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk

WINDOW = 10
ITEMS_PER_BLOCK = 4_000
INDEX_WORDS = 4_000_000
SAMPLE = 8

HITS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


def _tokens(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, byte starts and ends within their row, and the offsets of rows in words."""
    data, offsets = tk.text_bytes(batch.column(text))
    low = tk.LOWER[data]
    starts, ends, first = tk.runs(tk.ALNUM[low], offsets)
    hashes = tk.span_hash(tk.prefix(low), starts, ends)
    shift = np.repeat(offsets[:-1], np.diff(first))
    return hashes, starts - shift, ends - shift, first, np.diff(offsets)


class Phrases:
    """Windows of one block of benchmark items, over the block's own alphabet."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        batch = pa.RecordBatch.from_pydict({"t": pa.array([t for _, t in items], pa.string())})
        hashes, _, _, first, _ = _tokens(batch, "t")
        self.alphabet = np.unique(hashes)
        symbols = np.searchsorted(self.alphabet, hashes) + 1
        found: dict[tuple[int, ...], set[str]] = {}
        for (item, _), a, b in zip(items, first[:-1], first[1:], strict=True):
            words = tuple(symbols[a:b].tolist())
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                found.setdefault(words[i : i + WINDOW], set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(w) for w in found}):
            ours = [(w, sorted(x)) for w, x in found.items() if len(w) == n]
            self.by_length[n] = (np.array([w for w, _ in ours]), [x for _, x in ours])
        self.shortest = min(self.by_length, default=0)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the alphabet, 0 for any other."""
        if not len(self.alphabet):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == hashes, at + 1, 0)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence in which every 0 is a separator of its own, smaller than any symbol."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ranked = rank[order]
        new = np.empty(n, np.int64)
        if step == 1:
            fresh = ranked[1:] != ranked[:-1]
        else:
            fresh = (ranked[1:] != ranked[:-1]) | (second[order][1:] != second[order][:-1])
        new[order] = np.concatenate([[0], np.cumsum(fresh)])
        if new[order[-1]] == n - 1:
            return order
        rank = new
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        order = np.argsort(rank * (n + 1) + second + 1, kind="stable")
        step *= 2


class WaveletMatrix:
    """Rank and access over a sequence of small integers, one bit vector per bit."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for b in reversed(range(self.bits)):
            bit = (values >> b) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        start, at = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the positions, and their ranks there."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[at + 1] - ones[at] == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            at = np.where(one, zeros + ones[at], at - ones[at])
            symbol = symbol * 2 + one
        return symbol, at - start


class FMIndex:
    """Backward search and location over runs of symbols that zeros separate; ``text`` ends with one."""

    def __init__(self, text: np.ndarray) -> None:
        order = suffix_array(text)
        last = text[order - 1]
        self.tree = WaveletMatrix(last)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.sampled = (order % SAMPLE == 0) | (last == 0)
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.size = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        top = len(self.below) - 2
        for k in reversed(range(patterns.shape[1])):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = patterns[live, k]
            known = c <= top
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            low[live], high[live] = self.below[c] + self.tree.rank(c, low[live]), self.below[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.before[rows[done]]] + steps
            left, rows, steps = left[~done], rows[~done], steps + 1
            if len(left):
                symbol, rank = self.tree.access(rows)
                rows = self.below[symbol] + rank
        return out


def _search(phrases: Phrases, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words of the shard are hit, and the items found in each row."""
    hit = np.zeros(len(symbols), bool)
    items: dict[int, set[str]] = {}
    starts, ends, _ = tk.runs(symbols > 0, first)
    long_enough = ends - starts >= phrases.shortest
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts) or not phrases.shortest:
        return hit, items
    place = tk.expand(starts, ends - starts + 1)  # one place more per run, for its separator
    cut = np.cumsum(ends - starts + 1) - 1
    text = symbols[np.minimum(place, len(symbols) - 1)]
    text[cut] = 0
    index = FMIndex(text)
    for length, (patterns, names) in phrases.by_length.items():
        low, high = index.search(patterns)
        found = np.flatnonzero(high > low)
        rows = tk.expand(low[found], (high - low)[found])
        at = place[index.locate(rows)]
        hit |= tk.covered(at, length, len(symbols))
        pairs = np.unique(np.stack([np.searchsorted(first, at, side="right") - 1, np.repeat(found, (high - low)[found])]), axis=1)
        for row, window in pairs.T.tolist():
            items.setdefault(row, set()).update(names[window])
    return hit, items


def _merged(starts: np.ndarray, ends: np.ndarray, hit: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int]]]:
    """Byte spans of hit words by row; neighbours join with what stands between them."""
    a, b, runs_at = tk.runs(hit, first)
    spans = list(zip(starts[a].tolist(), ends[np.maximum(b, 1) - 1].tolist(), strict=True))
    return [spans[x:y] for x, y in zip(runs_at[:-1].tolist(), runs_at[1:].tolist(), strict=True)]


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[list[tuple]]:
    """Tokenised blocks, gathered until an index is full."""
    held, size = [], 0
    for block in tk.blocks(batches, text):
        held.append((block, *_tokens(block, text)))
        size += len(held[-1][1])
        if size >= INDEX_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _hits(batches: Iterator[pa.RecordBatch], text: str, shared: list) -> Iterator[tuple[pa.RecordBatch, dict]]:
    for shard in _shards(batches, text):
        hashes = np.concatenate([x[1] for x in shard])
        counts = np.concatenate([np.diff(x[4]) for x in shard])
        first = np.concatenate([[0], np.cumsum(counts)])
        hit = np.zeros(len(hashes), bool)
        items: dict[int, set[str]] = {}
        for block in shared:
            phrases = block.value
            some, more = _search(phrases, phrases.symbols(hashes), first)
            hit |= some
            for row, names in more.items():
                items.setdefault(row, set()).update(names)
        n_hit = tk.per_row(hit, first)
        row = word = 0
        for block, h, starts, ends, at, lengths in shard:
            n = block.num_rows
            names = [",".join(sorted(items.get(row + i, ()))) for i in range(n)]
            yield block, {
                "n_words": np.diff(at), "n_hit": n_hit[row : row + n], "n_items": [len(items.get(row + i, ())) for i in range(n)],
                "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in names], "contaminated": n_hit[row : row + n] > 0,
                "spans": _merged(starts, ends, hit[word : word + len(h)], lengths, at),
            }
            row, word = row + n, word + len(h)


def _benchmark_blocks(benchmark: DataFrame, item: str, text: str) -> list:
    """The query set as broadcasts of at most ``ITEMS_PER_BLOCK`` items each."""
    shared, held = [], []
    rows = benchmark.selectExpr(f"coalesce(cast(`{item}` as string), 'null')", f"coalesce(`{text}`, '')")
    for row in rows.toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == ITEMS_PER_BLOCK:
            shared.append(benchmark.sparkSession.sparkContext.broadcast(Phrases(held)))
            held = []
    if held:
        shared.append(benchmark.sparkSession.sparkContext.broadcast(Phrases(held)))
    return shared


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: words, hit words, items with an occurring window, and the byte spans to remove."""
    shared = _benchmark_blocks(benchmark, item_col, text_col)
    source = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    kind = source.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, out in _hits(batches, "text", shared):
            out["spans"] = pa.array([[{"start": a, "end": b} for a, b in row] for row in out["spans"]], spans)
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id")} | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    return source.mapInArrow(run, f"doc_id {kind}, {HITS}")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str = "n_chars", item_col: str = "item_id") -> DataFrame:
    """The documents with the hit spans cut from their texts; every row and column stays."""
    shared = _benchmark_blocks(benchmark, item_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, out in _hits(batches, text_col, shared):
            yield tk.rewritten(block, text_col, chars_col, {i: tk.without(block.column(text_col)[i].as_py(), spans) for i, spans in enumerate(out["spans"]) if spans})

    return docs.mapInArrow(run, docs.schema)
