"""Exact removal of long repeated byte strings with suffix arrays by induced sorting.

Every string of ``WINDOW`` bytes that starts in two or more places goes. The corpus is
cut so that equal windows meet in one shard and hardly anything else does:

1. In each window the 32-byte gram with the smallest hash (the last of equals) is its
   anchor. Windows with the same anchor whose offset from it lies in the same bucket of
   ``BUCKET`` offsets share a core of ``WINDOW - BUCKET + 1`` bytes. Equal windows have
   equal anchors, offsets and cores, so the core's hash is the shard key. A first scan
   emits core and content hashes of these pieces, one row for each.
2. Cores that stand in one place only cannot hold a repeated window. Of the others,
   equal pieces count as one with a multiplicity. A piece alone in its core is repeated
   whole; where pieces differ, the documents that hold representatives yield their bytes.
3. Pieces are dealt by core into shards. Each shard gets a suffix array (suffix types,
   leftmost-smaller substrings named and sorted recursively, the rest induced from
   bucket ends and heads), and from it permuted common prefixes: only the irreducible
   ones are compared, the rest follow by subtraction. A window is repeated if the common
   prefix with a neighbour reaches ``WINDOW`` or if its piece stands in several places.
4. Cores with more than ``HOT`` different pieces would make a group unbounded; their
   windows are counted by a group-by with partial sums instead, which is exact too.
5. Repeated ranges go back to the places of the pieces, are merged per document, and
   the texts are cut.

Documents are told apart by id and text hash, so repeated rows count as two places and
get equal results. Pieces count as equal if the 64-bit hashes of both core and whole agree. Defined cases: a null or empty text has no bytes and the hash
of the empty string; equal or null ids are separate documents; an empty table has no
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from priorlens.session import cut_lineage, release

from . import textkernel as tk

WINDOW, GRAM, BUCKET, HOT = 400, 32, 185, 5_000
SPAN = WINDOW - GRAM + 1  # grams in a window
SHARD_BYTES = 2 << 20
SCAN_BYTES = 1 << 20
_PLACE = np.uint64(0xFFFFFFF)


# --- shards -----------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one row, and the place of each one's anchor."""
    n = len(data) - GRAM + 1
    if n < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums = tk.prefix(data)
    at = np.arange(n)
    grams = tk.span_hash(sums, at, at + GRAM)
    # the hash above, the place below: the smallest pair is the last of the smallest hashes
    rank = (grams & ~_PLACE) | (_PLACE - (at.astype(np.uint64) & _PLACE))
    size = -(-n // SPAN) * SPAN
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = rank
    grid = padded.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - SPAN + 1)
    best = np.minimum(behind[starts], ahead[starts + SPAN - 1])
    ends = offsets[np.searchsorted(offsets, starts, side="right")] if len(starts) else starts
    inside = starts + WINDOW <= ends
    starts = starts[inside]
    place = (_PLACE - (best[inside] & _PLACE)).astype(np.int64)
    return starts, starts + ((place - starts) & int(_PLACE))


def pieces(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor and one bucket: first window, count, and hashes."""
    starts, anchor = anchors(data, offsets)
    if not len(starts):
        return {k: np.empty(0, np.int64) for k in ("start", "windows", "core", "body")}
    bucket = (anchor - starts) // BUCKET
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (bucket[1:] != bucket[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first = starts[fresh]
    count = np.diff(np.concatenate([fresh, [len(starts)]]))
    core_at = anchor[fresh] - BUCKET * bucket[fresh]
    sums = tk.prefix(data)
    core = tk.span_hash(sums, core_at, core_at + WINDOW - BUCKET + 1) ^ tk.mix(bucket[fresh].astype(np.uint64) + np.uint64(1))
    body = tk.span_hash(sums, first, first + count + WINDOW - 1)
    return {"start": first, "windows": count, "core": core, "body": body}


# --- suffix arrays ----------------------------------------------------------


def _buckets(text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.bincount(text, minlength=size))
    return ends - np.bincount(text, minlength=size), ends


def _induce(text: np.ndarray, size: int, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix order from the order of the leftmost-smaller suffixes, a whole bucket at a time."""
    n = len(text)
    order = np.full(n, -1, np.int64)
    heads, ends = _buckets(text, size)
    tails = ends.copy()
    letters = text[lms]
    # leftmost-smaller suffixes at their buckets' ends, in order
    counts = np.bincount(letters, minlength=size)
    place = np.argsort(letters, kind="stable")
    order[tk.expand(ends - counts, counts)] = lms[place]
    used = np.flatnonzero(ends > heads)
    fill = heads.copy()

    def push(found: np.ndarray, larger: bool) -> None:
        """Predecessors of ``found`` of the wanted type, appended to their buckets."""
        before = found[found > 0] - 1
        before = before[~is_s[before]] if larger else before[is_s[before]]
        if not len(before):
            return
        where = text[before]
        by = np.argsort(where, kind="stable")
        before, where = before[by], where[by]
        group = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        runs = np.diff(np.concatenate([group, [len(where)]]))
        nth = np.arange(len(where)) - np.repeat(group, runs)
        if larger:
            order[fill[where] + nth] = before
            fill[where[group]] += runs
        else:
            order[tails[where] - 1 - nth] = before
            tails[where[group]] -= runs

    for c in used:  # larger-type suffixes, upwards
        done = heads[c]
        while done < fill[c]:  # a bucket feeds itself along runs of one letter
            to = fill[c]
            push(order[done:to], True)
            done = to
        mine = order[ends[c] - counts[c] : ends[c]]
        if counts[c]:
            push(mine, True)
    tails = ends.copy()
    for c in used[::-1]:  # smaller-type suffixes, downwards
        done = ends[c]
        while done > tails[c]:
            to = tails[c]
            push(order[to:done][::-1], False)
            done = to
        push(order[heads[c] : fill[c]][::-1], False)
    return order


def suffix_order(text: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of a sequence of small integers whose last value, 0, stands nowhere else.

    Buckets are induced whole, which pays while they are long; once the alphabet of the
    names has outgrown the sequence, ranks are doubled instead.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    if size * 16 > n:
        return _doubled(text)
    # types: smaller if the next different letter is larger
    differ = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.searchsorted(differ, np.arange(n - 1))
    nxt = np.minimum(nxt, len(differ) - 1)
    is_s = np.ones(n, bool)
    is_s[:-1] = text[differ[nxt] + 1] > text[differ[nxt]]
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    rough = _induce(text, size, is_s, lms)
    ranked = rough[_marked(n, lms)[rough]]
    names = _name(text, lms, ranked)
    short = names[lms]
    if short.max() + 1 < len(lms):
        lms_order = lms[suffix_order(short, int(short.max()) + 1)]
    else:
        lms_order = ranked
    return _induce(text, size, is_s, lms_order)


def _marked(n: int, places: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def _name(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings in their order; equal substrings share one."""
    n = len(text)
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    sums = tk.prefix(text)
    hashes = tk.span_hash(sums, ranked, ranked + length[ranked])
    new = np.concatenate([[0], np.cumsum(hashes[1:] != hashes[:-1])])
    names = np.full(n, -1, np.int64)
    names[ranked] = new
    return names


def _doubled(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling of ranks, for sequences with a large alphabet."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(text[order][1:] != text[order][:-1])])
    step = 1
    while rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        step *= 2
    return order


def long_common(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Which suffixes share ``least`` letters with the one before or after them in the order.

    The common prefix with the predecessor is permuted to text order. There it falls by
    one from each place to the next, except at irreducible places, whose letter before
    differs from their predecessor's; only these are compared, four letters at a time.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    has = phi >= 0
    here = np.arange(n)
    fresh = np.ones(n, bool)
    follows = (here > 0) & (phi > 0)
    fresh[follows] = text[here[follows] - 1] != text[phi[follows] - 1]
    start = np.flatnonzero(fresh & has)
    length = np.zeros(len(start), np.int64)
    wide = np.zeros(n, np.uint64)  # four letters at once
    for k in range(min(4, n)):
        wide[: n - k] |= text[k:].astype(np.uint64) << np.uint64(16 * k)
    live = np.arange(len(start))
    while len(live):
        a, b = start[live] + length[live], phi[start[live]] + length[live]
        whole = (a + 4 <= n) & (b + 4 <= n)
        same = np.zeros(len(live), bool)
        same[whole] = wide[a[whole]] == wide[b[whole]]
        length[live[same]] += 4
        rest = live[~same]
        a, b = a[~same], b[~same]
        for _ in range(4):
            ok = (a < n) & (b < n)
            ok[ok] = text[a[ok]] == text[b[ok]]
            rest, a, b = rest[ok], a[ok] + 1, b[ok] + 1
            length[rest] += 1
            if not len(rest):
                break
        live = live[same]
    plcp = np.zeros(n, np.int64)
    seed = np.flatnonzero(fresh)
    value = np.zeros(n, np.int64)
    value[start] = length
    last = seed[np.searchsorted(seed, here, side="right") - 1]
    plcp = np.maximum(value[last] - (here - last), 0)
    plcp[~has] = 0
    enough = plcp >= least
    out = enough.copy()
    out[phi[enough]] = True
    return out


def repeated_windows(bodies: list[bytes], times: list[int]) -> list[np.ndarray]:
    """For each piece, which of its windows stand twice or more among all pieces."""
    joined = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # separators are letters of their own, so no suffix reads across them in the order
    text = np.zeros(len(joined) + len(bodies) + 1, np.int64)
    letters, dense = np.unique(joined, return_inverse=True)
    text[np.arange(len(joined)) + np.repeat(np.arange(len(bodies)), sizes)] = dense + 2
    text[ends + np.arange(len(bodies))] = 1
    text[-1] = 0
    shared = long_common(text, suffix_order(text, len(letters) + 2), WINDOW)
    out = []
    for k, (a, size, n) in enumerate(zip((begins + np.arange(len(bodies))).tolist(), sizes.tolist(), times, strict=True)):
        windows = shared[a : a + size - WINDOW + 1]
        out.append(np.ones(len(windows), bool) if n > 1 else windows)
    return out


def _ranges(windows: np.ndarray) -> list[dict[str, int]]:
    """Byte ranges, from the piece's start, that the flagged windows cover."""
    edge = np.diff(np.concatenate([[0], windows.astype(np.int8), [0]]))
    spans: list[dict[str, int]] = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if spans and a <= spans[-1]["b"]:
            spans[-1]["b"] = b + WINDOW - 1
        else:
            spans.append({"a": a, "b": b + WINDOW - 1})
    return spans


# --- Spark ------------------------------------------------------------------

_RANGES = "array<struct<a:int,b:int>>"


def _scan(source: DataFrame) -> DataFrame:
    """One row for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text", SCAN_BYTES):
            data, offsets = tk.text_bytes(block.column("text"))
            found = pieces(data, offsets)
            row = np.searchsorted(offsets, found["start"], side="right") - 1
            yield pa.RecordBatch.from_pydict({
                "core": pa.array(found["core"].view(np.int64)), "body": pa.array(found["body"].view(np.int64)),
                "key": block.column("key").take(pa.array(row)), "key2": block.column("key2").take(pa.array(row)),
                "start": pa.array(found["start"] - offsets[row]), "windows": pa.array(found["windows"].astype(np.int32)),
            })

    return source.mapInArrow(run, "core long, body long, key long, key2 int, start long, windows int")


def _cut(source: DataFrame, wanted: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows made from the bytes of the wanted pieces; each document's text is read once."""
    item = F.struct("start", "windows", "core", "body", "n")
    listed = wanted.groupBy("key", "key2").agg(F.collect_list(item).alias("items"))
    once = source.join(listed, ["key", "key2"]).select("text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text", SCAN_BYTES):
            data, offsets = tk.text_bytes(block.column("text"))
            raw = data.tobytes()
            items = block.column("items")
            flat = items.flatten()
            at = np.repeat(offsets[:-1], np.diff(np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])))
            start = flat.field("start").to_numpy() + at
            size = flat.field("windows").to_numpy() + WINDOW - 1
            yield rows_of(flat, [raw[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)])

    return once.mapInArrow(run, schema)


def _with_bytes(flat: pa.StructArray, bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"core": flat.field("core"), "body": flat.field("body"), "n": flat.field("n"), "bytes": pa.array(bodies, pa.binary())})


def _with_windows(flat: pa.StructArray, bodies: list[bytes]) -> pa.RecordBatch:
    """A row with two 64-bit hashes for every window of each piece."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    windows = flat.field("windows").to_numpy().astype(np.int64)
    begins = np.cumsum(windows + WINDOW - 1) - (windows + WINDOW - 1)
    at = tk.expand(begins, windows)
    one = tk.span_hash(tk.prefix(data), at, at + WINDOW)
    two = tk.span_hash(tk.prefix(tk.mix(data.astype(np.uint64) + np.uint64(0x5851F42D))), at, at + WINDOW)
    owner = pa.array(np.repeat(np.arange(len(windows)), windows))
    return pa.RecordBatch.from_pydict({
        "core": flat.field("core").take(owner), "body": flat.field("body").take(owner), "n": flat.field("n").take(owner),
        "i": pa.array((at - np.repeat(begins, windows)).astype(np.int32)), "w1": pa.array(one.view(np.int64)), "w2": pa.array(two.view(np.int64)),
    })


def _by_suffix_arrays(bytes_: DataFrame) -> DataFrame:
    """Repeated ranges of pieces, shard by shard."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["core", "body"])
        flags = repeated_windows(frame["bytes"].tolist(), frame["n"].tolist())
        return pd.DataFrame({"core": frame["core"], "body": frame["body"], "ranges": [_ranges(f) for f in flags]})

    return bytes_.groupBy("shard").applyInPandas(run, f"core long, body long, ranges {_RANGES}")


def _by_window_counts(windows: DataFrame) -> DataFrame:
    """The same for pieces of hot cores: windows are counted, nothing is gathered by core."""
    often = windows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1")
    flagged = windows.join(often, ["w1", "w2"]).groupBy("core", "body").agg(F.collect_list("i").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            ranges = []
            for at in batch.column("at").to_pylist():
                flags = np.zeros(max(at) + 1, bool)
                flags[at] = True
                ranges.append(_ranges(flags))
            yield pa.RecordBatch.from_pydict({"core": batch.column("core"), "body": batch.column("body"), "ranges": pa.array(ranges, kind)})

    return flagged.mapInArrow(run, f"core long, body long, ranges {_RANGES}")


def repeated_ranges(source: DataFrame) -> DataFrame:
    """``(key, key2, spans)``: the byte ranges of each document that repeated windows cover."""
    scanned = cut_lineage(_scan(source))
    shared = cut_lineage(scanned.groupBy("core").agg(F.count("*").alias("places")).where("places > 1").select("core"))  # stored, so that the join may split a hot core
    kept = cut_lineage(scanned.join(shared, "core", "left_semi"))
    release(scanned)
    rep = F.min(F.struct("key", "key2", "start", "windows")).alias("rep")
    alike = cut_lineage(kept.groupBy("core", "body").agg(F.count("*").alias("n"), rep).select("core", "body", "n", "rep.*"))
    variants = cut_lineage(alike.groupBy("core").agg(F.count("*").alias("variants")))
    alike = alike.join(variants, "core")
    whole = alike.where("variants = 1").select("core", "body", F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") + (WINDOW - 1)).alias("b"))).alias("ranges"))
    mixed, hot = alike.where((F.col("variants") > 1) & (F.col("variants") <= HOT)), alike.where(F.col("variants") > HOT)
    total = mixed.agg(F.coalesce(F.sum(F.col("windows") + (WINDOW - 1)), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    bytes_ = _cut(source, mixed, "core long, body long, n long, bytes binary", _with_bytes).withColumn("shard", F.pmod(F.xxhash64("core"), F.lit(shards)))
    found = cut_lineage(_by_suffix_arrays(bytes_)) if total else None
    parts = [whole] if found is None else [whole, found]
    if not hot.isEmpty():
        parts.append(cut_lineage(_by_window_counts(_cut(source, hot, "core long, body long, n long, i int, w1 long, w2 long", _with_windows))))
    ranges = parts[0]
    for more in parts[1:]:
        ranges = ranges.unionByName(more)
    spans = kept.join(ranges, ["core", "body"]).select("key", "key2", F.explode(F.transform("ranges", lambda r: F.struct((F.col("start") + r.a).alias("a"), (F.col("start") + r.b).alias("b")))).alias("span"))
    return spans.groupBy("key", "key2").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, removed bytes and runs, and the hash of what stays."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    source = named.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.hash("text", "doc_id").alias("key2"))
    spans = cut_lineage(repeated_ranges(source.drop("doc_id")))
    joined = source.join(spans, ["key", "key2"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, found in zip(block.column("text").to_pylist(), block.column("spans").to_pylist(), strict=True):
                raw, digest, at, removed, runs, last = text.encode(), hashlib.sha256(), 0, 0, 0, -1
                for a, b in sorted((s["a"], s["b"]) for s in found or ()):
                    if a > last:
                        runs += 1
                        digest.update(raw[at:a])
                    removed += max(0, b - max(a, at))
                    at = last = max(last, b)
                digest.update(raw[at:])
                for k, v in zip(out, (len(raw), removed, runs, digest.hexdigest()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id")} | out)

    kind = named.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
