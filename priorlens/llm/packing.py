"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Texts become token ids once; what is packed are pieces of at most ``CAPACITY`` tokens.
Full pieces are sequences of their own. The others are dealt into shards of about
``SHARD`` pieces by a hash of their number, so a shard has a bounded size whatever the
keys are. ``ISLANDS`` populations of packings evolve per shard: an offspring takes whole
well-filled bins of one parent into the other, bins with pieces that now stand twice
go, and the displaced pieces are best-fitted again, longest first. Between rounds the
elite of each island moves to the next one. The best packing of a shard stays, and
pieces of bins filled under ``LOOSE`` are packed once more across shards.

Defined cases: a null or empty text is one closing id; equal or null ids are separate
documents; without documents the result is empty; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from priorlens.session import cut_lineage

from . import textkernel as tk
from .subwords import Subwords

CAPACITY, CLOSING = 2048, 0
SHARD, ISLANDS, POPULATION, GENERATIONS, ROUNDS, ELITE = 2_000, 3, 6, 6, 2, 2
LOOSE = 0.9
FULL_IDS = 1 << 62


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Pieces of every document: place, length, checksum and a number of their own."""
    source = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    subwords = Subwords(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId()) << 33
        for block in tk.blocks(batches, "text"):
            ids, offsets = subwords.encode_rows(block.column("text"))
            n = len(offsets) - 1
            length = np.diff(offsets) + 1
            closed = np.full(length.sum(), CLOSING, "<u4")
            closed[np.arange(len(ids)) + np.repeat(np.arange(n), length - 1)] = ids
            parts = -(-length // CAPACITY)
            owner = np.repeat(np.arange(n), parts)
            piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * CAPACITY
            size = np.minimum(CAPACITY, length[owner] - start)
            at = (np.cumsum(length) - length)[owner] + start
            raw = memoryview(closed.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), size.tolist(), strict=True)]
            uid = np.arange(number, number + len(piece))
            number += len(piece)
            yield pa.RecordBatch.from_pydict({
                "doc_id": block.column("doc_id").take(pa.array(owner)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(size),
                "ids_crc32": pa.array(crc, pa.int64()), "uid": pa.array(uid),
            })

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, uid long")


class Bins:
    """A packing: bins as lists of pieces, found by the space they have left."""

    def __init__(self, sizes: list[int]) -> None:
        self.sizes = sizes
        self.bins: dict[int, list[int]] = {}
        self.left: dict[int, int] = {}
        self._by_left: list[list[int]] = [[] for _ in range(CAPACITY + 1)]  # may hold bins that have moved on
        self._open = 0  # bit k: some bin has k tokens left
        self._next = 0

    @classmethod
    def of(cls, sizes: list[int], bin_of: list[int]) -> Bins:
        out = cls(sizes)
        groups: dict[int, list[int]] = {}
        for item, b in enumerate(bin_of):
            groups.setdefault(b, []).append(item)
        for items in groups.values():
            out.add(items)
        return out

    def add(self, items: list[int]) -> None:
        self.bins[self._next] = items
        self._place(self._next, CAPACITY - sum(self.sizes[i] for i in items))
        self._next += 1

    def _place(self, b: int, left: int) -> None:
        self.left[b] = left
        self._by_left[left].append(b)
        self._open |= 1 << left

    def _take(self, size: int) -> int | None:
        """The bin with the least space from ``size`` up, off its stack."""
        while fits := self._open >> size:
            left = size + (fits & -fits).bit_length() - 1
            stack = self._by_left[left]
            while stack:
                b = stack.pop()
                if self.left.get(b) == left:
                    return b
            self._open &= ~(1 << left)
        return None

    def best_fit(self, items: list[int]) -> None:
        """Put pieces, in the order given, where they leave the least space."""
        for item in items:
            size = self.sizes[item]
            b = self._take(size)
            if b is None:
                self.add([item])
            else:
                self.bins[b].append(item)
                self._place(b, self.left[b] - size)

    def fitness(self) -> tuple[int, float]:
        """Bins, then how unevenly they are filled; smaller is better."""
        return len(self.bins), -sum((CAPACITY - x) ** 2 for x in self.left.values())

    def bin_of(self) -> list[int]:
        out = [0] * len(self.sizes)
        for b, items in enumerate(self.bins.values()):
            for i in items:
                out[i] = b
        return out


def crossover(host: Bins, donor: Bins, rng: random.Random) -> Bins:
    """The host with some of the donor's best-filled bins, whole."""
    ranked = sorted(donor.bins, key=lambda b: (donor.left[b], b))
    pool = ranked[: max(1, len(ranked) // 2)]
    taken = [donor.bins[b] for b in rng.sample(pool, max(1, int(len(pool) * rng.uniform(0.2, 0.7))))]
    moved = {i for items in taken for i in items}
    child, displaced = Bins(host.sizes), []
    for items in host.bins.values():
        if moved.isdisjoint(items):
            child.add(list(items))
        else:
            displaced += [i for i in items if i not in moved]
    for items in taken:
        child.add(list(items))
    child.best_fit(sorted(displaced, key=lambda i: (-host.sizes[i], i)))
    return child


def evolve(sizes: list[int], population: list[list[int]], rng: random.Random) -> list[list[int]]:
    """Some generations of one island, best packing first; an empty population is founded anew."""
    living = [Bins.of(sizes, p) for p in population]
    while len(living) < POPULATION:
        noise = 0.0 if not living else rng.uniform(0.02, 0.3)
        founder = Bins(sizes)
        founder.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random())))
        living.append(founder)
    bound = math.ceil(sum(sizes) / CAPACITY)
    scored = sorted(((b.fitness(), k, b) for k, b in enumerate(living)), key=lambda x: x[:2])[:POPULATION]
    serial = len(living)
    for _ in range(GENERATIONS):
        if scored[0][0][0] <= bound:
            break
        young = []
        for _ in range(POPULATION):
            host, donor = rng.sample(scored, 2) if len(scored) > 1 else (scored[0], scored[0])
            child = crossover(host[2], donor[2], rng)
            young.append((child.fitness(), serial, child))
            serial += 1
        scored = sorted([*scored, *young], key=lambda x: x[:2])[:POPULATION]
    return [b.bin_of() for _, _, b in scored]


def _round(state: DataFrame, number: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                sizes = [int(x) for x in row.sizes]
                grown = evolve(sizes, [[int(x) for x in p] for p in row.population], random.Random(f"{row.shard}/{row.island}/{number}"))
                used = max(grown[0]) + 1
                filled = [0] * used
                for size, b in zip(sizes, grown[0], strict=True):
                    filled[b] += size
                out.append((row.shard, row.island, sizes, grown, used, float(-sum(x * x for x in filled))))
            yield pd.DataFrame(out, columns=["shard", "island", "sizes", "population", "used", "cost"])

    schema = "shard long, island int, sizes array<int>, population array<array<int>>, used long, cost double"
    return state.mapInPandas(run, schema)


def _placed(best: DataFrame) -> DataFrame:
    """Every piece with its sequence and its place there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                end: dict[int, int] = {}
                out = []
                for uid, size, b in zip(row.uids, row.sizes, row.packing, strict=True):
                    at = end.get(b, 0)
                    end[b] = at + int(size)
                    out.append((int(uid), (int(row.shard) << 20) + int(b), at))
                done = pd.DataFrame(out, columns=["uid", "sequence_id", "offset"])
                done["filled"] = [end[int(b)] for b in row.packing]
                yield done

    return best.mapInPandas(run, "uid long, sequence_id long, offset long, filled long")


def _pack(loose: DataFrame, base: int) -> DataFrame:
    """Packings of ``(uid, length)`` by shards, islands and rounds."""
    count = loose.count()
    shards = max(1, math.ceil(count / SHARD))
    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    listed = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "uid"))).alias("items"))
    listed = cut_lineage(listed.select((F.col("shard") + base).alias("shard"), F.col("items.length").cast("array<int>").alias("sizes"), F.col("items.uid").alias("uids")))
    empty = F.array().cast("array<array<int>>")
    state = listed.select("shard", "sizes", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), empty.alias("population"))
    for number in range(ROUNDS):
        tasks = max(1, shards * ISLANDS // 8)  # an explicit number, so that small rows with long work are not merged into one task
        state = cut_lineage(_round(state.repartition(tasks, "shard", "island"), number))
        if number < ROUNDS - 1:
            elite = state.select("shard", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.slice("population", 1, ELITE).alias("migrants"))
            state = state.join(elite, ["shard", "island"]).select("shard", "sizes", "island", F.concat("migrants", F.slice("population", 1, POPULATION - ELITE)).alias("population"))
    best = state.groupBy("shard").agg(F.min_by(F.col("population")[0], F.struct("used", "cost", "island")).alias("packing"))
    return cut_lineage(_placed(listed.join(best, "shard")))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Per piece: its document, place, length and checksum, its sequence and offset there."""
    parts = cut_lineage(pieces(docs, id_col, text_col, tokenizer))
    full = parts.where(F.col("length") >= CAPACITY).select("uid", (F.col("uid") + FULL_IDS).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = _pack(parts.where(F.col("length") < CAPACITY).select("uid", "length"), 0)
    tight = F.col("filled") >= LOOSE * CAPACITY
    again = first.where(~tight).select("uid").join(parts.select("uid", "length"), "uid")
    second = _pack(again, 1 << 40)
    placed = full.unionAll(first.where(tight).drop("filled")).unionAll(second.drop("filled"))
    return parts.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
