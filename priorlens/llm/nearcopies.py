"""One document of each group of near copies: five-word shingles, similarity 0.8 or more.

A fingerprint has ``BLOCKS`` blocks of ``WIDTH`` bits. Blocks meet by ball hashing
within ``simhash.RADIUS`` bits: every distinct fingerprint emits each block and its
one-bit variants, and all that share a variant are paired with the bucket's first and
last member, so no bucket is expanded into its pairs or held by one task. Pairs are
verified by the Jaccard similarity of the whole shingle sets. Each document is compared
with its first partner before anything else; the other pairs only where the two are
still in different groups, which drops no link that could join groups.

A bit is not voted by all shingles, but taken from the shingle that comes first in
the bit's own order. Bits of two texts then differ with (1 - similarity) / 2, 0.10 at
0.8, where voted bits differ with 0.15: blocks of the same width meet three times as often.

Defined cases: a null or empty text has no shingles, and all such texts are one group;
a text of fewer than five words is one shingle; of each group the row with the smallest
id stays (null ids last, then the first read); repeated rows count as copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from priorlens.session import cut_lineage, release

from . import textkernel as tk
from .simhash import components, free_name

WORDS = 5
BLOCKS, WIDTH = 4, 32
PORTION = 1 << 16  # shingles whose orders are worked out at a time, or one text's
BLOCK = 1 << 20  # bytes of text at a time
# The order of shingles is by hash, after that come those of the lowest three tenths of the
# hashes that more than FREQUENT texts hold, at most LATEST of them. Any choice gives the same links.
COUNTED, FREQUENT, LATEST = (3 << 64) // 10, 8, 1 << 20

_orders = np.random.default_rng(8).integers(0, 1 << 63, (2, BLOCKS * WIDTH), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles in order, and where each row's begin and end: lower-cased words, however spaced."""
    low = tk.LOWER[data]
    starts, ends, first = tk.runs(tk.NOT_SPACE[low], offsets)
    words = tk.span_hash(tk.prefix(low), starts, ends)
    n_words = np.diff(first)
    sums = tk.prefix(words)
    counts = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    at = tk.expand(first[:-1], counts)
    row_end = np.repeat(first[1:], counts)
    return tk.span_hash(sums, at, np.minimum(at + WORDS, row_end)), np.concatenate([[0], np.cumsum(counts)])


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``BLOCKS`` numbers of ``WIDTH`` bits for each row; zero for a row without shingles."""
    n_rows = len(bounds) - 1
    bits = np.zeros((n_rows, BLOCKS * WIDTH), np.uint8)
    row = 0
    while row < n_rows:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PORTION, side="right")) - 1)
        full = row + np.flatnonzero(np.diff(bounds[row : to + 1]))
        part = hashes[bounds[row] : bounds[to]]
        for k, (odd, key) in enumerate(_orders.T if len(full) else ()):
            least = np.minimum.reduceat((part ^ key) * odd, bounds[full] - bounds[row])
            bits[full, k] = (tk.mix(least) & np.uint64(1)).astype(np.uint8)
        row = to
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").astype(np.int64)


def distinct_shingles(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The different shingles of each row, sorted."""
    return [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """``(key, blocks, digest)`` of ``(key, text)``; the digest is of the whole set: size, sum and exclusive or of its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text", BLOCK):
            found = shingles(*tk.text_bytes(block.column("text")))
            blocks = pa.FixedSizeListArray.from_arrays(pa.array(fingerprints(*found).ravel()), BLOCKS).cast(pa.list_(pa.int64()))
            digests = np.array([(len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(tk.mix(s)).view(np.int64)) if len(s) else 0) for s in distinct_shingles(*found)], np.int64)
            yield pa.RecordBatch.from_pydict({"key": block.column("key"), "blocks": blocks, "digest": pa.FixedSizeListArray.from_arrays(pa.array(digests.ravel()), 3).cast(pa.list_(pa.int64()))})

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, blocks array<long>, digest array<long>")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """``(node, shingles)`` of ``(node, text)``: the different shingles by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text", BLOCK):
            sets = distinct_shingles(*shingles(*tk.text_bytes(block.column("text"))))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"node": block.column("node"), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))})

    return docs.mapInArrow(run, "node long, shingles array<long>")


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of frequent shingles of ``(node, text)``; those with the most texts if there are very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text", BLOCK):
            sets = distinct_shingles(*shingles(*tk.text_bytes(block.column("text"))))
            low = np.concatenate([s[: np.searchsorted(s, np.uint64(COUNTED))] for s in sets])
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(low.view(np.int64))})

    counts = docs.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(LATEST).select("shingle").toArrow().column(0)
    return np.sort(rows.to_numpy().astype(np.int64).view(np.uint64))


def first_shingles(found: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Those of one sorted set of which any set of similarity 0.8 or more has one among its own."""
    at = np.searchsorted(late, found)
    is_late = late[np.minimum(at, len(late) - 1)] == found if len(late) else np.zeros(len(found), bool)
    return np.concatenate([found[~is_late], found[is_late]])[: len(found) - (4 * len(found) + 4) // 5 + 1] if len(found) else found


def _first_shingles(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """``(shingle, node, n)`` of ``(node, text)``: the first shingles of each set, and its size."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text", BLOCK):
            sets = distinct_shingles(*shingles(*tk.text_bytes(block.column("text"))))
            first = [first_shingles(s, shared.value) for s in sets]
            times = [len(f) for f in first]
            nodes = np.repeat(block.column("node").to_numpy(), times)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate(first).view(np.int64)), "node": pa.array(nodes), "n": pa.array(np.repeat([len(s) for s in sets], times).astype(np.int32))})

    return docs.mapInArrow(run, "shingle long, node long, n int")


def meetings(docs: DataFrame) -> DataFrame:
    """Stored ``(shingle, node, n)`` of ``(node, text)``: the first shingles that two sets or more have among theirs."""
    first = cut_lineage(_first_shingles(docs, frequent_shingles(docs)))
    shared = first.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1").select("shingle")
    return cut_lineage(first.join(shared, "shingle", "left_semi"))


def pairs_apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of different groups that may have a similarity of 0.8; ``roots(fp, root)`` names the groups of more than one.

    Of two sets with c shared first shingles, all others they share come after the
    first ones of one of them, so no more than c and that set's other shingles.
    """
    placed = met.join(roots.select(F.col("fp").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("shingle")
    placed = cut_lineage(placed.join(mixed, "shingle", "left_semi"))
    one, two = (placed.select("shingle", F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("root").alias(f"root_{c}")) for c in "ab")
    fits = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    both = one.join(two, "shingle").where(fits).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("c"))
    largest = F.greatest("n_a", "n_b")
    others = F.ceil(largest * 4 / 5) - 1
    return both.where(9 * (F.col("c") + others) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``(node, blocks)``, a < b, that meet in a block: every member of a bucket with its first and last one."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(WIDTH)])

    def in_block(block: int) -> DataFrame:
        # one block at a time: a bucket is of one block only, and the rows at once are a quarter
        variants = nodes.select("node", F.col("blocks")[block].alias("value"), F.explode(masks).alias("mask")).select("node", F.col("value").bitwiseXOR(F.col("mask")).alias("variant"))
        met = cut_lineage(variants.groupBy("variant").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last"))
        both = variants.join(met, "variant").select("node", F.explode(F.array("first", "last")).alias("other"))
        pairs = cut_lineage(both.where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
        release(met)
        return pairs

    return reduce(DataFrame.unionByName, [in_block(block) for block in range(BLOCKS)]).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a similarity of 0.8 or more."""
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    sizes = F.size("of_a") + F.size("of_b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    near = 5 * F.least(F.size("of_a"), F.size("of_b")) >= 4 * F.greatest(F.size("of_a"), F.size("of_b"))
    return pairs.join(one, "a").join(two, "b").where(near & (5 * shared >= 4 * (sizes - shared))).select("a", "b")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(place, kept)`` of every row of ``docs``, a stored table: its place, and whether it stays as the first of its group."""
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("unnamed"), F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("place"))
    texts = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    prints = cut_lineage(_fingerprinted(texts))
    copies = cut_lineage(prints.groupBy("blocks", "digest").agg(F.min("key").alias("least")).select("blocks", "least", F.col("least.place").alias("node")))

    def texts_of(nodes: DataFrame) -> DataFrame:
        return texts.select(F.col("key.place").alias("node"), "text").join(nodes, "node").select("node", "text")

    def sets_of(pairs: DataFrame) -> DataFrame:
        return cut_lineage(_shingle_sets(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())))

    pairs = cut_lineage(candidate_pairs(copies))
    sets = sets_of(pairs)
    linked = cut_lineage(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")), sets))
    roots = components(linked)
    named = lambda c: roots.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}"))
    apart = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    linked = cut_lineage(linked.unionByName(_verified(cut_lineage(apart.select("a", "b")), sets)))
    roots = components(linked)
    release(sets)
    missed = cut_lineage(pairs_apart(meetings(texts_of(copies.select("node"))), roots))
    roots = components(linked.unionByName(_verified(missed, sets_of(missed))))
    grouped = copies.join(roots, copies.node == roots.fp, "left").withColumn("root", F.coalesce("root", "node"))
    firsts = cut_lineage(grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.place").alias("place")))
    return prints.select(F.col("key.place").alias("place")).join(firsts.withColumn("kept", F.lit(True)), "place", "left").fillna(False, ["kept"])


def keep_one_of_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group; all columns as they were. Rows are told apart by their place, so ``docs`` must be a stored table."""
    place = free_name("_place", docs.columns)
    chosen = near_copy_groups(docs, id_col, text_col).where("kept").select(F.col("place").alias(place))
    return docs.withColumn(place, F.monotonically_increasing_id()).join(chosen, place, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
