"""Near-duplicates by SimHash, linked through meet-in-the-middle ball hashing.

Fingerprints that differ in at most ``RADIUS`` bits share a value within half the
radius of both. So each distinct fingerprint emits itself and its 64 one-bit
variants, rows meet on equal values, and neighbours in a bucket's order are linked.
Every two members of a bucket are within the radius of each other, so the chain of
neighbours joins all of them without building their pairs; each link is verified
nevertheless. Components are found on distinct fingerprints by alternating large-
and small-star rounds, each written to the shared folder.

Copies meet before anything else: documents are reduced to distinct fingerprints
with their smallest id, so the size of a group of copies does not matter.

Defined cases: a null or empty text has fingerprint zero and links like any other;
a null id never names a component, and a component without any other id has a null
one; repeated rows give repeated results; columns other than the named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from priorlens.session import cut_lineage

from . import textkernel as tk

SHINGLE, SEED, RADIUS = 3, 42, 2


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row: lower-cased words, three-word shingles with repeats."""
    low = tk.LOWER[data]
    inside = tk.NOT_SPACE[low]
    starts, ends, first = tk.runs(inside, offsets)
    n_rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(n_rows, np.uint64)
    row = tk.row_of(first)
    joined = ends[:-1][row[1:] == row[:-1]]  # the byte after a word that another follows
    low[joined] = 0x20
    inside[joined] = True
    place = np.concatenate([[0], np.cumsum(inside)])
    text = low[inside].tobytes()
    last = np.minimum(np.arange(len(starts)) + SHINGLE, first[1:][row]) - 1
    whole = np.diff(first)[row] < SHINGLE
    at = np.flatnonzero((last - np.arange(len(starts)) == SHINGLE - 1) | (whole & (np.arange(len(starts)) == first[:-1][row])))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(place[starts[at]].tolist(), place[ends[last[at]]].tolist(), strict=True)], np.uint64)
    counts = np.bincount(row[at], minlength=n_rows)
    full = np.flatnonzero(counts)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
    votes = np.zeros((n_rows, 64), np.int64)
    for byte in range(8):  # a byte lane at a time keeps the unpacked bits small
        lane = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, byte])
        bits = np.unpackbits(lane.reshape(-1, 1), axis=1, bitorder="little")
        votes[full, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    ones = (2 * votes > counts[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed 64-bit integer."""
    source = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            fps = fingerprints(*tk.text_bytes(block.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id"), "fp": pa.array(fps.view(np.int64))})

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def near_pairs(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)``, a < b, that join all fingerprints within the radius of each other."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)])
    variants = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    previous = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = variants.select(previous.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(fp, root)`` for every node of an edge: the smallest node that can be reached."""
    edges = cut_lineage(edges.select("a", "b"))
    state = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("m as a", "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").selectExpr("m as a", "a as b").where("a <> b")
        edges = cut_lineage(small.unionAll(down.selectExpr("m as a", "b")).distinct())
        new = _state(edges)
        if new == state:
            return edges.selectExpr("b as fp", "a as root")
        state = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint and the smallest id among all it is linked with."""
    prints = cut_lineage(fingerprint_documents(docs, id_col, text_col))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(near_pairs(distinct))
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = named.join(smallest, "root").select("fp", "component_id")
    joined = prints.join(by_print, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, the one with the smallest id (the first read, among equal ids); all columns as they were.

    Rows are told apart by their place in the input, so ``docs`` must be a stored table.
    """
    row_key, place = free_name("_row_key", docs.columns), free_name("_place", docs.columns)
    own_id, own_text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    key = F.struct(own_id.isNull().alias("unnamed"), own_id.alias("id"), F.monotonically_increasing_id().alias("place"))
    keyed = docs.withColumn(row_key, key)
    found = near_duplicates(keyed.select(row_key, own_text.alias("text")), row_key, "text")
    chosen = found.where("doc_id.place = component_id.place").select(F.col("doc_id.place").alias(place))
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    return placed.join(chosen, place, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def free_name(name: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
