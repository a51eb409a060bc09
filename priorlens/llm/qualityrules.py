"""Quality rules with a modified Kneser-Ney language model.

The model is over bytes (lower case, digits and white space folded), so that its
alphabet is known and its tables stay small in every language. Tasks count their
``ORDER``-grams in sorted arrays, Spark adds them up over all distinct texts and derives
every lower order, the discounts and the interpolated probabilities by joins and
group-bys. What is shipped of the longest grams is the most frequent one of every
slot, at most ``SLOTS`` whatever the corpus holds, each with the gram itself as its
check; the others stay in a table, and texts that hold them get their probabilities
by a join, so no gram takes the value of another. Shorter grams are told apart whole.

A second scan takes the counts of the rules and the mean log probability of each
text. Bands are set per language and length class (powers of two of the word
count): ``BAND`` interquartile ranges (of ``LEAST_SPREAD`` at least) below the first
and above the third quartile of the texts that pass the counted rules. Texts that
share their least five-word shingle count once there, so neither copies nor near copies
narrow a band; classes with under ``LEAST`` of them use the language's own band, twice
as wide. Outside of its band a document goes.

Defined cases: a null or empty text has no words and fails the counted rules; a
null language counts as the empty one; a text without a whole gram has no
perplexity and stays in its band; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from priorlens.session import cut_lineage

from . import textkernel as tk
from .nearcopies import shingles
from .textstats import text_stats

ORDER = 4
SLOTS = 2_097_143  # a prime
SCATTER = 0x2C1B3C6D  # spreads grams of similar letters over the slots
BAND, LEAST, LEAST_SPREAD = 2.0, 50, 0.01
LEAST_WORDS, MOST_REPEATED = 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
HELD_GRAMS = 4_000_000

FOLD = tk.LOWER.copy()
FOLD[0x30:0x3A] = 0x30
FOLD[tk.SPACE] = 0x20


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ORDER``-grams that lie in one row as integers, first byte highest, and their places."""
    text = FOLD[data]
    n = len(text) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    gram = text[:n].astype(np.uint32)
    for k in range(1, ORDER):
        gram <<= np.uint32(8)
        gram |= text[k : k + n]
    valid = np.ones(n, bool)
    for k in range(1, ORDER):
        cut = offsets[1:-1] - k
        valid[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(valid)
    return gram[at], at


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_grams(docs: DataFrame) -> DataFrame:
    """``(gram, n)`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for block in tk.blocks(batches, "text"):
            held.append(np.unique(_grams(*tk.text_bytes(block.column("text")))[0], return_counts=True))
            if sum(len(k) for k, _ in held) > HELD_GRAMS:
                held = [_summed(held)]
        if held:
            keys, counts = _summed(held)
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_pydict({"gram": pa.array(keys[i : i + 100_000].astype(np.int64)), "n": pa.array(counts[i : i + 100_000].astype(np.int64))})

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Every text once. Only texts that stand in several rows are grouped, so the others need not move."""
    keyed = docs.select("text", F.xxhash64("text").alias("text_key"))
    copied = cut_lineage(keyed.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select("text_key"))
    once = keyed.join(copied, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    return keyed.join(copied, "text_key", "left_anti").select("text").unionAll(once.select("text"))


def _discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    counts = table.agg(*[F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(1, c) for c in counts)
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _slot(gram: Column) -> Column:
    hashed = (gram.bitwiseXOR(F.shiftright(gram, 15)) * SCATTER).bitwiseAND(F.lit((1 << 32) - 1))
    return (hashed % SLOTS).cast("int")


def _arrays(table: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their values."""
    found = table.select(F.col(key).cast("long"), F.col(value).cast("float")).toArrow()
    return found[key].to_numpy().astype(np.uint32), found[value].to_numpy()


class KneserNey:
    """Log probabilities by order, spread out once in each worker.

    Grams of ``ORDER`` bytes lie in slots, one each; those without a slot are the rows
    ``(gram, lp)`` of ``rest``. Shorter ones have a place of their own.
    """

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], backoff: dict[int, tuple[np.ndarray, np.ndarray]], rest: DataFrame) -> None:
        self.grams, self.backoff, self.rest, self.slots = grams, backoff, rest, SLOTS
        self._spread: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None, "_spread": {}}

    def held(self, grams: np.ndarray) -> np.ndarray:
        """Natural log of the last byte's probability for grams that have a slot, NaN for others."""
        slot = lambda keys: (keys ^ (keys >> np.uint32(15))) * np.uint32(SCATTER) % np.uint32(self.slots)
        if "held" not in self._spread:
            keys, values = self.grams[ORDER]
            own, table = np.zeros(self.slots, np.uint32), np.full(self.slots, np.nan, np.float32)
            own[slot(keys)], table[slot(keys)] = keys, values
            self._spread["held"] = own, table
        own, table = self._spread["held"]
        at = slot(grams)
        return np.where(own[at] == grams, table[at], np.float32(np.nan))

    def _look_up(self, kind: str, order: int, keys: np.ndarray) -> np.ndarray:
        if (kind, order) not in self._spread:
            known, values = getattr(self, kind)[order]
            table = np.full(1 << 8 * (order if kind == "grams" else order - 1), np.nan if kind == "grams" else 0, np.float32)
            table[known] = values
            self._spread[kind, order] = table
        return self._spread[kind, order][keys]

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Natural log of each gram's last byte given the bytes before it, for grams that have a slot or were never seen."""
        out = self.held(grams)
        left = np.flatnonzero(np.isnan(out))
        penalty = np.zeros(len(left), np.float32)
        for order in range(ORDER - 1, -1, -1):
            if not len(left):
                break
            context = (grams[left] >> np.uint32(8)) & np.uint32((1 << 8 * order) - 1)
            penalty = penalty + self._look_up("backoff", order + 1, context)
            value = self._look_up("grams", order, grams[left] & np.uint32((1 << 8 * order) - 1)) if order else np.full(len(left), -np.log(256), np.float32)
            known = ~np.isnan(value)
            out[left[known]] = value[known] + penalty[known]
            left, penalty = left[~known], penalty[~known]
        return out


def train(docs: DataFrame) -> KneserNey:
    """Counts over all distinct texts; probabilities from the lowest order up."""
    tables = {ORDER: cut_lineage(count_grams(distinct_texts(docs)))}
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")
        tables[order] = cut_lineage(tables[order + 1].groupBy(suffix).agg(F.count("*").alias("n")))
    grams, backoff, lower = {}, {}, None
    for order in range(1, ORDER + 1):
        table, (d1, d2, d3) = tables[order], _discounts(tables[order])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        table = table.withColumns({"context": F.shiftright("gram", 8), "suffix": F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)), "discount": discount})
        contexts = table.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("discount") / F.sum("n")).alias("gamma"))
        joined = table.join(contexts, "context")
        if lower is None:
            joined = joined.withColumn("low", F.lit(1 / 256))
        else:
            joined = joined.join(lower, "suffix")
        scored = cut_lineage(joined.select("gram", "n", ((F.col("n") - F.col("discount")) / F.col("total") + F.col("gamma") * F.col("low")).alias("p")))
        logs = scored.select("gram", "n", F.log("p").alias("lp"))
        if order < ORDER:
            grams[order] = _arrays(logs, "gram", "lp")
        backoff[order] = _arrays(contexts.withColumn("lg", F.log("gamma")), "context", "lg")
        lower = scored.select(F.col("gram").alias("suffix"), F.col("p").alias("low"))
    slotted = logs.withColumn("slot", _slot(F.col("gram")))
    first = cut_lineage(slotted.groupBy("slot").agg(F.max(F.struct("n", "gram", "lp")).alias("top")).select("slot", F.col("top.gram").alias("own"), F.col("top.lp").alias("lp")))
    grams[ORDER] = _arrays(first, "own", "lp")
    rest = cut_lineage(slotted.join(first.select("slot", "own"), "slot").where("own <> gram").select("gram", "lp"))
    return KneserNey(grams, backoff, rest)


def _least_shingles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least shingle hash of each row, 0 for a row without words."""
    hashes, bounds = shingles(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.minimum.reduceat(hashes, bounds[full])
    return out.view(np.int64)


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """Counts of the rules and the log perplexity of every text, which the model was trained on; ``text_key`` is equal for equal texts, ``least`` for most near copies too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in tk.blocks(batches, "text"):
            data, offsets = tk.text_bytes(block.column("text"))
            stats = text_stats(data, offsets)
            grams, at = _grams(data, offsets)
            row = np.searchsorted(at, offsets)
            lp = model.held(grams)
            absent = np.flatnonzero(np.isnan(lp))
            lp[absent] = 0
            sums = np.concatenate([[0.0], np.cumsum(lp, dtype=np.float64)])
            pairs, times = np.unique((np.searchsorted(row, absent, side="right") - 1).astype(np.uint64) << np.uint64(32) | grams[absent], return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(block.num_rows + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int32))
            columns = {k: pa.array(stats[k].astype(np.int64)) for k in COUNTS}
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id"), "lang": block.column("lang"), "text_key": block.column("text_key")} | columns | {
                "least": pa.array(_least_shingles(data, offsets)), "n_grams": pa.array(np.diff(row).astype(np.int64)), "held": pa.array(sums[row[1:]] - sums[row[:-1]]),
                "absent": pa.ListArray.from_arrays(ends, pa.array((pairs & np.uint64((1 << 32) - 1)).astype(np.int64))), "times": pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))),
            })

    counts = ", ".join(f"{k} long" for k in COUNTS)
    keyed = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_key"))
    found = cut_lineage(keyed.mapInArrow(run, f"doc_id {kind}, lang string, text_key long, {counts}, least long, n_grams long, held double, absent array<long>, times array<long>"))
    pairs = found.where("size(absent) > 0").select("text_key", F.explode(F.arrays_zip("absent", "times")).alias("p")).selectExpr("text_key", "p.absent as gram", "p.times as times").distinct()
    others = cut_lineage(pairs.join(model.rest, "gram").groupBy("text_key").agg(F.sum(F.col("times") * F.col("lp")).alias("other")))
    mean = (F.col("held") + F.coalesce("other", F.lit(0.0))) / F.col("n_grams")
    return found.join(others, "text_key", "left").select("doc_id", "lang", "text_key", "least", *COUNTS, F.when(F.col("n_grams") > 0, -mean).alias("log_ppl"))


def _band(wide: float) -> list:
    q = F.percentile_approx("log_ppl", [0.25, 0.75], 10_000)
    spread = wide * BAND * F.greatest(q[1] - q[0], F.lit(LEAST_SPREAD))
    return [(q[0] - spread).alias("low"), (q[1] + spread).alias("high"), F.count("*").alias("n_texts")]


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: counts, whether a counted rule fails, log perplexity, its band, and the verdict."""
    source = docs.selectExpr(f"`{id_col}` as doc_id", f"coalesce(cast(`{lang_col}` as string), '') as lang", f"`{text_col}` as text")
    scored = score(source, train(source))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = cut_lineage(scored.withColumns({"base_failed": failed, "class": F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")}))
    good = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).groupBy("lang", "class", "least").agg(F.min("log_ppl").alias("log_ppl"))
    own = good.groupBy("lang", "class").agg(*_band(1)).where(F.col("n_texts") >= LEAST).drop("n_texts")
    wide = good.groupBy("lang").agg(*_band(2)).selectExpr("lang", "low as wide_low", "high as wide_high")
    classes = scored.select("lang", "class").distinct().join(own, ["lang", "class"], "left").join(wide, "lang", "left")
    low, high = F.coalesce("low", "wide_low"), F.coalesce("high", "wide_high")
    bands = cut_lineage(classes.select("lang", "class", low.alias("low"), high.alias("high")))  # a stored table: the join may broadcast or split it
    joined = scored.join(bands, ["lang", "class"], "left")
    low, high = F.col("low"), F.col("high")
    inside = F.coalesce(F.col("log_ppl").between(low, high), F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "lang", "log_ppl", low.alias("band_low"), high.alias("band_high"),
    )
