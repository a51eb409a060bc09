"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Their votes are grouped
into patterns over all documents (at most ``3 ** labellers`` rows), and expectation
maximisation over the pattern counts estimates how right each labeller is in either
class, and the posterior of every pattern. The posteriors are the labels of a linear
scorer over hashed byte 5-grams and votes, fitted by Spark on a sample
of about ``SAMPLE`` distinct texts (chosen by their hash, each taken once however many
rows hold it) in parts of about ``PART``, whose weights are averaged. The scorer judges every whole text; under ``KEEP`` a document is rejected.

Defined cases: a null or empty text draws the votes of an empty text; equal texts get
equal scores; an empty table has no result; columns other than the named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .textstats import SYMBOL, text_stats

SAMPLE, PART = 8_192, 1_024
BLOCK = 1 << 20  # bytes of text judged at a time: votes and grams take tens of bytes for each
DIMENSIONS, GRAM, SCALE = 1 << 14, 5, 30.0
EM_ROUNDS, STEPS, RATE, DECAY = 100, 400, 0.05, 1e-5
KEEP = 0.3
RIGHT = ((0.05, 0.5), (0.55, 0.995))  # bounds: bad texts are of many kinds and a labeller sees few of them, good texts are of one

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_ASCII_LETTER = _CAPITAL.copy()
_ASCII_LETTER[0x61:0x7B] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True

LABELLERS = ("symbols", "word length", "repeated lines", "repeated words", "letters", "sentences", "length", "word ends", "bare words", "capitals", "echoes")


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of the labellers, rows by labellers: 1 good, -1 bad, 0 none."""
    s = text_stats(data, offsets)
    words = s["n_words"]
    some = np.maximum(words, 1)
    inside = tk.NOT_SPACE[data]
    solid = np.maximum(tk.per_row(inside, offsets), 1)
    letters = tk.per_row(_LETTER[data], offsets) / solid
    stops = tk.per_row(_STOP[data], offsets)
    mean_length, symbols = s["word_chars"] / some, s["n_symbols"] / some
    dup_lines = s["n_dup_lines"] / np.maximum(s["n_lines"], 1)
    repeats = s["n_repeat_words"] / some
    per_sentence = words / np.maximum(stops, 1)
    starts, ends, first = tk.runs(inside, offsets)
    odd_ends = tk.per_row(SYMBOL[data[np.maximum(ends, 1) - 1]] if len(ends) else ends, first) / some
    sums = np.concatenate([[0], np.cumsum(_LETTER[data])])
    bare = tk.per_row(sums[ends] == sums[starts], first) / some

    capitals = tk.per_row(_CAPITAL[data], offsets) / np.maximum(tk.per_row(_ASCII_LETTER[data], offsets), 1)
    echoes = s["n_echo_words"] / some

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0))

    return np.stack([
        vote(symbols > 0.2, symbols < 0.05),
        vote((mean_length < 2.5) | (mean_length > 12), (mean_length > 3.5) & (mean_length < 9)),
        vote(dup_lines > 0.3, (s["n_lines"] >= 3) & (dup_lines < 0.05)),
        vote(repeats > 0.3, (words >= 50) & (repeats < 0.05)),
        vote(letters < 0.7, letters > 0.85),
        vote((words >= 50) & (per_sentence > 100), (per_sentence > 2) & (per_sentence < 60)),
        vote(words < 10, words >= 40),
        vote(odd_ends > 0.2, odd_ends < 0.05),
        vote(bare > 0.2, bare < 0.05),
        vote(capitals > 0.4, capitals < 0.15),
        vote(echoes > 0.1, (words >= 20) & (echoes < 0.03)),
    ], axis=1).astype(np.int8)


def patterns(v: np.ndarray) -> np.ndarray:
    """A number in base three for each row of votes."""
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def estimate(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for every pattern there can be, and each labeller's accuracy on (bad, good)."""
    every = _votes_of(np.arange(3 ** len(LABELLERS)))
    seen = np.array(sorted(counts), np.int64)
    v, n = _votes_of(seen), np.array([counts[k] for k in seen.tolist()], float)
    right = np.repeat([[0.4], [0.9]], len(LABELLERS), axis=1)
    prior = 0.7

    def posterior(x: np.ndarray) -> np.ndarray:
        good = np.log(prior) + ((x == 1) * np.log(right[1]) + (x == -1) * np.log(1 - right[1])).sum(axis=1)
        bad = np.log(1 - prior) + ((x == -1) * np.log(right[0]) + (x == 1) * np.log(1 - right[0])).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))

    for _ in range(EM_ROUNDS):
        if not len(seen):
            break
        p = posterior(v)
        for cls, weight, sign in ((1, n * p, 1), (0, n * (1 - p), -1)):
            voted = weight @ (v != 0)
            right[cls] = np.clip((weight @ (v == sign) + 1) / (voted + 2), *RIGHT[cls])
        prior = float(np.clip((n @ p + 1) / (n.sum() + 2), 0.05, 0.95))
    return posterior(every), right


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte 5-grams of lower-cased texts, and the offsets of rows among them."""
    text = tk.LOWER[data].astype(np.uint64)
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    key = text[:n].copy()
    for k in range(1, GRAM):
        key = (key << np.uint64(8)) | text[k : k + n]
    slots = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)
    valid = np.ones(n, bool)
    for k in range(1, GRAM):
        cut = offsets[1:-1] - k
        valid[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(valid)
    return slots[at], np.searchsorted(at, offsets)


def _logits(w: np.ndarray, slots: np.ndarray, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Mean weight of a text's grams, plus the weights of its votes and the bias."""
    sums = np.concatenate([[0.0], np.cumsum(w[slots], dtype=np.float64)])
    mean = (sums[rows[1:]] - sums[rows[:-1]]) / np.maximum(np.diff(rows), 1)
    return SCALE * mean + v @ w[DIMENSIONS : DIMENSIONS + v.shape[1]] + w[-1]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels, full batches with adaptive steps."""
    w = np.zeros(x.shape[1], np.float32)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y).astype(np.float32) / len(y) + DECAY * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w


def label_model(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Posteriors by pattern, accuracies, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(3 ** len(LABELLERS), np.int64)
        for block in tk.blocks(batches, "text", BLOCK):
            counts += np.bincount(patterns(votes(*tk.text_bytes(block.column("text")))), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(seen), "n": pa.array(counts[seen])})

    rows = docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {r["pattern"]: r["n"] for r in rows}
    posterior, right = estimate(counts)
    return posterior, right, sum(counts.values())


def sample(docs: DataFrame) -> tuple[DataFrame, int]:
    """About ``SAMPLE`` of the distinct texts, null read as empty, and how many to expect."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(text.alias("text"), F.xxhash64(text).alias("key"))
    n_texts = keyed.select("key").distinct().count()
    share = min(1.0, SAMPLE / max(n_texts, 1))
    chosen = keyed.where(F.pmod("key", F.lit(1 << 40)) < int(share * (1 << 40)) + 1)
    return chosen.groupBy("key").agg(F.first("text").alias("text")).select("text"), min(n_texts, SAMPLE)


def train(docs: DataFrame, posterior: np.ndarray) -> np.ndarray:
    """Averaged weights of the parts of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for block in tk.blocks(batches, "text", BLOCK):
            data, offsets = tk.text_bytes(block.column("text"))
            slots, rows = _features(data, offsets)
            v = votes(data, offsets)
            x = np.ones((len(v), DIMENSIONS + v.shape[1] + 1), np.float32)
            for i in range(len(v)):
                n = rows[i + 1] - rows[i]
                x[i, :DIMENSIONS] = np.bincount(slots[rows[i] : rows[i + 1]], minlength=DIMENSIONS) * (SCALE / max(n, 1))
            x[:, DIMENSIONS:-1] = v
            xs.append(x)
            ys.append(posterior[patterns(v)])
        if xs:
            w = _fit(np.concatenate(xs), np.concatenate(ys))
            yield pa.RecordBatch.from_pydict({"w": pa.array([w.tolist()], pa.list_(pa.float32())), "n": pa.array([float(sum(map(len, ys)))])})

    chosen, n_texts = sample(docs)
    parts = chosen.repartition(max(1, n_texts // PART)).mapInArrow(run, "w array<float>, n double").collect()
    if not parts:
        return np.zeros(DIMENSIONS + len(LABELLERS) + 1, np.float32)
    return np.average([r["w"] for r in parts], axis=0, weights=[r["n"] for r in parts]).astype(np.float32)


class Scorer:
    """Posterior, score and verdict for the rows of a block."""

    def __init__(self, docs: DataFrame) -> None:
        self.posterior, self.accuracies, _ = label_model(docs)
        self.weights = train(docs, self.posterior)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = tk.text_bytes(column)
        v = votes(data, offsets)
        logits = _logits(self.weights, *_features(data, offsets), v)
        return self.posterior[patterns(v)], 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the label model's posterior, the scorer's probability of good, and whether it is kept."""
    source = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    scorer = Scorer(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text", BLOCK):
            posterior, score = scorer(block.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id"), "posterior": pa.array(posterior), "score": pa.array(score), "kept": pa.array(score >= KEEP)})

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text is not rejected, all columns as they were."""
    scorer = Scorer(docs.selectExpr(f"`{text_col}` as text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, text_col, BLOCK):
            yield block.filter(pa.array(scorer(block.column(text_col))[1] >= KEEP))

    return docs.mapInArrow(run, docs.schema)
