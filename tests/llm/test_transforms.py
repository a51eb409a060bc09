"""Whitening, fill-in-the-middle and byte-level BPE."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest_llm import same
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from priorlens.llm import bytebpe, fillmiddle, queries, whitening

LETTERS = st.text(alphabet=st.one_of(st.sampled_from("aZ b.<P>SM\n@[`{é漢🙂\x00\x7f"), st.characters(exclude_categories=("Cs",))), max_size=40)


# Whitening


def exact_fit(vectors):
    """Count, sums, covariance (each entry rounded once) in plain Python."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(v[i] for v in x) for i in range(d)]
    covariance = [[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x), n**3)) for j in range(d)] for i in range(d)]
    return x, n, sums, np.array(covariance)


def valid(vector):
    return vector is not None and len(vector) and all(c is not None and math.isfinite(c) for c in vector)


def check(frame, rows, most=32):
    """The whole result against plain Python and a library eigendecomposition."""
    kept = [(i, v) for i, v in rows if valid(v)]
    length = max(Counter(len(v) for _, v in kept).items(), key=lambda c: (c[1], c[0]))[0]
    kept = [(i, v) for i, v in kept if len(v) == length]
    x, n, sums, covariance = exact_fit([v for _, v in kept])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    rank = min(most, int((values > values[0] * length * 1e-14).sum()))
    found = frame.collect()
    assert len(found) == len(kept) * rank and {r.n for r in found} == {n}
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert Counter((r.vec_id, r.component, r.deviation) for r in found) == Counter((i, c + 1, dev) for (i, _), dev in zip(kept, deviations, strict=True) for c in range(rank))
    error = found[0].identity_error
    assert {r.identity_error for r in found} == {error} and 0 <= error < 1e-7
    for r in found:
        assert r.explained == pytest.approx(values[r.component - 1] / covariance.trace(), rel=1e-9)
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for v in x])
    expected = centred @ axes[:, :rank] / np.sqrt(values[:rank])
    gaps = np.minimum(np.append(np.inf, -np.diff(values))[:rank], np.append(-np.diff(values), np.inf)[:rank])
    got = defaultdict(list)
    for r in found:
        got[r.vec_id, r.component].append(r.whitened)
    by_id = defaultdict(list)
    for (i, _), w in zip(kept, expected, strict=True):
        by_id[i].append(w)
    for c in np.flatnonzero(gaps > 1e-6 * values[0]).tolist():
        signs = []
        for i, ws in by_id.items():
            ours, theirs = sorted(got[i, c + 1]), sorted(w[c] for w in ws)
            turned = sorted(-w[c] for w in ws)
            signs.append((np.allclose(ours, theirs, rtol=1e-7, atol=1e-9), np.allclose(ours, turned, rtol=1e-7, atol=1e-9)))
        assert all(a for a, _ in signs) or all(b for _, b in signs)


def frame_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def test_whitening_of_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(200)
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    odd = [
        (1_000, None), (1_001, [None] + [0.0] * 63), (1_002, [float("nan")] * 64), (1_003, [0.5] * 63 + [float("inf")]), (1_004, [0.0] * 63),
        (1_005, []), (None, [0.25] * 64), (1_006, [0.25] * 64), (1_006, [0.25] * 64), (1_007, [-0.0] * 64),
    ]
    frame = frame_of(spark, rows + odd).select("*", F.lit(1).alias("n"), F.lit(2).alias("component"), F.lit(3).alias("x"))
    result = whitening.whiten(frame)
    check(result, rows + odd)
    assert result.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_dependent_and_skewed_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 3)) * [40, 1, 0.2]
    wide = np.concatenate([base, base[:, :1] * 2, np.full((60, 2), 7.0)], axis=1)
    rows = [(i, v) for i, v in enumerate((np.round(wide * 64) / 64).tolist())]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # one vector in 40 % of all rows
    check(whitening.whiten(frame_of(spark, rows, "double")), rows)


def test_whitening_without_spread(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        result = whitening.whiten(frame_of(spark, rows))
        assert result.count() == 0 and dict(result.dtypes)["deviation"] == "bigint"


def test_whitening_of_huge_entries(spark):
    rows = [(i, [float(i), 1e30 if i == 3 else 0.0]) for i in range(6)]
    found = whitening.whiten(frame_of(spark, rows, "double")).collect()
    assert len(found) == 6 and {r.deviation for r in found} == {None}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 15), st.integers(0, 10**6))
def test_cholesky_and_rotations(size, rank, seed):
    rng = np.random.default_rng(seed)
    half = rng.integers(-50, 50, (size, rank)).astype(float) * rng.choice([1, 1000], rank)
    matrix = half @ half.T
    factor, order = whitening.pivoted_cholesky(matrix)
    assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)], atol=1e-12 * max(1, matrix.max(initial=1)))
    assert np.allclose(np.triu(factor, 1), 0)
    values, vectors = whitening.eigen(matrix)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][: len(values)], atol=1e-12 * max(1, matrix.max(initial=1)))
    assert (np.diff(values) <= 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, -3, 2**27 + 1, 2**40 - 1, -(2**46)]), min_size=2, max_size=2), max_size=6))
def test_exact_products(rows):
    y = np.array(rows, np.float64).reshape(-1, 2)
    whole = [[int(c) for c in r] for r in rows]
    assert whitening._products(y).tolist() == [[sum(r[i] * r[j] for r in whole) for j in range(2)] for i in range(2)]
    assert whitening._sums(y) == [sum(r[i] for r in whole) for i in range(2)]


# Fill-in-the-middle


def rearranged(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(stored, empty):
    docs, rows = stored
    result = fillmiddle.fill_in_middle(docs)
    assert same(result, [rearranged(*r) for r in rows])
    back = result.select("doc_id", fillmiddle.restored(F.col("output"), F.col("form")))
    assert same(back, [(i, t or "") for i, t in rows])
    assert fillmiddle.fill_in_middle(empty).count() == 0


def test_fill_in_middle_of_odd_texts(spark):
    rng = random.Random(3)
    parts = ["ab", "Z", "é", "漢", "🙂", " ", "<P>", "<S", "S>", "<", ">", "\n", "@", "[", "`", "{", "\x00", "\x7f", "a" * 70, "é" * 9]
    rows = [(i if i % 50 else None, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(2000)]
    rows += [(7, "x" * 300_000), (8, "漢字 " * 100_000), (8, "漢字 " * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    result = fillmiddle.fill_in_middle(frame.select("*", F.lit(1).alias("id"), F.lit(2).alias("output"), F.lit(3).alias("form")))
    assert same(result, [rearranged(*r) for r in rows])
    assert {r.form for r in result.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = result.select("doc_id", fillmiddle.restored(F.col("output"), F.col("form")))
    assert same(back, rows)


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_rank_and_select(text):
    raw = text.encode()
    ends = []
    for unit in re.finditer("[A-Za-z]+|[^A-Za-z]", text):
        ends.append(len(text[: unit.end()].encode()) - 1)
    words = fillmiddle.as_words(np.frombuffer(raw, np.uint8))
    marks = fillmiddle.mark_unit_ends(words)
    flags = marks.view(np.uint8)
    if raw:
        flags[len(raw) - 1] |= 0x80
    flags[len(raw) :] = 0
    assert np.flatnonzero(flags).tolist() == ends and set(flags[ends].tolist()) <= {0x80}
    marked = fillmiddle.Marked(marks)
    assert marked.select(np.arange(1, len(ends) + 1)).tolist() == ends
    assert marked.rank(np.arange(len(raw) + 1)).tolist() == [sum(e < at for e in ends) for at in range(len(raw) + 1)]


# Byte-level BPE


@pytest.fixture(scope="module")
def theirs():
    ranks = dict(bytebpe.read_ranks(bytebpe.default_path()))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bytebpe.Codec(portion=7, cached=20)


def test_byte_bpe(stored, empty, theirs):
    docs, rows = stored
    encoded = bytebpe.encode_texts(docs)
    assert same(encoded.select("doc_id", F.col("ids").cast("string")), [(i, str(theirs.encode_ordinary(t or "")).replace("'", "")) for i, t in rows])
    for back in (bytebpe.decode_ids(encoded), bytebpe.encode_texts(docs, decoded=True)):
        assert same(back.select("doc_id", F.col("decoded").cast("string")), [(i, t or "") for i, t in rows])
    assert bytebpe.decode_ids(bytebpe.encode_texts(empty)).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab '’sllvereT 12\n\t\r\x1c\x85 漢🙂é՘ೝㇿ"), st.characters(exclude_categories=("Cs",))), max_size=30), max_size=4))
def test_ids_equal_rank_encoder(ours, theirs, texts):
    ids = [np.frombuffer(x, "<i4") for x in ours.encode(texts)]
    assert [x.tolist() for x in ids] == [theirs.encode_ordinary(t) for t in texts]
    offsets = np.cumsum([0, *map(len, ids)])
    data, bounds = ours.decode(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int64), offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == texts


def test_every_unassigned_character(ours, theirs):
    """Characters whose kind differs between Unicode versions, and long runs without a merge to the end."""
    odd = bytebpe._differing(public_tokenizers.PATTERN)
    texts = [f"a{c} {c}1{c}b" for c in odd[:: max(1, len(odd) // 500)]] + ["a" * 5_000, " " * 5_000, "é" * 3_001, "!?" * 2_000, "0" * 999]
    assert [np.frombuffer(x, "<i4").tolist() for x in ours.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_long_text_in_portions(monkeypatch, theirs):
    monkeypatch.setattr(bytebpe, "LONG", 50)
    text = "Some words, 123 and more. " * 40
    assert np.frombuffer(bytebpe.Codec(portion=11).encode([text])[0], "<i4").tolist() == theirs.encode_ordinary(text)


def test_other_rank_files(tmp_path):
    """Ranks need not be the line numbers, and a whole match is one id even if no merge leads to it."""
    import base64

    tokens = {bytes([b]): b * 2 for b in range(256)} | {b"ab": 600, b"bc": 599, b"abcd": 700}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in tokens.items()))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens={})
    texts = ["abc", "abcd", "xabcd", "ab bc abcd", ""]
    codec = bytebpe.Codec(str(path))
    assert [np.frombuffer(x, "<i4").tolist() for x in codec.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_null_ids_and_taken_names(spark):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, ids array<int>")
    assert same(bytebpe.decode_ids(frame, decoded="out").select("doc_id", F.col("out").cast("string")), [(1, ""), (2, ""), (3, "a")])
    with pytest.raises(ValueError):
        bytebpe.decode_ids(frame, decoded="ids")


def test_new_queries_columns(spark):
    folder = "/root/testdata/sf0.001"
    wanted = {
        "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op13_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    }
    for name, columns in wanted.items():
        frame = queries.QUERIES[name](spark, folder)
        assert frame.columns == columns
        texts = {r.doc_id: r.text or "" for r in queries.table(spark, folder, "documents").collect()}
        digest = columns[-1]
        assert {r.doc_id: r[digest] for r in frame.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
