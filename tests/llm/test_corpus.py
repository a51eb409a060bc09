"""Near-duplicates, packing, repeats, the classifier and the language model."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest_llm import SPACED, held_out, lower, same
from hypothesis import given, settings, strategies as st

from priorlens.llm import attention, lmscore, packing, quality, simhash, subwords, suffixdedup


def fingerprint(text):
    words = SPACED.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(stored, empty):
    docs, rows = stored
    prints = [fingerprint(t) for _, t in rows]
    ids = defaultdict(list)
    for (doc_id, _), f in zip(rows, prints, strict=True):
        ids[f].append(doc_id)
    parent = {f: f for f in ids}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    nodes = list(ids)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    members = defaultdict(list)
    for f in nodes:
        members[root(f)] += [i for i in ids[f] if i is not None]
    expected = [(doc_id, f"{f:016x}", min(members[root(f)], default=None)) for (doc_id, _), f in zip(rows, prints, strict=True)]
    assert same(simhash.near_duplicates(docs), expected)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(members)
    assert simhash.near_duplicates(empty).count() == 0


def test_kept_rows_keep_columns_of_any_name(spark, tmp_path):
    """Columns named like the operator's own, in any case, and an id column that needs quotes."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(7, 1, 7, "one " + words), (8, 2, 8, "one " + words), (9, 3, 9, "quite another text that shares nothing")]
    spark.createDataFrame(rows, "_place int, `doc.id` long, _ROW_KEY int, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    kept = simhash.keep_one_of_each(spark.read.parquet(str(tmp_path / "docs")), "doc.id")
    assert kept.columns == ["_place", "doc.id", "_ROW_KEY", "text"]
    assert sorted(tuple(r)[:3] for r in kept.collect()) == [(7, 1, 7), (9, 3, 9)]


def test_chains_of_links(spark):
    """Fingerprints that only a chain of neighbours joins."""
    chain = [0]
    for k in range(0, 60, 2):
        chain.append(chain[-1] ^ (0b11 << k))
    signed = [x - (1 << 64) if x >> 63 else x for x in chain]
    random.Random(1).shuffle(signed)
    found = simhash.components(simhash.near_pairs(spark.createDataFrame([(x,) for x in [*signed, 1 << 62]], "fp long")))
    assert len({r.root for r in found.collect()}) == 1 and found.count() == len(chain)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB's.,0 \t\n\x1c\x85éÉİΣ１漢🙂<|endoftext|>"), st.characters(max_codepoint=0x24F, exclude_categories=("Cs",))), max_size=30))
def test_word_cache_equals_tokenizer(text):
    assert ours().encode(text) == np.array(theirs().encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_LETTERS = st.text(alphabet=st.one_of(st.sampled_from("aB's.,0 \t\n\x1c\x85éÉİΣ１漢🙂<|"), st.characters(max_codepoint=0x24F, exclude_categories=("Cs",))), max_size=12)
_MARKED = st.lists(st.one_of(_LETTERS, st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "def <|endoftext|> ghi"])), max_size=4).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), _MARKED), max_size=6))
def test_rows_equal_tokenizer(texts):
    ids, bounds = ours().encode_rows(pa.array(texts, pa.string()))
    assert len(bounds) == len(texts) + 1 and len(ids) == bounds[-1]
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == theirs().encode(text or "", add_special_tokens=False).ids


def test_special_marks_inside_words():
    ids, bounds = ours().encode_rows(pa.array(["abc", "abc<|endoftext|>def", "", "<|startoftext|>", "a <", "|b"]))
    assert ids[bounds[1] : bounds[2]].tolist() == [5334, 49407, 11649]
    assert bounds[4] - bounds[3] == 1


_made = {}


def ours():
    return _made.setdefault("ours", subwords.Subwords())


def theirs():
    from tokenizers import Tokenizer

    return _made.setdefault("theirs", Tokenizer.from_file(subwords.default_path()))


def test_packing(stored, empty):
    docs, rows = stored
    expected = []
    for doc_id, text in rows:
        ids = np.array([*theirs().encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    got = packing.pack_documents(docs)
    assert same(got.select("doc_id", "piece", "start", "length", "ids_crc32"), expected)
    sequences = defaultdict(list)
    for r in got.collect():
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(e[3] for e in expected) / 2048) * 1.02 + 1
    assert packing.pack_documents(empty).count() == 0


def test_crossover_keeps_every_piece_once():
    rng = random.Random(3)
    sizes = [rng.randint(1, 2047) for _ in range(300)]
    population = packing.evolve(sizes, [], rng)
    used = [max(p) + 1 for p in population]
    first = packing.Bins(sizes)
    first.best_fit(sorted(range(300), key=lambda i: -sizes[i]))
    assert used[0] <= len(first.bins)
    for p in population:
        filled = Counter()
        for size, b in zip(sizes, p, strict=True):
            filled[b] += size
        assert len(p) == 300 and max(filled.values()) <= 2048


def test_suffix_order_and_common_prefixes():
    rng = random.Random(5)
    for k in range(150):
        letters = rng.choice([1, 2, 3, 8])
        text = [rng.randint(1, letters) for _ in range(rng.randint(1, 300))]
        if k % 3 == 0:
            text = text[: max(1, len(text) // 7)] * 6
        text.append(0)
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffixdedup.suffix_order(np.array(text), max(text) + 1).tolist() == order
        least, shared = rng.randint(1, 12), [False] * len(text)
        for i, j in zip(order, order[1:], strict=False):
            if text[i : i + least] == text[j : j + least] and max(i, j) + least <= len(text):
                shared[i] = shared[j] = True
        assert suffixdedup.long_common(np.array(text), np.array(order), least).tolist() == shared


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 2])
def test_repeats(spark, stored, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    docs, _ = stored
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(420))
    added = [(1, "x" * 399), (2, "x" * 401), (3, passage[:395] + "Q" * 500), (4, passage[:405]), (5, "y" + passage + "z" + passage), (6, passage[10:]), (7, "ab" * 300)]
    added += [(100 + k, "".join(rng.choice("xyz") for _ in range(7)) + passage[: 393 + k % 20] + "".join(rng.choice("xyz") for _ in range(9))) for k in range(40)]
    both = docs.select("doc_id", "text").where("length(text) < 20000 or text is null").unionAll(spark.createDataFrame(added, "doc_id long, text string"))
    rows = [(r.doc_id, (r.text or "").encode()) for r in both.collect()]
    counts = Counter(raw[i : i + 400] for _, raw in rows for i in range(len(raw) - 399))
    expected = []
    for doc_id, raw in rows:
        gone, last = bytearray(len(raw)), 0
        for i in range(len(raw) - 399):
            if counts[raw[i : i + 400]] > 1:
                a = max(i, last)
                gone[a : i + 400] = b"\1" * (i + 400 - a)
                last = i + 400
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        expected.append((doc_id, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert same(suffixdedup.remove_repeats(both), expected)
    assert suffixdedup.remove_repeats(empty).count() == 0


def test_long_repetitive_text(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000), (2, "z" * 100_000), (3, "unique")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixdedup.remove_repeats(docs).collect()}
    assert got == {1: (300_000, 300_000, 1), 2: (100_000, 100_000, 1), 3: (6, 0, 0)}


def test_quality_classifier(stored, tables, empty):
    docs, rows = stored
    got = quality.classify(docs)
    assert got.count() == len(rows)
    judged = got.join(tables["labels"], "doc_id").toPandas()
    good = judged.quality == 1
    assert judged.kept[good].mean() > 0.98
    assert judged.kept[~good].mean() < 0.6
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality.classify(empty).count() == 0


def test_sample_is_bounded_whatever_the_groups(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 64)
    docs = spark.range(9_000).selectExpr("case when id % 3 = 1 then null when id % 3 = 2 then concat('copy ', cast(id % 5 as string)) else concat('text ', cast(id as string)) end as text")
    chosen, expected = quality.sample(docs)
    texts = [r.text for r in chosen.collect()]
    assert expected == 64 and 24 < len(texts) < 120 and len(set(texts)) == len(texts) and None not in texts
    monkeypatch.setattr(quality, "SAMPLE", 10_000)
    assert quality.sample(docs)[0].count() == quality.sample(docs)[1] == 3_000 + 5 + 1


def test_label_model_finds_the_accurate_labeller():
    rng = np.random.default_rng(1)
    n, m = 20_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.8
    right = np.where(good[:, None], 0.95, 0.4)
    votes = np.where(rng.random((n, m)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    keys, counts = np.unique(quality.patterns(votes), return_counts=True)
    posterior, _ = quality.estimate(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert ((posterior[quality.patterns(votes)] > 0.5) == good).mean() > 0.95


def test_attention_is_causal_and_scores_each_token_once():
    rng = np.random.default_rng(2)
    model = attention.untrained()
    model.counts = rng.gamma(0.2, 1.0, model.counts.shape)
    model.refresh(np.ones(attention.VOCABULARY))
    reader = attention.Reader(model)
    tokens = rng.integers(0, 1000, 200)
    offsets = np.array([0, 0, 1, 25, 200])
    scores = reader.run(tokens, offsets)
    assert len(scores) == 200 + 4 and (scores < 0).all()
    for at in (30, 100, 199):  # places of the last text; it has three ends before it
        other = tokens.copy()
        other[at] = (other[at] + 7) % 1000
        changed = np.flatnonzero(~np.isclose(reader.run(other, offsets), scores, rtol=1e-5))
        assert changed.min() == at + 3 and changed.max() <= at + 3 + attention.WINDOW
    alone = [reader.run(tokens[a:b], np.array([0, b - a])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert np.allclose(np.concatenate(alone), scores, rtol=1e-4)
    # probabilities over the vocabulary sum to one
    total = sum(math.exp(reader.run(np.array([5, t]), np.array([0, 2]))[1]) for t in range(0, attention.VOCABULARY, 97))
    assert 0.3 < total * 97 < 3


def test_scores(stored, empty, monkeypatch):
    docs, rows = stored
    monkeypatch.setattr(lmscore, "CHUNK", 200_000)
    got = lmscore.score_texts(docs).collect()
    words = [(i, [*SPACED.findall(lower(t)), None]) for i, t in rows]
    counts = Counter(w for i, ws in words if not held_out(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for i, ws in words:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        expected.append((i, held_out(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 4)))
    found = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got)
    assert found == Counter(e[:5] for e in expected)
    assert np.allclose(sorted(r.base_score for r in got), sorted(e[5] for e in expected), atol=1e-3)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lmscore.score_texts(empty).count() == 0


def test_attention_learns_from_every_window_of_every_training_text(spark, tmp_path):
    words = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=7)) for i in range(900)]
    rows = [(i, f"{w} said {w} " * (40 if i == 5 else 1)) for i, w in enumerate(words)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs, pieces = spark.read.parquet(str(tmp_path / "docs")), subwords.Subwords(None, 1000, 1000)
    model = lmscore.trained(docs, pieces)
    ids = [np.frombuffer(pieces.encode(t), "<u4") for i, t in rows if not held_out(i)]
    unigram = np.bincount(np.concatenate(ids), minlength=attention.VOCABULARY).astype(float)
    unigram[attention.END] = len(ids)
    assert np.allclose(model.counts.sum(axis=1), unigram, rtol=1e-3)  # the experts share every target
    moved = (model.embedding != attention.begun(unigram).embedding).any(axis=1)
    assert moved[np.unique(np.concatenate(ids))].all() and moved.sum() < attention.VOCABULARY / 4
    again = lmscore.trained(docs, pieces)
    assert (again.embedding == model.embedding).all() and (again.counts == model.counts).all()


def test_pipeline(spark, tables, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark"):
        tables[name].write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4] <= counts[5]
    assert same(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32"), docs.select("doc_id", "piece", "ids_crc32").collect())


def test_quality_blocks_are_judged_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    from priorlens.llm import quality, textkernel as tk

    texts = ["Some words of plain prose, number %d. " % i * 40 for i in range(4000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    tk.powers(2)  # shared table, kept by the process
    tracemalloc.start()
    found = []
    for block in tk.blocks([batch], "text", quality.BLOCK):
        data, offsets = tk.text_bytes(block.column("text"))
        found.append(quality.votes(data, offsets))
        quality._features(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = quality.votes(*tk.text_bytes(batch.column("text")))
    assert sum(map(len, found)) == len(texts) and (sum(f.sum() for f in found) == whole.sum())
    assert peak < 80 << 20
