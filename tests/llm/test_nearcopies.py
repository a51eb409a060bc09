"""One document of each group of near copies, against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from conftest_llm import SPACED, lower

from priorlens.llm import nearcopies, textkernel as tk


def shingle_set(text):
    words = SPACED.findall(lower(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def groups(rows):
    """Rows by group: all pairs of different shingle sets at 0.8 or more."""
    members = defaultdict(list)
    for at, (_, text) in enumerate(rows):
        members[shingle_set(text)].append(at)
    sets, parent = list(members), {}

    def root(x):
        while x in parent:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b) and root(a) != root(b):
                parent[root(a)] = root(b)
    out = defaultdict(list)
    for s in sets:
        out[root(s)] += members[s]
    return list(out.values())


def edited(words, rng, times):
    out = list(words)
    for at in rng.sample(range(len(out)), times):
        out[at] = f"other{rng.random()}"
    return " ".join(out)


def planted(rng, n=60):
    """Texts of 100 words, each with copies that differ in one to three words."""
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(100)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, "  ".join(words).upper()), *((10 * i + 1 + k, edited(words, rng, k)) for k in (1, 2, 3))]
    return rows


def test_shingles_and_fingerprints():
    texts = ["A b c D e", "a  B\tc d E", "a b c d e f", "one", "", None, "x " * 9]
    hashes, bounds = nearcopies.shingles(*tk.text_bytes(pa.array(texts, pa.string())))
    assert np.diff(bounds).tolist() == [1, 1, 2, 1, 0, 0, 5]
    assert hashes[0] == hashes[1] == hashes[2] and len(set(hashes.tolist())) == 4
    prints = nearcopies.fingerprints(hashes, bounds)
    assert (prints[0] == prints[1]).all() and not prints[4].any() and not prints[5].any() and prints[3].any()


def test_bits_differ_by_dissimilarity():
    """At similarity s, bits of two texts differ with (1 - s) / 2."""
    rng = random.Random(3)
    words = [f"w{rng.random()}" for _ in range(900)]
    texts = [" ".join(words), " ".join(words[:800]), " ".join(words[:450])]
    prints = nearcopies.fingerprints(*nearcopies.shingles(*tk.text_bytes(pa.array(texts))))
    differ = [sum((int(x) ^ int(y)).bit_count() for x, y in zip(prints[0], p)) / 128 for p in prints]
    assert differ[0] == 0 and 0.01 < differ[1] < 0.12 and 0.15 < differ[2] < 0.35


def test_portions_do_not_change_fingerprints(monkeypatch):
    rng = random.Random(4)
    column = pa.array([None if k % 7 == 0 else " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(40))) for k in range(80)], pa.string())
    found = nearcopies.shingles(*tk.text_bytes(column))
    whole = nearcopies.fingerprints(*found)
    monkeypatch.setattr(nearcopies, "PORTION", 10)
    assert (nearcopies.fingerprints(*found) == whole).all()


def test_near_copies(spark, tmp_path):
    rows = planted(random.Random(5))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    kept = {r.doc_id for r in nearcopies.keep_one_of_near_copies(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    expected = {min(rows[i][0] for i in g) for g in groups(rows)}
    assert expected <= kept and len(kept - expected) <= 0.1 * (len(rows) - len(expected))


def test_given_documents(stored, empty):
    docs, rows = stored
    found = nearcopies.keep_one_of_near_copies(docs)
    assert found.columns == docs.columns
    kept = found.count()
    parts = groups(rows)
    assert len(parts) <= kept <= len(parts) + 0.1 * (len(rows) - len(parts))
    assert nearcopies.keep_one_of_near_copies(empty).count() == 0


def test_large_group_and_names(spark, tmp_path):
    """Most rows near copies of one text, some without text, helper names taken, the id column quoted."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    rows = [(5, 1_000 + k, 5, edited(words, rng, 1)) for k in range(300)]
    rows += [(6, k, 6, None if k % 2 else " ") for k in range(20)] + [(7, None, 7, "text without an id here now"), (8, 7_000, 8, "quite another text of some words")]
    spark.createDataFrame(rows, "_place int, `doc.id` long, KEY int, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    kept = nearcopies.keep_one_of_near_copies(spark.read.parquet(str(tmp_path / "docs")), "doc.id")
    assert kept.columns == ["_place", "doc.id", "KEY", "text"]
    found = sorted((r[0], -1 if r[1] is None else r[1]) for r in kept.collect())
    assert (5, 1_000) in found and (6, 0) in found and (7, -1) in found and (8, 7_000) in found
    assert len(found) <= 6


def test_no_pair_at_the_threshold_is_lost(spark, tmp_path):
    """Pairs of similarity 0.80 to 0.85, which few bits let meet; frequent shingles in most texts; the sets against all pairs."""
    rng = random.Random(12)
    common = [[f"c{k}x{j}" for j in range(12)] for k in range(6)]
    rows = []
    for i in range(150):
        words = [f"w{rng.random()}" for _ in range(rng.choice([12, 40, 120]))]
        words += [w for part in rng.sample(common, 3) for w in part]
        cut = max(1, round(len(words) / 9))
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words[cut:])), (10 * i + 2, " ".join([*words[cut:], *(f"n{rng.random()}" for _ in range(cut))]))]
    rows += [(9_000 + i, " ".join(f"s{k}" for k in range(i))) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    kept = sorted(r.doc_id for r in nearcopies.keep_one_of_near_copies(spark.read.parquet(str(tmp_path / "docs"))).collect())
    assert kept == sorted(min(rows[i][0] for i in g) for g in groups(rows))


def test_order_of_shingles_changes_no_link(spark, tmp_path, monkeypatch):
    rows = planted(random.Random(13), 12)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    expected = {min(rows[i][0] for i in g) for g in groups(rows)}
    for frequent, latest in ((0, 3), (0, 1 << 20), (8, 1 << 20)):
        monkeypatch.setattr(nearcopies, "FREQUENT", frequent)
        monkeypatch.setattr(nearcopies, "LATEST", latest)
        assert {r.doc_id for r in nearcopies.keep_one_of_near_copies(docs).collect()} == expected
