"""Licence scans with a positional index of rare tokens.

A first scan counts in how many documents each word of the licence templates stands,
over all documents. Words in at most ``COMMON`` of them are indexed, and of every
template its ``RAREST`` rarest words in any case, so a licence that stands in most
documents is found too. Wherever an indexed word stands in a file, each of its postings
``(template, position)`` votes for the place where the template would begin. A place
with ``VOTES`` agreeing positions (all of them, in templates with fewer indexed words)
is a candidate; it stands if the template's mandatory phrases lie whole within its
bounds, give or take ``SLACK`` words, and ``SHARE`` of the template's words align.

Fixed phrases give base labels besides; labels of the templates are added to them.
The score is the largest aligned share, at least ``MENTION`` if a base phrase stands.

Defined cases: a null or empty text has no words and no label; without documents the
result is empty; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk

COMMON, RAREST, VOTES, SLACK, SHARE, MENTION = 0.1, 6, 3, 3, 0.6, 0.5

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Openings of public licence texts as they are quoted, with the phrases that must stand whole.
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("mit", "released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ["free of charge to any person obtaining a copy", "to deal in the software without restriction"]),
    ("apache", "licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ["apache license version 2 0", "except in compliance with the license"]),
    ("gpl", "this work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc-by", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ["cc by nd 4 0"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
]

DIGEST = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


@dataclass
class Template:
    label: str
    words: list[int]
    phrases: list[list[int]]


class Index:
    """The licence vocabulary, the templates over it, and the postings of rare words."""

    def __init__(self) -> None:
        texts = [t for _, t, _ in TEMPLATES] + [p for _, _, more in TEMPLATES for p in more] + list(BASE)
        self.words = sorted({w for t in texts for w in _words(t)})
        number = {w: i + 1 for i, w in enumerate(self.words)}
        joined = np.frombuffer(" ".join(self.words).encode(), np.uint8)
        starts, ends, _ = tk.runs(tk.ALNUM[joined], np.array([0, len(joined)]))
        hashes = tk.span_hash(tk.prefix(joined), starts, ends)
        self._order = np.argsort(hashes)
        self._hashes = hashes[self._order]
        of = lambda text: [number[w] for w in _words(text)]
        self.templates = [Template(label, of(text), [of(p) for p in more]) for label, text, more in TEMPLATES]
        self.base = [(of(phrase), label) for phrase, label in BASE.items()]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for licence words, 0 for others."""
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        return np.where(self._hashes[at] == hashes, self._order[at] + 1, 0)

    def weigh(self, frequency: dict[int, int], n_docs: int) -> None:
        """Index the words that are rare by document frequency, and the rarest ones of each template."""
        limit = max(1, COMMON * n_docs)
        postings: list[list[tuple[int, int]]] = [[] for _ in range(len(self.words) + 1)]
        self.needed = []
        for t, template in enumerate(self.templates):
            rarest = sorted(set(template.words), key=lambda w: (frequency.get(w, 0), w))
            indexed = {w for i, w in enumerate(rarest) if i < RAREST or frequency.get(w, 0) <= limit}
            self.needed.append(min(VOTES, sum(w in indexed for w in template.words)))
            for at, word in enumerate(template.words):
                if word in indexed:
                    postings[word].append((t, at))
        self.n_postings = np.array([len(x) for x in postings])
        self.first_posting = np.cumsum(self.n_postings) - self.n_postings
        self.postings = np.array([x for of in postings for x in of], np.int64).reshape(-1, 2)

    def matches(self, numbers: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """Rows, labels and aligned shares of the templates that stand in the rows that ``first`` delimits."""
        at = np.flatnonzero(self.n_postings[numbers])
        n = self.n_postings[numbers[at]]
        template, place = self.postings[tk.expand(self.first_posting[numbers[at]], n)].T
        at = np.repeat(at, n)
        row = np.searchsorted(first, at, side="right") - 1
        longest = max(len(t.words) for t in self.templates)
        begin = at - place + longest  # a template may begin before its row
        votes, n = np.unique((row << 37) + (begin - first[row]) * len(self.templates) + template, return_counts=True)
        row, template = votes >> 37, (votes & ((1 << 37) - 1)) % len(self.templates)
        begin = (votes & ((1 << 37) - 1)) // len(self.templates) - longest + first[row]
        for t, (known, needed) in enumerate(zip(self.templates, self.needed, strict=True)):
            chosen = np.flatnonzero((template == t) & (n >= needed))
            low, high, start = first[row[chosen]], first[row[chosen] + 1], begin[chosen]
            aligned = np.zeros(len(chosen), np.int64)
            for i, word in enumerate(known.words):
                inside = (start + i >= low) & (start + i < high)
                aligned += inside & (numbers[np.clip(start + i, 0, len(numbers) - 1)] == word)
            for k in np.flatnonzero(aligned >= SHARE * len(known.words)).tolist():
                near = numbers[max(low[k], start[k] - SLACK) : min(high[k], start[k] + len(known.words) + SLACK)].tolist()
                if all(any(near[i : i + len(p)] == p for i in range(len(near) - len(p) + 1)) for p in known.phrases):
                    yield int(row[chosen[k]]), known.label, float(aligned[k] / len(known.words))


def _numbered(block: pa.RecordBatch, index: Index) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tk.text_bytes(block.column("text"))
    low = tk.LOWER[data]
    starts, ends, first = tk.runs(tk.ALNUM[low], offsets)
    return index.numbers(tk.span_hash(tk.prefix(low), starts, ends)), first


def document_frequencies(docs: DataFrame, index: Index) -> tuple[dict[int, int], int]:
    """Documents that hold each licence word, and documents; at most one row per licence word reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, seen = 0, np.zeros(len(index.words) + 1, np.int64)
        for block in tk.blocks(batches, "text"):
            numbers, first = _numbered(block, index)
            at = np.flatnonzero(numbers)
            pairs = np.unique(tk.row_of(first)[at] * (len(index.words) + 1) + numbers[at])
            seen += np.bincount(pairs % (len(index.words) + 1), minlength=len(seen))
            n_docs += block.num_rows
        seen[0] = n_docs
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"word": pa.array(held), "n": pa.array(seen[held])})

    rows = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts, counts.pop(0, 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, base phrases with their first and last place, labels, score."""
    source = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    index = Index()
    index.weigh(*document_frequencies(source.select("text"), index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, "text"):
            numbers, first = _numbered(block, index)
            row, n_rows = tk.row_of(first), block.num_rows
            n_base = np.zeros(n_rows, np.int64)
            low, high = np.full(n_rows, np.iinfo(np.int64).max), np.full(n_rows, -1)
            base: list[set[str]] = [set() for _ in range(n_rows)]
            for phrase, label in index.base:
                at = np.flatnonzero(numbers[: len(numbers) - len(phrase) + 1] == phrase[0]) if len(numbers) >= len(phrase) else np.empty(0, np.int64)
                for k, word in enumerate(phrase[1:], 1):
                    at = at[(numbers[at + k] == word) & (row[at + k] == row[at])]
                n_base += np.bincount(row[at], minlength=n_rows)
                place = at - first[row[at]]
                np.minimum.at(low, row[at], place)
                np.maximum.at(high, row[at], place)
                for r in np.unique(row[at]).tolist():
                    base[r].add(label)
            labels, score = [set(b) for b in base], [MENTION if b else 0.0 for b in base]
            for r, label, share in index.matches(numbers, first):
                labels[r].add(label)
                score[r] = max(score[r], share)
            none = n_base == 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": block.column("doc_id"), "n_words": pa.array(np.diff(first)), "n_base": pa.array(n_base), "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none),
                "base_labels": pa.array([",".join(sorted(b)) for b in base]), "labels": pa.array([",".join(sorted(x)) for x in labels]), "score": pa.array(score, pa.float64()),
            })

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {DIGEST}")
