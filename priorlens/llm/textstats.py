"""Counts per text that several operators read: words, symbols, repeated lines and windows."""

from __future__ import annotations

import numpy as np

from . import textkernel as tk

REPEAT_WINDOW = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, by row."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=words[1:])
    full = words[ends] > words[starts]
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(offsets, starts, side="right") - 1
    key = tk.span_hash(sums, starts, ends) ^ tk.mix(row.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(key, return_index=True)
    n = len(offsets) - 1
    all_lines = np.bincount(row, minlength=n)
    return all_lines, all_lines - np.bincount(row[first], minlength=n)


def _repeated(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words inside a window of the row's words that the row holds twice or more."""
    n = len(hashes)
    if n < REPEAT_WINDOW:
        return np.zeros(n, bool)
    row = tk.row_of(first)
    at = np.arange(n - REPEAT_WINDOW + 1)
    at = at[row[at] == row[at + REPEAT_WINDOW - 1]]
    key = tk.span_hash(tk.prefix(hashes), at, at + REPEAT_WINDOW) ^ tk.mix(row[at].astype(np.uint64) + np.uint64(1))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, bool)
    found = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return tk.covered(at[twice[found] == key], REPEAT_WINDOW, n)


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row, words being runs of bytes that are not white space."""
    inside = tk.NOT_SPACE[data]
    starts, ends, first = tk.runs(inside, offsets)
    sums = tk.prefix(data)
    hashes = tk.span_hash(sums, starts, ends)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = hashes[1:] == hashes[:-1]
    echo[first[:-1][np.diff(first) > 0]] = False
    lines, dup_lines = _lines(data, offsets, inside, sums)
    return {
        "n_words": np.diff(first),
        "word_chars": tk.per_row(inside & tk.FIRST_BYTE[data], offsets),
        "n_symbols": tk.per_row(SYMBOL[data], offsets),
        "n_lines": lines,
        "n_dup_lines": dup_lines,
        "n_repeat_words": tk.per_row(_repeated(hashes, first), first),
        "n_echo_words": tk.per_row(echo, first),
    }
