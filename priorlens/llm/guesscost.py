"""How many guesses a password takes: the cheapest way to segment it.

``log_guesses`` is a dynamic programme over prefixes: a value is cut into words,
dates, repeats, keyboard walks and brute-force spans, and the sum of the parts' log10
guess counts is least over all segmentations. Words are at most ``LONGEST`` characters
long; repeats and walks have any length and may begin anywhere in their run.
"""

from __future__ import annotations

import math
import re

LONGEST, LONGEST_DATE, LEAST_RUN = 24, 10, 3
PERIODS = range(2, 9)

# Common password words, in rough order of use.
COMMON_WORDS = (
    "password passwd pass admin root user login welcome letmein master secret test guest hello dragon monkey sunshine princess football baseball "
    "shadow superman batman michael jordan hunter killer trustno love iloveyou changeme change default example sample dummy placeholder your token key "
    "api access private public server system temp demo dev prod data base mysql oracle postgres none null true false redacted secure security"
).split()
# Rows of the usual keyboards.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb")
# Characters that stand for letters.
LEET = str.maketrans("0134579@$!", "oleastgasi")

_STEPS = {(a, b) for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)")
_LOG_DATE, _LOG_WALK = math.log10(365 * 130), math.log10(40 * 4)
_CLASSES = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))


def _alphabet(value: str) -> float:
    size = sum(n for test, n in _CLASSES if any(test(c) for c in value)) + 33 * any(not c.isalnum() for c in value)
    if re.fullmatch("[0-9a-f]+", value):
        size = 16 if re.search("[a-f]", value) else 10
    return math.log10(max(size, 2))


def lexicon(counted: dict[str, int] | None = None) -> dict[str, float]:
    """Words with the log10 of their rank: the fixed list first, then words of the corpus by count."""
    words = list(dict.fromkeys([*COMMON_WORDS, *sorted(counted or {}, key=lambda w: (-counted[w], w))]))
    return {w: math.log10(i + 2) for i, w in enumerate(words)}


class _Starts:
    """Where a part that grows with the value may begin, for the least of ``best[start] + log10(units)``.

    A later start has fewer units, so it displaces earlier ones that are no cheaper; the
    earlier gains as the part grows, so a later one that has fallen behind stays behind.
    """

    def __init__(self) -> None:
        self.held: list[tuple[int, float]] = []

    def least(self, end: int, unit: int) -> float:
        cost, ahead = math.inf, []
        for start, before in self.held:
            now = before + math.log10((end - start) // unit)
            if now < cost:
                cost = now
                ahead.append((start, before))
        self.held = ahead
        return cost

    def add(self, start: int, before: float) -> None:
        while self.held and self.held[-1][1] >= before:
            self.held.pop()
        self.held.append((start, before))


def _dates(value: str) -> dict[int, list[int]]:
    """Starts of all dates by their ends, the shorter of two readings too."""
    out: dict[int, list[int]] = {}
    for i in range(len(value)):
        if value[i].isdigit():
            for end in range(i + 4, min(i + LONGEST_DATE, len(value)) + 1):
                if _DATE.fullmatch(value, i, end):
                    out.setdefault(end, []).append(i)
    return out


def log_guesses(value: str, words: dict[str, float]) -> float:
    """log10 of the guesses that the cheapest segmentation needs; 0 for an empty value."""
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    plain = low.translate(LEET)
    per_char = _alphabet(value)
    dates = _dates(value)
    same, walk = 1, 1  # lengths of the run of equal characters, and of the keyboard walk, that end here
    same_starts, walk_starts = _Starts(), _Starts()
    echo = dict.fromkeys(PERIODS, 0)  # how long the value has equalled itself so many places before
    echo_starts = {p: [_Starts() for _ in range(p)] for p in PERIODS}
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        cost = best[j - 1] + per_char
        for i in range(max(0, j - LONGEST), j - 1):
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.3)):
                if form in words:
                    case = 0.0 if value[i:j].islower() or not value[i:j].isalpha() else 0.3
                    cost = min(cost, best[i] + words[form] + extra + case)
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + _LOG_DATE)
        same = same + 1 if j > 1 and value[j - 1] == value[j - 2] else 1
        walk = walk + 1 if j > 1 and (low[j - 2], low[j - 1]) in _STEPS else 1
        if same == 1:
            same_starts = _Starts()
        elif same >= LEAST_RUN:
            same_starts.add(j - LEAST_RUN, best[j - LEAST_RUN])
            cost = min(cost, per_char + same_starts.least(j, 1))
        if walk == 1:
            walk_starts = _Starts()
        elif walk >= LEAST_RUN:
            walk_starts.add(j - LEAST_RUN, best[j - LEAST_RUN])
            cost = min(cost, _LOG_WALK + walk_starts.least(j, 1))
        for period in PERIODS:  # a block said again and again
            if j > period and value[j - 1] == value[j - 1 - period]:
                echo[period] += 1
            elif echo[period]:
                echo[period], echo_starts[period] = 0, [_Starts() for _ in range(period)]
            if echo[period] >= period:
                starts = echo_starts[period][j % period]
                starts.add(j - 2 * period, best[j - 2 * period])
                cost = min(cost, period * per_char + starts.least(j, period))
        best[j] = cost
    return best[n]
