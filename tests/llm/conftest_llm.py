"""Plain-Python helpers of these tests."""

import re
import zlib
from collections import Counter

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def same(frame, expected):
    """Whether a DataFrame holds just these rows, in any order and with repeats."""
    return Counter(map(tuple, frame.collect())) == Counter(map(tuple, expected))
