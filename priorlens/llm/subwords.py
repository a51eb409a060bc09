"""Subword ids of whole texts by a public tokenizer, computed once per distinct word.

The tokenizer drops white space and never merges across it, so a text's ids are those
of its words between ASCII white space in order. Words of printable ASCII and of accented
Latin letters, which normalisation leaves alone, are cut by the tokenizer's own pattern
and looked up in its model; others go through the tokenizer whole. A text with a special
token's mark or a separator control, on which the two notions of white space differ, goes
through the tokenizer uncut. Caches are emptied when full, which bounds memory and
changes no result.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from . import textkernel as tk

CACHED_WORDS, CACHED_PIECES = 600_000, 600_000
# Letters of every Unicode version, composed, without the one whose lower case is two characters.
_PLAIN = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017F]+").fullmatch
_ODD = re.compile(r"<\||[\x1c-\x1f]")
# Fixed value: the tokenizer's own pattern, for words of ``_PLAIN`` in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u017F]+|[0-9]|[^\sa-z0-9\u00DF-\u017F]+").findall


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level models spell bytes: printable ones stand for themselves, others follow from 256 on."""
    spare = iter(range(256, 512))
    return {b: b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(spare) for b in range(256)}


_SPELLED = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that match ``_ODD``."""
    row = lambda at: np.searchsorted(offsets, at, side="right") - 1
    mark = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    control = np.flatnonzero((data >= 0x1C) & (data <= 0x1F))
    return np.union1d(row(mark[row(mark) == row(mark + 1)]), row(control))


class Subwords:
    """Texts to little-endian 32-bit ids; loads its file on first use, so it travels light."""

    def __init__(self, path: str | None = None, words: int = CACHED_WORDS, pieces: int = CACHED_PIECES) -> None:
        self.path, self.most_words, self.most_pieces = path, words, pieces
        self._loaded = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None, "_model": None, "_words": {}, "_pieces": {}}

    def _load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self._loaded = Tokenizer.from_file(self.path or default_path())
        self._model = self._loaded.model
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._loaded.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SPELLED)
        ids = array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()
        if len(self._pieces) >= self.most_pieces:
            self._pieces.clear()
        self._pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        known = self._pieces.get
        body, last = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
        if body.isalpha() and body.isascii():  # by far the most: one run of letters, perhaps with a stop
            low = body.lower()
            ids = known(low) or self._piece(low)
            if last:
                ids += known(last) or self._piece(last)
        elif _PLAIN(word):
            ids = b"".join([known(p) or self._piece(p) for p in _PIECES(word.lower())])
        else:
            ids = self._whole(word)
        if len(self._words) >= self.most_words:
            self._words.clear()
        self._words[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, four bytes each; none for a null text."""
        if self._loaded is None:
            self._load()
        if not text:
            return b""
        if _ODD.search(text):
            return self._whole(text)
        known = self._words.get
        return b"".join([known(w) or self._word(w) for w in text.split()])

    def encode_rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the rows' offsets; each distinct word is looked up once."""
        if self._loaded is None:
            self._load()
        data, offsets = tk.text_bytes(column)
        raw, inside, odd = data.tobytes(), tk.NOT_SPACE[data], _odd_rows(data, offsets)
        for r in odd.tolist():
            inside[offsets[r] : offsets[r + 1]] = False
        starts, ends, first = tk.runs(inside, offsets)
        _, at, words = np.unique(tk.span_hash(tk.prefix(data), starts, ends), return_index=True, return_inverse=True)
        known = self._words.get
        ids = [known(w) or self._word(w) for w in (raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True))]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        out = np.frombuffer(b"".join(ids), "<u4")[tk.expand((np.cumsum(sizes) - sizes)[words], sizes[words])]
        bounds = np.concatenate([[0], np.cumsum(sizes[words])])[first]
        if len(odd):
            whole = [np.frombuffer(self._whole(raw[offsets[r] : offsets[r + 1]].decode()), "<u4") for r in odd.tolist()]
            more = np.zeros(len(bounds), np.int64)
            more[odd + 1] = [len(x) for x in whole]
            out = np.insert(out, np.repeat(bounds[odd], more[odd + 1]), np.concatenate(whole))
            bounds = bounds + np.cumsum(more)
        return out, bounds
