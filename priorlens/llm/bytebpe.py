"""Byte-level BPE: texts to ids and back, by a model written straight from a rank file.

The file lists byte strings by rank. Each becomes a sentencepiece BPE piece, spelled
with one printable letter a byte and scored by its negative rank, so the best-scored
merge is the lowest-ranked one; normalisation is the identity. A text is split by the
pattern, each distinct match is encoded once a block by that model, and decoding maps
pieces back to bytes. A match that is itself in the file is one id, as rank encoders
have it. Nothing is shuffled; the file is read on the executors by its path.

A null text reads as empty and gives no ids; null ids decode to no bytes. Repeated rows
give repeated rows. Only the named columns are read, so others cannot clash. Memory
follows the block of a few MB, or one longer text, whose matches are taken in portions.
"""

from __future__ import annotations

import base64
import itertools
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import textkernel as tk
from .subwords import _SPELLED

BLOCK_BYTES = 1 << 20
PORTION = 100_000  # matches that are held as strings at once
LONG = 1 << 20  # characters from which a text's matches are taken one by one
DECODED_ROWS = 1000
CACHED = 400_000  # matches whose ids are kept; emptied when full, which changes no result
OTHER = chr(0xE000)  # a character that is no letter, number or space in any version


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Byte strings and ranks of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return sorted(((base64.b64decode(token), int(rank)) for token, rank in pairs), key=lambda x: x[1])


def spelled(token: bytes) -> str:
    """One letter a byte."""
    return token.decode("latin-1").translate(_SPELLED)


_SPELLED_LAST = spelled(b"\xff")


def _field(number: int, payload: bytes) -> bytes:
    """A length-delimited protocol-buffer field."""
    return bytes([number << 3 | 2]) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece ``i`` is ``tokens[i]``, of score ``-i``; the unknown piece comes last.

    Field numbers are those of the public model format: pieces (text, score, kind), trainer
    settings (kind of model: BPE) and normaliser settings (no dummy prefix, spaces kept).
    """
    pieces = [_field(1, _field(1, spelled(t).encode()) + b"\x15" + struct.pack("<f", -i)) for i, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _flag(3, 2))
    trainer = _field(2, _flag(3, 2) + _flag(40, len(tokens)))
    normaliser = _field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))
    return b"".join([*pieces, unknown, trainer, normaliser])


def _differing(pattern: str) -> str:
    """Characters that this Python's pattern library calls letters or numbers and the rank encoder's does not.

    Their Unicode versions differ; the encoder itself is asked, once a process.
    """
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    out = set()
    for kind in (k for k in (r"\p{L}", r"\p{N}", r"\s") if k in pattern):
        asked = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out |= set(regex.findall(kind, every)) ^ set(bytes(asked.encode_ordinary(every)).decode())
    return "".join(out)


class Codec:
    """Encoder and decoder of one rank file; loads it on first use, so it travels light."""

    def __init__(self, path: str | None = None, pattern: str | None = None, cached: int = CACHED, portion: int = PORTION) -> None:
        self.path, self.pattern, self.cached, self.portion = path, pattern, cached, portion
        self._model = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"_model": None}

    def _load(self) -> None:
        import sentencepiece

        ranks = read_ranks(self.path or default_path())
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model([t for t, _ in ranks]))
        self._rank = np.array([r for _, r in ranks], np.int64)
        self._even = bool((self._rank == np.arange(len(ranks))).all())  # pieces' numbers are the ranks
        self._whole = {spelled(t): array("i", [r]).tobytes() for t, r in ranks}
        letters = {letter: byte for byte, letter in _SPELLED.items()}
        back = [self._model.id_to_piece(i).translate(letters).encode("latin-1") for i in range(len(ranks))]
        sizes = np.zeros(int(self._rank[-1]) + 2, np.int64)
        sizes[self._rank + 1] = [len(b) for b in back]
        self._bytes, self._at = np.frombuffer(b"".join(back), np.uint8), np.cumsum(sizes)
        self._split = regex.compile(self.pattern or default_pattern())
        self._known: dict[str, bytes] = {}
        self._odd = None

    def matches(self, text: str) -> Iterable[str]:
        """The pattern's matches, as the rank encoder's Unicode version has them."""
        if not text.isascii():
            if self._odd is None:
                self._plain = dict.fromkeys(map(ord, _differing(self._split.pattern)), OTHER)
                self._odd = np.zeros(0x110000, bool)
                self._odd[list(self._plain)] = True
            if self._odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
                return (text[m.start() : m.end()] for m in self._split.finditer(text.translate(self._plain)))
        if len(text) < LONG:
            return self._split.findall(text)
        return (m.group() for m in self._split.finditer(text))

    def _learn(self, words: set[str]) -> None:
        if len(self._known) + len(words) > self.cached:
            self._known.clear()
        words = list(words - self._known.keys())
        if not words:
            return
        # one translation for all; a byte that no text holds stands between them
        letters = spelled(b"\xff".join([w.encode() for w in words])).split(_SPELLED_LAST)
        whole = self._whole.get
        ask = []
        for word, spelling in zip(words, letters, strict=True):
            ids = whole(spelling)
            if ids is None:
                ask.append((word, spelling))
            else:
                self._known[word] = ids
        for (word, _), ids in zip(ask, self._model.encode([x for _, x in ask], num_threads=1), strict=True):
            self._known[word] = array("i", ids if self._even else self._rank[ids].tolist()).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        if self._model is None:
            self._load()
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def settle() -> None:
            self._learn(set().union(*(words for _, words in waiting)))
            ids = self._known.__getitem__
            for row, words in waiting:
                out[row].append(b"".join(map(ids, words)))
            waiting.clear()

        for row, text in enumerate(texts):
            found = iter(self.matches(text or ""))
            while words := list(itertools.islice(found, self.portion)):
                waiting.append((row, words))
                held += len(words)
                if held >= self.portion:
                    settle()
                    held = 0
        settle()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows end to end, and the rows' offsets."""
        if self._model is None:
            self._load()
        sizes = self._at[ids + 1] - self._at[ids]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return self._bytes[tk.expand(self._at[ids], sizes)], bounds[offsets]


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", codec: Codec | None = None, decoded: bool = False) -> DataFrame:
    """Per row: id and ``ids``, an array of ints; with ``decoded`` also the bytes that these ids decode to.

    Decoding in the same pass saves a second Python process a core and its model.
    """
    codec = codec or Codec()
    fields = [StructField(doc_id, docs.schema[doc_id].dataType), StructField("ids", ArrayType(IntegerType()))]
    schema = StructType([*fields, StructField("decoded", BinaryType())] if decoded else fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.blocks(batches, "text", BLOCK_BYTES):
            lists = _lists(codec.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *([_decoded(lists, codec)] if decoded else [])], names=schema.names)

    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(rows, schema)


def _decoded(lists: pa.ListArray, codec: Codec) -> pa.Array:
    """The bytes of every list of ids; none for a null list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    data, bounds = codec.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data.tobytes())])


def decode_ids(rows: DataFrame, ids: str = "ids", decoded: str = "decoded", codec: Codec | None = None) -> DataFrame:
    """The rows with a further column ``decoded``, the bytes of ``ids``; the name must be free."""
    codec = codec or Codec()
    if decoded in rows.columns:
        raise ValueError(f"column {decoded} is there already")
    at, names = rows.columns.index(ids), [*rows.columns, decoded]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(start, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(at), codec)], names=names)

    return rows.mapInArrow(decode, StructType([*rows.schema.fields, StructField(decoded, BinaryType())]))
