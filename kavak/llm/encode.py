"""Encoding of a corpus with a byte-level BPE vocabulary through a sentencepiece model.

The model is written here, field by field, from the ranks of the vocabulary:
each entry's bytes mapped to printable letters are a piece, its score the
negative rank, so the best-scored merge is the lowest-ranked one; the
normaliser is the identity.  Pre-tokens are encoded one by one, equal
stretches of them once; decoding maps the letters back to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavak.llm.batches import mapped

#: Where the public vocabularies lie on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that cuts a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct stretches remembered in a worker before it starts anew.
REMEMBERED = 300_000


@lru_cache(1)
def byte_letters() -> str:
    """A printable letter for each byte: itself if it prints, else the next letter from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(spare)) for b in range(256))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks."""
    letters = byte_letters()
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("the ranks of a vocabulary must be 0, 1, 2 and so on")
    for piece, rank in by_rank:
        text = "".join(letters[b] for b in piece).encode()
        out += _bytes(1, _bytes(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, normal))
    # sentencepiece demands a piece for the unknown; every byte has a piece, so it is never given
    out += _bytes(1, _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown))
    size = len(by_rank) + 1
    out += _bytes(2, _number(3, bpe) + _number(4, size) + _number(40, size - 1) + b"".join(_number(f, -1) for f in (41, 42, 43)))
    out += _bytes(3, _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


#: Finds a space beside other white space.
_SPACES = re.compile(r" \s|\s |^ ").search


class _Places(dict):
    """A number for each string, in the order of first use; ``new`` has those not yet learned."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Encoder:
    """Encodes and decodes texts; remembers the ids of short stretches of text."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import sentencepiece

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(PATTERN).findall
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.bytes = {c: b for b, c in self.letters.items()}
        self.pieces = [p for p, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        self.flat = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.many = np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """The ids of chunks seen for the first time: of their pre-tokens, one after the other."""
        tokens = [self.split(c) for c in chunks]
        spelled = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for x in tokens for t in x]
        ids = self.model.encode(spelled, num_threads=1)
        sums = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
        ends = sums[np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))]
        many = np.diff(ends, prepend=0)
        self.first = np.concatenate((self.first, len(self.flat) + ends - many))
        self.many = np.concatenate((self.many, many))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sums[-1]))))

    def chunks(self, text: str | None) -> list[str]:
        """The text cut before single spaces between other characters: there a pre-token always begins."""
        if not text:
            return []
        if "\0" in text or _SPACES(text):
            return self.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in one array, where each text's ids begin and, last, end); none for null and empty."""
        if len(self.place) > REMEMBERED:
            self._forget()
        chunks = [self.chunks(t) for t in texts]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        which = np.fromiter(map(self.place.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts.sum()))
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        many = self.many[which]
        ends = np.cumsum(many)
        ids = self.flat[np.repeat(self.first[which] - (ends - many), many) + np.arange(int(many.sum()))]
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, through the model's letters."""
        letters = "".join(self.model.id_to_piece(list(ids)))
        return bytes(self.bytes[c] for c in letters).decode("utf-8", "surrogatepass")


@lru_cache(2)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def encode(documents: DataFrame, id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, ids array<int>)`` of each row; an empty array for an empty and for a null text.

    Special tokens are never made: their strings are ordinary text.  Repeated
    rows repeat; an empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = _encoder(vocabulary).encode(batch.column(1).to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(mapped("text", work), f"id {kind}, ids array<int>").withColumnRenamed("id", id)
