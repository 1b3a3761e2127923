"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

The model is serialised directly from the vocabulary: every token's bytes are written as
printable characters, one per byte, with the negative rank as score, and the normaliser is
the identity. sentencepiece then merges as the ranks say. Each pre-token is encoded on its
own; one that is a token itself keeps that id, as byte-level encoders do. Decoding
looks up the bytes of each id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.common import parts

#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 1 << 17
#: Characters of a text that are split into pre-tokens at once, four for each pre-token that waits.
STRETCH = 1 << 20
_UNKNOWN = "⁇"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from 256 up."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(data: bytes) -> list[bytes]:
    """The tokens of a rank file (base64, blank, rank a line), in rank order without gaps."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines()) if token}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol buffer field: whole number, 32-bit float or bytes."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; one more id stands for the unknown."""
    characters = byte_characters()
    pieces = [
        _field(1, _field(1, "".join(map(characters.__getitem__, token)).encode()) + _field(2, float(-rank)) + _field(3, 1))
        for rank, token in enumerate(tokens)
    ]
    unknown = _field(1, _field(1, _UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2))
    # Model type BPE (2), vocabulary size, the unknown's id and piece; no begin, end or padding.
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, none) for n in (41, 42, 43)) + _field(45, _UNKNOWN.encode())
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*pieces, unknown, _field(2, trainer), _field(3, normaliser)])


class _Encoder:
    """Encodes texts; remembers the packed ids of pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(tokens))
        self.split = regex.compile(pattern)
        self.whole = {token: struct.pack("<I", rank) for rank, token in enumerate(tokens)}
        self.characters = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = words
        merged = []
        for word in new:
            data = word.encode()
            ids = self.whole.get(data)
            if ids is None:
                merged.append((word, data.decode("latin-1").translate(self.characters)))
            else:
                self.known[word] = ids
        for (word, _), ids in zip(merged, self.model.encode([mapped for _, mapped in merged], out_type=int, num_threads=1)):
            self.known[word] = array("I", ids).tobytes()

    def _stretches(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of a bounded size."""
        if len(text) <= STRETCH:
            yield self.split.findall(text)
            return
        some: list[str] = []
        for match in self.split.finditer(text):
            some.append(match.group())
            if len(some) == STRETCH // 4:
                yield some
                some = []
        yield some

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text. Texts are taken together until they have many pre-tokens."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for words in self._stretches(text):
                waiting.append((i, words))
                size += len(words)
                if size >= STRETCH // 4:
                    self._flush(waiting, out)
                    waiting, size = [], 0
        self._flush(waiting, out)
        return [b"".join(parts) for parts in out]

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        self._learn(set().union(*(words for _, words in waiting)))
        for i, words in waiting:
            out[i].append(b"".join(map(self.known.__getitem__, words)))


def load_tokens(spark: SparkSession, path: str):
    """The rank file's tokens, shared with all tasks; its size is fixed by the vocabulary (about 1 MB)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(read_ranks(file.read()))


def encode(texts: DataFrame, tokens, pattern: str, column: str = "text", to: str = "ids") -> DataFrame:
    """``texts`` with the ids of ``column`` in ``to``: little-endian unsigned 32-bit, packed.

    A NULL text counts as empty. Only ``column`` is read; all columns stay, one named ``to`` is replaced.
    """
    return texts.mapInArrow(_encoding(tokens, pattern, column, to), _schema(texts, to))


def decode(encoded: DataFrame, tokens, column: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that the ids in ``column`` stand for, in ``to``."""
    return encoded.mapInArrow(_decoding(tokens, column, to), _schema(encoded, to))


def encode_and_decode(texts: DataFrame, tokens, pattern: str, column: str = "text", to: str = "ids", back: str = "decoded") -> DataFrame:
    """:func:`encode`, then :func:`decode` of its ids, by one Python worker a task instead of two."""
    first, then = _encoding(tokens, pattern, column, to), _decoding(tokens, to, back)
    return texts.mapInArrow(lambda batches: then(first(batches)), _schema(texts.withColumn(to, F.lit(None).cast("binary")), back))


def _encoding(tokens, pattern: str, column: str, to: str):
    held: list[_Encoder] = []

    def run(batches):
        if not held:
            held.append(_Encoder(tokens.value, pattern))
        for batch in batches:
            for part in parts(batch, column):
                ids = held[0].encode([t or "" for t in part.column(column).to_pylist()])
                yield _with(part, to, pa.array(ids, pa.binary()))

    return run


def _decoding(tokens, column: str, to: str):
    def run(batches):
        look = tokens.value.__getitem__
        for batch in batches:
            for part in parts(batch, column):
                packed = part.column(column).to_pylist()
                data = [b"".join(map(look, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in packed]
                yield _with(part, to, pa.array(data, pa.binary()))

    return run


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in batch.schema.names if n != name} | {name: values}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _schema(df: DataFrame, name: str):
    return df.drop(name).withColumn(name, F.lit(None).cast("binary")).schema


def n_tokens(column: str = "ids") -> Column:
    return (F.octet_length(column) / 4).cast("bigint")


def tokens_digest(tokens: list[bytes]) -> str:
    """Names a vocabulary, so that files of ids can say which one they are for."""
    return hashlib.sha256(b"".join(struct.pack("<I", len(t)) + t for t in tokens)).hexdigest()
