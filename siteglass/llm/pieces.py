"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut into words between which no piece of the vocabulary reaches. The characters of many
words lie in one flat array of symbols. A round finds the least rank among the neighbouring pairs of each
word, merges all pairs of that rank from the left on, closes the gaps and looks up the new neighbours; words
without a pair leave, until none is left. Characters without a piece become byte pieces. Decoding
joins what the pieces say.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.common import parts

#: Words whose ids a worker remembers.
REMEMBERED = 1 << 17
#: Characters of a text that are cut into words at once, four for each word that waits.
STRETCH = 1 << 20
#: Ids that are decoded at once.
DECODED = 1 << 18
#: Words of more characters are merged by a queue of pairs: rounds over them would be quadratic.
LONG = 256
_SPACE = "▁"
# Kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NONE = np.iinfo(np.int32).max


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with their scores and kinds."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]

    @property
    def byte_ids(self) -> np.ndarray:
        """The id of each byte's piece; that of the unknown piece where the vocabulary has no byte pieces."""
        unknown = self.kinds.index(_UNKNOWN)
        known = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        return np.array([known.get(f"<0x{b:02X}>", unknown) for b in range(256)], dtype=np.uint32)


def read_model(data: bytes) -> Vocabulary:
    """The vocabulary of a model file. Refused are models of another type than BPE, with rules that change
    the text (but for blanks), without a blank put in front, or with user-defined or unused pieces."""
    found = Vocabulary([], [], [])
    trainer: dict[int, int | bytes] = {}
    normaliser: dict[int, int | bytes] = {}
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0), 3: _NORMAL} | dict(_fields(value))
            found.pieces.append(piece[1].decode())
            found.scores.append(struct.unpack("<f", piece[2])[0])
            found.kinds.append(piece[3])
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    # Fields of the file format: type 3 (2: BPE), blanks as suffix 24; rules 2, blank in front 3, fewer blanks 4, blanks as signs 5.
    plain = trainer.get(3) == 2 and not trainer.get(24, 0) and not normaliser.get(2, b"")
    if not plain or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise ValueError("only BPE models that keep the text and put a blank in front of it can be read")
    if set(found.kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or found.kinds.count(_UNKNOWN) != 1:
        raise ValueError("the model has pieces of a kind that can't be read")
    return found


class Encoder:
    """Encodes texts; remembers the packed ids of words."""

    def __init__(self, vocabulary: Vocabulary, long: int = LONG):
        self.long = long
        normal = {p: i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds)) if k == _NORMAL}
        self.size = len(vocabulary.pieces)
        self.bytes_ = vocabulary.byte_ids
        self.unknown = vocabulary.kinds.index(_UNKNOWN)
        self.fallback = _BYTE in vocabulary.kinds
        # Symbols: normal pieces under their ids, then characters that only occur inside pieces.
        characters = sorted(set("".join(normal)) - set(normal))
        symbols = normal | {c: self.size + i for i, c in enumerate(characters)}
        self.bare = dict(enumerate(characters, self.size))
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        for c in set("".join(normal)):
            self.symbol[ord(c)] = symbols[c]
        _, dense = np.unique(-np.array(vocabulary.scores), return_inverse=True)
        self.rank = dense.astype(np.int32)
        table = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    table[left << 32 | right] = i
        self.pairs = table
        self._lay(np.array(list(table), dtype=np.int64), np.array(list(table.values()), dtype=np.int32))
        # Pieces that may be taken up at once by a pair of the same or a better rank, or share their rank:
        # of these, only the leftmost pair of a word is merged in a round.
        alone = np.zeros(self.size, dtype=bool)
        for key, i in table.items():
            for part in (key >> 32, key & 0xFFFFFFFF):
                if part < self.size and self.rank[i] <= self.rank[part]:
                    alone[part] = True
        ids = np.array(sorted(normal.values()), dtype=np.int64)
        shared = np.bincount(self.rank[ids], minlength=len(self.rank)) > 1
        alone[ids] |= shared[self.rank[ids]]
        self.alone = alone
        self.split = _splitter(normal)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _lay(self, keys: np.ndarray, made: np.ndarray) -> None:
        """The pairs as an open table: a pair stands in the first free slot from its own on."""
        self.bits = max(4, int(len(keys)).bit_length() + 3)
        self.keys, self.made = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            now = free[first]
            self.keys[at[now]], self.made[at[now]] = keys[now], made[now]
            left = np.ones(len(keys), dtype=bool)
            left[now] = False
            keys, made, at = keys[left], made[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        out = np.full(len(left), -1, dtype=np.int32)
        rest = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[rest].astype(np.int64) << 32 | right[rest]
        at = self._slot(key)
        while len(rest):
            held = self.keys[at]
            hit = held == key
            out[rest[hit]] = self.made[at[hit]]
            go = ~hit & (held >= 0)
            rest, key, at = rest[go], key[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _ranks(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank[made], _NONE)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each word (a missing character as its code point, turned negative) and the
        word they belong to, in order."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int32)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [*map(len, words)])
        symbol = self.symbol[points]
        symbol = np.where(symbol < 0, -1 - points, symbol)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.full(len(symbol), -1, dtype=np.int32)  # what a symbol makes with the next one
        near = np.flatnonzero(owner[1:] == owner[:-1])
        pair[near] = self._look_up(symbol[near], symbol[near + 1])
        rank = self._ranks(pair)
        while len(symbol):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            live = np.repeat(least < _NONE, sizes)
            if not live.all():
                done.append((symbol[~live], owner[~live]))
                symbol, owner, pair, rank = (x[live] for x in (symbol, owner, pair, rank))
                least, sizes = least[least < _NONE], sizes[least < _NONE]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # Of neighbouring pairs that overlap, every other one from the left.
            gap = np.append(True, np.diff(hit) != 1)
            turn = np.arange(len(hit)) - np.maximum.accumulate(np.where(gap, np.arange(len(hit)), 0))
            hit = hit[turn % 2 == 0]
            later = np.append(False, owner[hit[1:]] == owner[hit[:-1]])
            first = np.maximum.accumulate(np.where(later, 0, np.arange(len(hit))))
            hit = hit[~(later & self.alone[pair[hit[first]]])]
            symbol[hit] = pair[hit]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            new = (np.cumsum(keep) - 1)[hit]
            symbol, owner, pair, rank = (x[keep] for x in (symbol, owner, pair, rank))
            touched = np.zeros(len(symbol), dtype=bool)
            touched[new] = touched[np.maximum(new - 1, 0)] = True
            changed = np.flatnonzero(touched)
            inner = changed + 1 < len(symbol)
            inner[inner] = owner[changed[inner]] == owner[changed[inner] + 1]
            pair[changed] = -1
            near = changed[inner]
            pair[near] = self._look_up(symbol[near], symbol[near + 1])
            rank[changed] = self._ranks(pair[changed])
        symbols, owners = map(np.concatenate, zip(*done)) if done else (np.empty(0, np.int32),) * 2
        order = np.argsort(owners, kind="stable")
        return symbols[order], owners[order]

    def _queued(self, word: str) -> list[int]:
        """The symbols left of one long word: pairs from a queue, best rank first, then leftmost."""
        points = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        found = self.symbol[points]
        symbol = np.where(found < 0, -1 - points, found).tolist()
        after = [*range(1, len(symbol)), -1]
        before = [*range(-1, len(symbol) - 1)]
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and symbol[i] >= 0 and symbol[j] >= 0 and (piece := self.pairs.get(symbol[i] << 32 | symbol[j])) is not None:
                heapq.heappush(queue, (int(self.rank[piece]), i, symbol[i], symbol[j]))

        for i in range(len(symbol) - 1):
            offer(i)
        gone = [False] * len(symbol)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j < 0 or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i] = self.pairs[left << 32 | right]
            gone[j] = True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, g in zip(symbol, gone) if not g]

    def _packed(self, symbols: np.ndarray) -> bytes:
        if ((symbols >= 0) & (symbols < self.size)).all():
            return symbols.astype("<u4").tobytes()
        spelt = (np.array([s], np.uint32) if 0 <= s < self.size else self.bytes_[list((self.bare[s] if s >= 0 else chr(-1 - s)).encode())] for s in symbols.tolist())
        return np.concatenate(list(spelt)).astype("<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Ids of all ``words`` into ``known``. When that is full it becomes ``older``, from which words in use come back."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED // 2:
            self.older, self.known, new = self.known, {}, words
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        new = new.difference(again)
        short = [w for w in new if len(w) <= self.long]
        if short:
            symbols, owners = self.merged(short)
            edges = np.searchsorted(owners, np.arange(len(short) + 1)).tolist()
            data = symbols.astype("<u4").tobytes()
            self.known.update((w, data[4 * a : 4 * b]) for w, a, b in zip(short, edges, edges[1:]))
            for i in np.unique(owners[(symbols < 0) | (symbols >= self.size)]).tolist():
                self.known[short[i]] = self._packed(symbols[edges[i] : edges[i + 1]])
        for word in new:
            if len(word) > self.long:
                self.known[word] = self._packed(np.array(self._queued(word), dtype=np.int64))

    def _stretches(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in lists of a bounded size."""
        text = _SPACE + text.replace(" ", _SPACE) if text else ""
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
        """The packed ids of each text. Texts are taken together until they have many words."""
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
        packed = [b"".join(some) for some in out]
        return packed if self.fallback else [self._one_unknown(p) for p in packed]

    def _one_unknown(self, packed: bytes) -> bytes:
        """Neighbouring unknown characters share one id."""
        ids = np.frombuffer(packed, dtype="<u4")
        again = np.append(False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown))[: len(ids)]
        return ids[~again].tobytes()

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        self._learn(set().union(*(words for _, words in waiting)))
        for i, words in waiting:
            out[i].append(b"".join(map(self.known.__getitem__, words)))


def _splitter(pieces: dict[str, int]) -> re.Pattern[str]:
    """Cuts a text where no piece reaches across: around control characters that no piece holds and,
    if no piece holds a blank after another character, before blanks."""
    inside = set("".join(pieces))
    apart = "".join(re.escape(c) for c in map(chr, range(32)) if c not in inside)
    alone = f"|[{apart}]" if apart else ""
    if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
        return re.compile(f"[^{apart}]+{alone}" if apart else r"(?s).+")
    return re.compile(f"{_SPACE}*[^{_SPACE}{apart}]+|{_SPACE}+{alone}")


class Decoder:
    """Texts of ids."""

    def __init__(self, vocabulary: Vocabulary):
        said = {_NORMAL: lambda p: p.replace(_SPACE, " ").encode(), _UNKNOWN: lambda p: " ⁇ ".encode(), _CONTROL: lambda p: b"", _BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.said = np.array([said[k](p) for p, k in zip(vocabulary.pieces, vocabulary.kinds)], dtype=object)
        self.leading = np.array([k == _NORMAL and p.startswith(_SPACE) for p, k in zip(vocabulary.pieces, vocabulary.kinds)])
        self.silent = np.array([k == _CONTROL for k in vocabulary.kinds])

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids`` without the blank that encoding puts in front. Bytes that are no UTF-8 become
        U+FFFD one by one; pieces without a text, such as ends, part the bytes on either side."""
        return self.decode_all(np.array(ids, dtype=np.int64), [0, len(ids)])[0]

    def decode_all(self, ids: np.ndarray, ends: list[int]) -> list[str]:
        """The texts of the ids between each two neighbouring ``ends``."""
        said, silent = self.said[ids].tolist(), self.silent[ids]
        if not silent.any():
            texts = [_as_text(b"".join(said[a:b])) for a, b in zip(ends, ends[1:])]
            return [t[1:] if a < b and self.leading[ids[a]] else t for t, a, b in zip(texts, ends, ends[1:])]
        texts = []
        for a, b in zip(ends, ends[1:]):
            edges = [a - 1, *(np.flatnonzero(silent[a:b]) + a).tolist(), b]
            text = "".join(_as_text(b"".join(said[x + 1 : y])) for x, y in zip(edges, edges[1:]))
            first = ids[a:b][~silent[a:b]][:1]
            texts.append(text[1:] if self.leading[first].any() else text)
        return texts


def _as_text(data: bytes) -> str:
    out = []
    while True:
        try:
            out.append(data.decode())
            return "".join(out)
        except UnicodeDecodeError as fault:
            out += [data[: fault.start].decode(), "�"]
            data = data[fault.start + 1 :]


def load_vocabulary(spark: SparkSession, path: str):
    """The model file's vocabulary, shared with all tasks; its size is fixed by the file (about 1 MB)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(read_model(file.read()))


def _schema(df: DataFrame, name: str, kind: str):
    return df.drop(name).withColumn(name, F.lit(None).cast(kind)).schema


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in batch.schema.names if n != name} | {name: values}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def encode(texts: DataFrame, vocabulary, column: str = "text", to: str = "ids") -> DataFrame:
    """``texts`` with the ids of ``column`` in ``to`` (array<int>).

    A NULL text counts as empty and has no ids. Only ``column`` is read; all columns stay, one named ``to`` is replaced.
    """
    held: list[Encoder] = []

    def run(batches):
        if not held:
            held.append(Encoder(vocabulary.value))
        for batch in batches:
            for part in parts(batch, column):
                packed = held[0].encode([t or "" for t in part.column(column).to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
                yield _with(part, to, pa.ListArray.from_arrays(pa.array(ends), ids))

    return texts.mapInArrow(run, _schema(texts, to, "array<int>"))


def decode(encoded: DataFrame, vocabulary, column: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids in ``column`` stand for, in ``to``; NULL and no ids give an empty text."""
    held: list[Decoder] = []

    def run(batches):
        if not held:
            held.append(Decoder(vocabulary.value))
        for batch in batches:
            total = np.cumsum(pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            edges = [0, *(np.flatnonzero(np.diff(total // DECODED)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                ends = (np.append(total[a - 1] if a else 0, total[a:b]) - (total[a - 1] if a else 0)).tolist()
                ids = part.column(column).flatten().to_numpy(zero_copy_only=False)
                yield _with(part, to, pa.array(held[0].decode_all(ids, ends), pa.string()))

    return encoded.mapInArrow(run, _schema(encoded, to, "string"))


def n_tokens(column: str = "ids") -> Column:
    return F.size(column).cast("bigint")
