"""Benchmark decontamination: n-grams of test items, found in training documents.

Test items become windows of consecutive normalised words. Blocks of items of a bounded
size are broadcast as a hash set of windows; every task scans its documents against the
set, verifies each hit on the words themselves and marks the words that lie in one.
Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import PIECE_BYTES, saved, slices

#: Item texts broadcast together, in bytes, and blocks of that size scanned in one pass.
BLOCK_BYTES, BLOCKS_A_PASS = 2 << 20, 16
#: Windows of an item that travel together, as one stretch of its words.
PART_WINDOWS = 4096

# A-Z becomes a-z; digits, letters and all bytes of non-ASCII characters belong to words.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^ ]+")


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The normalised words of a text, in lists of a bounded size."""
    data = data.translate(_NORMAL)
    at = 0
    while len(data) - at > PIECE_BYTES:
        cut = data.find(b" ", at + PIECE_BYTES)
        if cut < 0:
            break
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


class _Windows:
    """The windows of one block of items."""

    def __init__(self, parts: list[tuple[str | None, bytes]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[bytes, set[str]] = {}
        for item, text in parts:
            words = text.split()
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint32)
            width = min(size, len(codes))
            for i in range(len(codes) - width + 1):
                self.items.setdefault(codes[i : i + width].tobytes(), set()).update([] if item is None else [item])
        self.hashes: dict[int, np.ndarray] = {}
        for width in {len(key) // 4 for key in self.items}:
            keys = np.frombuffer(b"".join(k for k in self.items if len(k) == 4 * width), dtype=np.uint32).reshape(-1, width)
            value = np.zeros(len(keys), dtype=np.uint64)
            for k in range(width):
                value = value * _BASE + keys[:, k]
            self.hashes[width] = np.unique(value)
        self.filters = {}
        for width, values in self.hashes.items():
            seen = np.zeros(1 << 20, dtype=bool)
            seen[values >> np.uint64(44)] = True
            self.filters[width] = seen

    def scan(self, counts: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, int, set[str]]]:
        """(document, first word, width, items) of every occurrence in documents laid end to end."""
        ends = np.cumsum(counts)
        value = np.zeros(len(codes), dtype=np.uint64)
        for width in range(1, max(self.hashes, default=0) + 1):
            if width > len(codes):
                break
            value = value[: len(codes) - width + 1] * _BASE + codes[width - 1 :]
            if width not in self.hashes:
                continue
            found = np.flatnonzero(self.filters[width][value >> np.uint64(44)])
            found = found[np.isin(value[found], self.hashes[width])]
            owner = np.searchsorted(ends, found, side="right")
            for i, doc in zip(found.tolist(), owner.tolist()):
                if i + width <= ends[doc]:
                    items = self.items.get(codes[i : i + width].tobytes())
                    if items is not None:
                        yield doc, i - int(ends[doc] - counts[doc]), width, items


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _item_parts(benchmark: DataFrame, window: int) -> DataFrame:
    """Items as normalised texts of bounded length that together hold every window."""

    def cut(batches):
        for batch in batches:
            ids, parts = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                held: list[bytes] = []
                done = False
                for some in words_of(text):
                    held += some
                    while len(held) >= PART_WINDOWS + window - 1:
                        ids.append(item)
                        parts.append(b" ".join(held[: PART_WINDOWS + window - 1]))
                        held = held[PART_WINDOWS:]
                        done = True
                if held and (len(held) >= window or not done):
                    ids.append(item)
                    parts.append(b" ".join(held))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.binary())], ["item", "part"])

    chosen = benchmark.where("text is not null").select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")
    )
    return chosen.mapInArrow(cut, "item string, part binary").distinct()


def _blocks(parts: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Lists of parts, each of about block_bytes; only one is held by the driver at a time."""
    total = parts.agg(F.sum(F.octet_length("part") + 16)).first()[0] or 0
    n = -(-total // block_bytes)
    for b in range(n):
        chosen = parts if n == 1 else parts.where(F.pmod(F.xxhash64("item", "part"), F.lit(n)) == b)
        yield [(r["item"], bytes(r["part"])) for r in chosen.collect()]


def _scanner(shared: list, window: int) -> Callable:
    """Adds the hits of the shared blocks to what the columns spans and items hold."""
    built: dict[int, _Windows] = {}

    def windows(k: int) -> _Windows:
        if k not in built:
            built.clear()  # one block's set at a time
            built[k] = _Windows(shared[k].value, window)
        return built[k]

    def scan(batches):
        for batch in batches:
            n = batch.num_rows
            spans = [np.frombuffer(x or b"", dtype=np.int64).reshape(-1, 2).tolist() for x in batch.column("spans").to_pylist()]
            items = [set(x or ()) for x in batch.column("items").to_pylist()]
            totals = [0] * n
            for k in range(len(shared)):
                block = windows(k)
                look = block.vocabulary.get
                for first, texts in slices(batch):
                    counts, codes = [], []
                    for text in texts:
                        count = 0
                        for words in words_of(text or b""):
                            codes.append(np.fromiter(map(look, words, repeat(0)), dtype=np.uint32, count=len(words)))
                            count += len(words)
                        counts.append(count)
                    totals[first : first + len(texts)] = counts
                    laid = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
                    for doc, at, width, found in block.scan(np.array(counts, dtype=np.int64), laid):
                        own = spans[first + doc]
                        if own and own[-1][0] <= at <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], at + width)
                        else:
                            own.append([at, at + width])
                        items[first + doc] |= found
            if not shared:
                totals = [sum(map(len, words_of(t or b""))) for t in batch.column("text").to_pylist()]
            spans = [_merged(x) for x in spans]
            columns = {name: batch.column(name) for name in batch.schema.names} | {
                "spans": pa.array([np.array(x, dtype=np.int64).tobytes() for x in spans], pa.binary()),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                "n_words": pa.array(totals, pa.int64()),
                "n_hit": pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return scan


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: int = 20,
    block_bytes: int = BLOCK_BYTES,
    blocks_a_pass: int = BLOCKS_A_PASS,
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its hits against ``benchmark`` (item_id, text).

    Columns: doc_id, text, n_words, n_hit (words inside an occurrence), items (ids, as
    text, sorted), spans (pairs of int64: first word, word after the last), contaminated
    (n_hit > 0 and share * n_hit >= n_words). An item with fewer words than the window is
    one window; without words it has none. A NULL text has no words. Items without an id
    mark words but aren't listed; repeated items count once. Further columns are ignored.
    """
    spark = docs.sparkSession
    state = docs.select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.lit(None).cast("binary").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("n_words"),
        F.lit(0).cast("bigint").alias("n_hit"),
    )
    waiting: list = []
    passes = 0
    for block in _blocks(saved(_item_parts(benchmark, window), "items"), block_bytes):
        if len(waiting) == blocks_a_pass:
            state = saved(state.mapInArrow(_scanner(waiting, window), state.schema), "hits")
            waiting, passes = [], passes + 1
        waiting.append(spark.sparkContext.broadcast(block))
    if waiting or not passes:
        state = state.mapInArrow(_scanner(waiting, window), state.schema)
    return state.select(
        "doc_id", F.col("text").cast("string").alias("text"), "n_words", "n_hit", "items", "spans",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_spans(found: DataFrame) -> DataFrame:
    """doc_id and text of a :func:`contamination` result, with the hit words cut out."""

    def cut(batches):
        for batch in batches:
            texts = []
            for text, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                spans = np.frombuffer(packed or b"", dtype=np.int64).reshape(-1, 2).tolist()
                if spans:
                    at = [m.span() for m in _WORD.finditer(text.translate(_NORMAL))]
                    kept, last = [], 0
                    for a, b in spans:
                        kept.append(text[last : at[a][0]])
                        last = at[b - 1][1]
                    text = b"".join([*kept, text[last:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    rows = found.select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    kind = found.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, text binary").select("doc_id", F.col("text").cast("string").alias("text"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated.

    Rows are judged where they are: the columns travel through the scan as one struct.
    """
    spark_columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in spark_columns]).alias("doc_id"), "text")
    found = contamination(packed, benchmark, **settings)
    return found.where("not contaminated").select(*[F.col(f"doc_id.`{c}`").alias(c) for c in spark_columns])
