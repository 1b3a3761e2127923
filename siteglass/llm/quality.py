"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of word characters or of other signs, case kept; a document's features
are the hashed tokens and pairs of neighbouring tokens (a pair of equal tokens is one
feature of its own). Updates run in numpy over a bounded sample of labelled rows;
scoring is a sparse dot product over whole texts, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import bounded, slices

#: Labelled rows the model is fitted on, about.
SAMPLE_ROWS = 4000
#: Bytes of text they hold together at most.
SAMPLE_BYTES = 64 << 20
BUCKETS, EPOCHS = 1 << 18, 4
#: Step size and its offset, and the two penalties, of the updates.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
#: Bytes hashed at once.
STRETCH = 1 << 20
_KINDS = np.array([0 if c <= 32 else 1 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 2 for c in range(256)], dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class _Hasher:
    """Hashes tokens of bytes laid end to end, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self):
        self.up = self._powers(_BASE)
        self.down = self._powers(pow(_BASE, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(STRETCH, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def tokens(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every token in at most STRETCH bytes."""
        raw = np.frombuffer(data, dtype=np.uint8)
        kinds = _KINDS[raw]
        edges = np.flatnonzero(np.diff(kinds, prepend=np.uint8(0), append=np.uint8(0)))
        starts, ends = edges[:-1], edges[1:]
        inside = kinds[starts] > 0 if len(starts) else np.zeros(0, bool)
        starts, ends = starts[inside], ends[inside]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.down[: len(raw)], dtype=np.uint64)])
        value = (sums[ends] - sums[starts]) * self.up[starts]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return starts, value ^ (value >> np.uint64(32))


def _bucket(value: np.ndarray) -> np.ndarray:
    value = value * np.uint64(0x94D049BB133111EB)
    return (value >> np.uint64(64 - 18)).astype(np.int64)


def _features(hasher: _Hasher, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(text, buckets) for stretches of texts; a long text comes in several, cut at blanks."""
    for i, text in enumerate(texts):
        at, last = 0, np.zeros(0, np.uint64)
        while at < len(text):
            cut = len(text)
            if cut - at > STRETCH:
                cut = text.rfind(b" ", at + 1, at + STRETCH)
                cut = cut if cut > 0 else at + STRETCH
            values = np.concatenate([last, hasher.tokens(text[at:cut])[1]])
            a, b = values[:-1], values[1:]
            pairs = np.where(a == b, np.uint64(_BASE), a * np.uint64(3) + (b ^ (b >> np.uint64(7))) * np.uint64(5))
            yield i, np.concatenate([_bucket(values[len(last) :]), _bucket(pairs)])
            last, at = values[-1:], cut


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """About ``rows`` rows (key, text, label) of ``docs`` with a label of 0 or 1 at most, of :data:`SAMPLE_BYTES` at most, chosen
    by a hash of their id, and of id and text where these are more rows than ids.

    The chosen ids are bounded by ``rows`` and thus broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    n = known.count()
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(spread < rows / max(n, 1)).distinct()
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return bounded(found, rows + rows // 4, SAMPLE_BYTES).select(F.xxhash64("doc_id").alias("key"), "text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``label`` (0 or 1) in ``labels`` (doc_id, label) learnt from the texts of ``docs``.

    NULL and empty texts teach the share of 1 alone. Without any labelled row every score is 0.5.
    """

    def features(batches):
        hasher = _Hasher()
        for batch in batches:
            packed = []
            for text in batch.column("text").to_pylist():
                found = [b for _, b in _features(hasher, [text or b""])]
                ids, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
                packed.append((ids.astype(np.int32).tobytes(), counts.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())],
                ["key", "label", "ids", "counts"],
            )

    chosen = labelled_sample(docs, labels, label, rows).withColumn("text", F.col("text").cast("binary"))
    examples = chosen.mapInArrow(features, "key bigint, label int, ids binary, counts binary").toArrow().to_pylist()
    examples.sort(key=lambda e: (e["key"], e["label"], e["ids"]))
    return _follow_the_leader(examples)


def _values(counts: np.ndarray) -> np.ndarray:
    return counts / np.sqrt(max(counts.sum(), 1.0))


def _follow_the_leader(examples: list[dict]) -> Model:
    """Per-coordinate updates of the regularised leader, one example at a time; weights follow from z and n."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rows = [
        (np.append(np.frombuffer(e["ids"], np.int32), BUCKETS), np.append(_values(np.frombuffer(e["counts"], np.float32)), 1.0), e["label"])
        for e in examples
    ]
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            ids, x, y = rows[k]
            zi, ni = z[ids], n[ids]
            w = _leader(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            root = np.sqrt(ni + g * g)
            z[ids] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[ids] = ni + g * g
    w = _leader(z, n)
    return Model(w[:BUCKETS].astype(np.float32), float(w[BUCKETS]))


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """Every row of ``docs`` with the probability of label 1 in ``to``; all columns stay.

    NULL and empty texts get the probability of a text without features. Only ``text`` is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher, known = _Hasher(), shared.value
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for first, texts in slices(batch, held):
                for i, ids in _features(hasher, [t or b"" for t in texts]):
                    total[first + i] += known.weights[ids].sum(dtype=np.float64)
                    n[first + i] += len(ids)
            logits = np.clip(total / np.sqrt(np.maximum(n, 1)) + known.bias, -35, 35)
            columns = {c: batch.column(c) for c in batch.schema.names if c not in (to, held)}
            columns[to] = pa.array(1 / (1 + np.exp(-logits)), pa.float64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    plain = docs.drop(to)
    held = "__text"
    while held in plain.columns:
        held += "_"
    schema = plain.withColumn(to, F.lit(0.0)).schema
    return plain.withColumn(held, F.col("text").cast("binary")).mapInArrow(run, schema)
