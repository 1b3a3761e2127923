"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed subwords (runs of three and four bytes
within words, with a blank at either end of a word), followed by a linear layer. The model
is trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows, its probabilities are calibrated by a temperature on rows held back, and
texts whose best language stays improbable are rejected. Scoring covers whole texts, in
Arrow batches, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import PIECE_BYTES, bounded, saved, slices

UNKNOWN = "und"
#: Labelled rows the model is fitted on, shared among the languages (20 each at least).
SAMPLE_ROWS = 1600
#: Bytes of text they hold together at most.
SAMPLE_BYTES = 64 << 20
#: Bytes of text scored together: each takes a number for every language, several times over.
LAID_BYTES = 1 << 18
#: Calibrated probability below which a text is rejected.
LEAST_PROBABILITY = 0.4
BUCKETS, WIDTH, EPOCHS, BATCH, RATE = 1 << 15, 8, 6, 64, 4.0
ORDERS = (3, 4)
_LETTER = regex.compile(r"\p{L}")
# Lower-case ASCII letters and the bytes of other characters stay; all else separates words.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # a row per bucket and a column per language: embedding times weights
    bias: np.ndarray
    temperature: float
    least: float


def _normal(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


def _subwords(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the subword that starts at each byte; 0 where a blank lies inside it."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    value = np.full(n, order, dtype=np.uint32)
    inside = np.ones(n, dtype=bool)
    for k in range(order):
        part = data[k : k + n]
        value = (value ^ part) * np.uint32(16777619)
        if 0 < k < order - 1:
            inside &= part != 32
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    return np.where(inside, (value >> np.uint32(8)) % np.uint32(BUCKETS - 1) + np.uint32(1), np.uint32(0))


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    data = np.frombuffer(_normal(text), dtype=np.uint8).astype(np.uint32)
    total = sum(np.bincount(_subwords(data, order), minlength=BUCKETS) for order in ORDERS)
    total[0] = 0
    ids = np.flatnonzero(total)
    return ids, total[ids]


def _snippets(text: str) -> list[str]:
    """The text, and a few short stretches from places spread over it, so that short texts are known too."""
    words = text.split()
    out = [text]
    for k, n in enumerate((1, 2, 3, 5, 9, 16)):
        if len(words) > 2 * n:
            at = (k + 1) * (len(words) - n) // 7
            out.append(" ".join(words[at : at + n]))
    return out


def may_learn(docs: DataFrame, label: str) -> DataFrame:
    return docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())


def sample(docs: DataFrame, label: str, rows: int) -> DataFrame:
    """About ``rows`` labelled rows, or 20 a label, of :data:`SAMPLE_BYTES` at most: equally many of each label, chosen
    by a hash of id and text, so that an id on very many rows counts as its rows do."""
    counts = docs.groupBy(label).agg(F.count("*").alias("rows_of_label"))
    labels = counts.count() or 1
    share = max(20, rows // labels)
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # One small row a label, as long as labels are few; the texts then stay where they are.
    small = F.broadcast(counts) if labels <= 100_000 else counts
    chosen = docs.join(small, label).where(spread < share / F.col("rows_of_label")).drop("rows_of_label")
    return bounded(saved(chosen, "sample"), 2 * share * labels, SAMPLE_BYTES)


def train(docs: DataFrame, label: str = "lang", rows: int = SAMPLE_ROWS, least: float = LEAST_PROBABILITY, seed: int = 7) -> Model:
    """A model of the languages in ``label``, learnt from ``docs`` (doc_id, text, label).

    Rows without label, text or id teach nothing. Without any other row the model knows no
    language and answers ``und``.
    """

    def features(batches):
        for batch in batches:
            found: list[tuple] = []
            for key, lang, text in zip(*(batch.column(c).to_pylist() for c in ("key", "label", "text"))):
                for piece in _snippets(text):
                    ids, counts = _counts(piece)
                    if len(ids):
                        found.append((key, lang, ids.astype(np.uint16).tobytes(), counts.astype(np.float32).tobytes()))
            columns = list(zip(*found)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.binary()))], ["key", "label", "ids", "counts"])

    rows_of = sample(may_learn(docs, label), label, rows).select(
        F.xxhash64("doc_id").alias("key"), F.col(label).cast("string").alias("label"), "text"
    )
    examples = rows_of.mapInArrow(features, "key bigint, label string, ids binary, counts binary").toArrow().to_pylist()
    examples.sort(key=lambda e: (e["key"], e["label"], len(e["ids"]), e["ids"]))
    languages = sorted({e["label"] for e in examples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, least)
    ids = [np.frombuffer(e["ids"], dtype=np.uint16).astype(np.int64) for e in examples]
    shares = [(x / x.sum()).astype(np.float32) for x in (np.frombuffer(e["counts"], dtype=np.float32) for e in examples)]
    target = np.array([languages.index(e["label"]) for e in examples])
    held = np.array([e["key"] % 5 == 0 for e in examples])
    if held.all() or not held.any():
        held[:] = False
    return _fit(ids, shares, target, held, languages, least, np.random.default_rng(seed))


def _means(ids: list, shares: list, rows: np.ndarray, table: np.ndarray) -> tuple:
    flat, weight = np.concatenate([ids[i] for i in rows]), np.concatenate([shares[i] for i in rows])
    starts = np.concatenate([[0], np.cumsum([len(ids[i]) for i in rows])[:-1]])
    return flat, weight, starts, np.add.reduceat(table[flat] * weight[:, None], starts, axis=0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(ids, shares, target, held, languages, least, rng) -> Model:
    n = len(languages)
    # A subword that no example holds keeps a zero embedding: it speaks for no language.
    table, weights, bias = np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, n), np.float32), np.zeros(n, np.float32)
    seen = np.unique(np.concatenate(ids))
    table[seen] = rng.normal(0, 0.3, (len(seen), WIDTH))
    weights[:] = rng.normal(0, 0.3, (WIDTH, n))
    learn = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(learn)
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            flat, weight, starts, mean = _means(ids, shares, rows, table)
            slope = _softmax(mean @ weights + bias)
            slope[np.arange(len(rows)), target[rows]] -= 1
            slope /= len(rows)
            back = np.repeat(slope @ weights.T, np.diff(np.append(starts, len(flat))), axis=0) * weight[:, None]
            weights -= rate * mean.T @ slope
            bias -= 0.1 * rate * slope.sum(axis=0)
            where, inverse = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(inverse, back[:, d], len(where)) for d in range(WIDTH)], axis=1)
            table[where] -= (rate * BATCH * step).astype(np.float32)
    bias -= bias.max() if n == 1 else bias.mean()
    judged = np.flatnonzero(held) if held.any() else learn
    logits = _means(ids, shares, judged, table)[3] @ weights + bias

    def loss(t: float) -> float:
        return -np.log(_softmax(logits / t)[np.arange(len(judged)), target[judged]] + 1e-12).mean()

    temperature = min(np.geomspace(0.2, 20, 60).tolist(), key=loss)
    return Model(languages, (table @ weights).astype(np.float32), bias.astype(np.float32), temperature, least)


def _sums(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the scores of each text's subwords, and their number. Texts are laid end to end; a blank
    at their ends keeps them apart."""
    laid = [_normal(t) for t in texts]
    data = np.frombuffer(b"".join(laid), dtype=np.uint8).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in laid])[:-1]])
    total, n = np.zeros((len(texts), model.scores.shape[1])), np.zeros(len(texts))
    for order in ORDERS:
        # Two blanks in a row, where texts meet, can't lie inside a subword of three bytes or more.
        found = np.zeros(len(data), dtype=np.uint32)
        some = _subwords(data, order)
        found[: len(some)] = some
        total += np.add.reduceat(model.scores[found], starts, axis=0, dtype=np.float64)
        n += np.add.reduceat(found > 0, starts, dtype=np.int64)
    return total, n


def _scores(model: Model, texts: list[str]) -> np.ndarray:
    """Logits of each text."""
    total, n = _sums(model, texts)
    return total / np.maximum(n, 1)[:, None] + model.bias


def _long_scores(model: Model, text: str) -> np.ndarray:
    """The same for one long text, in pieces cut at blanks."""
    total, n, at = np.zeros(model.scores.shape[1]), 0.0, 0
    while at < len(text):
        cut = text.find(" ", at + PIECE_BYTES)
        piece = text[at : cut if cut >= 0 else len(text)]
        at += len(piece)
        some, count = _sums(model, [piece])
        total, n = total + some[0], n + count[0]
    return total / max(n, 1) + model.bias


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with lang_pred, lang_score and lang_rejected; all columns stay.

    lang_pred is ``und`` with score 0 where the text is NULL or has no letter, else the
    likeliest language with its calibrated probability. Rejected are ``und`` and what is
    less probable than the model demands. Only ``text`` is read. Columns of these
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "lang_score", "lang_rejected")

    def run(batches):
        known = shared.value
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for _, texts in slices(batch, size=LAID_BYTES):
                lettered = [bool(t and known.languages and _LETTER.search(t)) for t in texts]
                logits = np.zeros((len(texts), known.scores.shape[1]))
                short = [i for i, ok in enumerate(lettered) if ok and len(texts[i]) <= PIECE_BYTES]
                if short:
                    logits[short] = _scores(known, [texts[i] for i in short])
                for i, ok in enumerate(lettered):
                    if ok and len(texts[i]) > PIECE_BYTES:
                        logits[i] = _long_scores(known, texts[i])
                chance = _softmax(logits / known.temperature)
                best = chance.argmax(axis=1)
                names += [known.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                scores += [float(chance[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, lettered))]
            columns = {c: batch.column(c) for c in batch.schema.names if c not in added}
            columns |= {
                "lang_pred": pa.array(names, pa.string()),
                "lang_score": pa.array(scores, pa.float64()),
                "lang_rejected": pa.array([n == UNKNOWN or s < known.least for n, s in zip(names, scores)], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    plain = docs.drop(*added)
    schema = plain.select("*", F.lit("").alias(added[0]), F.lit(0.0).alias(added[1]), F.lit(True).alias(added[2])).schema
    return plain.mapInArrow(run, schema)


def probability() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), "lang_score"))
