"""Substring dedup on sentence spans.

A text is cut into sentences; from every sentence a run of several consecutive ones is
hashed. Runs are joined globally by hash, and sentences that lie in any repeated run but the
first are removed. An aggregate finds which hashes repeat and where each occurs first;
a join with these keeps the rest of their places.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import document_ref, same_document, saved

#: Sentences in a run at least, and words; a run takes more sentences until it has the words.
RUN_SENTENCES, RUN_WORDS = 3, 12
#: A longer sentence is cut after every word whose checksum CUT divides, and after LONGEST words:
#: cuts depend on the words near them, so a passage is cut alike wherever it stands.
SENTENCE_WORDS, CUT, LONGEST = 12, 8, 24
# A sentence ends with a stop (signs and closing marks may follow) before a blank, or with a line.
_END = re.compile(rb"[.!?][^0-9A-Za-z\x80-\xff\s]*\s+|\n\s*")
_WORD = re.compile(rb"\S+\s*")


def sentences(data: bytes) -> list[tuple[int, int]]:
    """Start and word count of each sentence; together they cover the text from its first word on."""
    out: list[tuple[int, int]] = []
    at = 0
    for end in [*(m.end() for m in _END.finditer(data)), len(data)]:
        words = data[at:end].split()
        n = len(words)
        if n > SENTENCE_WORDS:
            starts = _word_starts(data, at, end, words)
            first = 0
            for k, word in enumerate(words, 1):
                if k - first == LONGEST or crc32(word.lower()) % CUT == 0:
                    out.append((starts[first], k - first))
                    first = k
            if first < n:
                out.append((starts[first], n - first))
        elif n:
            out.append((at, n))
        at = end
    return out


def _word_starts(data: bytes, at: int, end: int, words: list[bytes]) -> list[int]:
    part = data[at:end]
    bare = part.lstrip()
    if len(bare.rstrip()) == sum(map(len, words)) + len(words) - 1:  # single blanks between them
        return [at + len(part) - len(bare), *accumulate((len(w) + 1 for w in words[:-1]), initial=at + len(part) - len(bare))][1:]
    return [m.start() for m in _WORD.finditer(data, at, end)]


def runs(found: list[tuple[int, int]], length: int = RUN_SENTENCES, words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """(first, last + 1) sentence of the run from each sentence that has one: the shortest of at
    least ``length`` sentences and ``words`` words."""
    total = [0, *accumulate(n for _, n in found)]
    out, last, size = [], 0, len(found)
    for first in range(size - length + 1):
        last = max(last, first + length)
        while last < size and total[last] - total[first] < words:
            last += 1
        if total[last] - total[first] < words:
            break
        out.append((first, last))
    return out


def _rows(length: int, words: int):
    """The hash of every run (two numbers) with its document and first sentence."""

    def run(batches):
        for batch in batches:
            owner, starts, digests = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = sentences(text)
                edges = [*(s for s, _ in found), len(text)]
                lower = text.lower()
                clean = [b" ".join(lower[s:e].split()) for s, e in zip(edges, edges[1:])]
                chosen = runs(found, length, words)
                owner += [i] * len(chosen)
                starts += [a for a, _ in chosen]
                digests += [blake2b(b"\n".join(clean[a:b]), digest_size=12).digest() for a, b in chosen]
            packed = np.frombuffer(b"".join(digests), dtype=np.dtype([("a", "<i8"), ("b", "<i4")]))
            refs = [batch.column(c).take(pa.array(owner, pa.int64())) for c in ("doc_id", "tie")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(packed["a"])), pa.array(np.ascontiguousarray(packed["b"])), *refs, pa.array(starts, pa.int32())],
                ["hash_a", "hash_b", "doc_id", "tie", "start"],
            )

    return run


def repeated_runs(docs: DataFrame, length: int = RUN_SENTENCES, words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, tie, start): the non-first places of all runs that occur in more than one place.

    The first place is the one with the smallest id (missing ids come first), then tie,
    then sentence. Rows of ``docs`` that agree in id and text are one document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    refs = docs.select(*document_ref(), F.col("text").cast("binary").alias("text")).where("text is not null")
    # Kept, about as large as half the compressed texts: cutting and hashing them again would cost more.
    rows = saved(refs.mapInArrow(_rows(length, words), f"hash_a bigint, hash_b int, doc_id {kind}, tie bigint, start int"), "runs")
    place = F.struct("doc_id", "tie", "start")
    repeated = saved(
        rows.groupBy("hash_a", "hash_b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last").select("hash_a", "hash_b", "first"),
        "repeated",
    )
    return rows.join(repeated, ["hash_a", "hash_b"]).where(place != F.col("first")).select("doc_id", "tie", "start")


def without_repeats(docs: DataFrame, length: int = RUN_SENTENCES, words: int = RUN_WORDS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with what is left of it: doc_id, text, n_sentences, n_removed.

    Runs start at every sentence, so runs in one document may overlap; a repeated one is
    removed but for its first place, also where places overlap. A document with less than
    a run is left alone. NULL stays NULL, without sentences. Further columns are ignored.
    """

    def cut(batches):
        for batch in batches:
            kept, counts, removed = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                found = sentences(text or b"")
                gone = np.zeros(len(found), dtype=bool)
                if starts:
                    ends = dict(runs(found, length, words))
                    for s in starts:
                        gone[s : ends[s]] = True
                    edges = [*(s for s, _ in found), len(text)]
                    text = text[: edges[0]] + b"".join(text[edges[i] : edges[i + 1]] for i in np.flatnonzero(~gone))
                kept.append(text)
                counts.append(len(found))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                ["doc_id", "text", "n_sentences", "n_removed"],
            )

    places = repeated_runs(docs, length, words).groupBy("doc_id", "tie").agg(F.collect_set("start").alias("starts"))
    texts = docs.select(*document_ref(), F.col("text").cast("binary").alias("text")).alias("d")
    joined = texts.join(places.alias("p"), same_document("d", "p"), "left").select("d.doc_id", "text", "starts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, text binary, n_sentences bigint, n_removed bigint").withColumn(
        "text", F.col("text").cast("string")
    )
