"""Runs (maximal periodic stretches of words) by an enhanced suffix array.

Words become numbers; the numbers of one text occur in no other, so many texts share one array.
Prefix doubling sorts the suffixes and leaves, for every power of two, names of the
strings of that length: with them common prefixes and suffixes of any two places are found in a few
steps. Two equal neighbouring strings that don't repeat once more (a branching tandem) are
suffixes in different children of one interval of common prefixes; of each interval, the
suffixes in all children but the greatest are asked whether the place one depth further or
before belongs to it as well. Turned left as far as they go, tandems of the same stretch
merge into its run. There is no tree: intervals are pairs of places in arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import slices

#: Words in a run at least.
LEAST = 12
#: Suffixes that are asked at once.
ASKED = 1 << 20


class Suffixes:
    """Names of all strings whose length is a power of two, and the sorted suffixes that share their first words."""

    def __init__(self, symbols: np.ndarray, shared: int):
        """``symbols``: texts, each with an end of its own. Suffixes whose first ``shared`` symbols
        (rounded down to a power of two) occur once stay out of the order."""
        size = len(symbols)
        order = np.argsort(symbols, kind="stable")
        names = np.empty(size, dtype=np.int64)
        heads = _heads(symbols[order], None)
        names[order] = heads
        twice = _twice(heads)
        places, heads = order[twice], heads[twice]
        self.names = [names]
        step = 1
        kept = places
        while len(places):
            key = names[places + step]  # within the text: a string that holds an end occurs once
            turned = np.lexsort((key, heads))
            places, old, key = places[turned], heads[turned], key[turned]
            heads = _heads(key, old)
            names = names.copy()
            names[places] = heads
            step *= 2
            twice = _twice(heads)
            places, heads = places[twice], heads[twice]
            if step <= shared:
                kept = places
            if len(places):
                self.names.append(names)
        self.order = kept[np.argsort(names[kept], kind="stable")]
        self.names = [n.astype(np.int32) for n in self.names] if size < 1 << 31 else self.names

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from places a and b on are the same; a and b differ."""
        n = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.names))):
            n += (self.names[k][a + n] == self.names[k][b + n]).astype(np.int64) << k
        return n

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before places a and b are the same; a < b."""
        n = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.names))):
            left, right = a - n - (1 << k), b - n - (1 << k)
            fits = left >= 0
            n += (fits & (self.names[k][np.where(fits, left, 0)] == self.names[k][np.where(fits, right, 1)])).astype(np.int64) << k
        return n


def _heads(key: np.ndarray, old: np.ndarray | None) -> np.ndarray:
    """For rows sorted by (old, key), the name of each: that of its old group plus the place of its first equal."""
    at = np.arange(len(key))
    new = np.ones(len(key), dtype=bool)
    if old is None:
        new[1:] = key[1:] != key[:-1]
        return np.maximum.accumulate(np.where(new, at, 0))
    group = np.ones(len(key), dtype=bool)
    group[1:] = old[1:] != old[:-1]
    new[1:] = group[1:] | (key[1:] != key[:-1])
    return old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))


def _twice(heads: np.ndarray) -> np.ndarray:
    """Rows that share their name with a neighbour."""
    same = heads[1:] == heads[:-1]
    return np.append(same, False) | np.append(False, same)


def _children(common: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Children of all intervals of at least ``least`` common symbols, without the greatest child of each:
    first and last place of the child and of its interval, and the interval's depth.

    ``common`` holds, for places 1 to m - 1, the symbols in common with the place before; -1 at 0 and m.
    """
    size = len(common) - 1
    values = common.tolist()
    before, after, open_ = [0] * (size + 1), [size] * (size + 1), [0]
    for j in range(1, size + 1):
        value = values[j]
        while values[open_[-1]] > value:
            after[open_.pop()] = j
        before[j] = open_[-1]
        open_.append(j)
    before, after = np.array(before), np.array(after)
    edges = np.flatnonzero(common >= least)
    joined = common[before] == common  # with the edge before, in the same interval
    joined[[0, size]] = False
    first = np.where(joined, before, np.arange(size + 1))
    while True:  # the first edge of the interval
        jumped = first[first]
        if np.array_equal(jumped, first):
            break
        first = jumped
    last = np.ones(size + 1, dtype=bool)
    last[before[joined]] = False
    ending = edges[last[edges]]
    low = np.concatenate([before[edges], ending])
    high = np.concatenate([edges, after[ending]]) - 1
    edge = np.concatenate([edges, ending])
    order = np.lexsort((high - low, first[edge]))
    node = first[edge][order]
    great = np.ones(len(node), dtype=bool)
    great[:-1] = node[1:] != node[:-1]
    small = order[~great]
    edge = edge[small]
    return low[small], high[small], before[first[edge]], after[edge] - 1, common[edge]


def tandems(suffixes: Suffixes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and half length of all branching tandems with halves of at least ``least`` symbols."""
    order = suffixes.order
    if len(order) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.full(len(suffixes.names[0]), -1, dtype=np.int64)  # of each suffix in the order
    place[order] = np.arange(len(order))
    common = np.concatenate([[-1], suffixes.ahead(order[:-1], order[1:]), [-1]])
    children = _children(common, least)
    sizes = children[1] - children[0] + 1
    starts, halves = [], []
    edges = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + ASKED, ASKED)))
    for a, b in zip(edges[:-1], edges[1:]):
        n = sizes[a:b]
        low, high, from_, to, depth = (np.repeat(c[a:b], n) for c in children)
        suffix = order[low + np.arange(len(low)) - np.repeat(np.cumsum(n) - n, n)]
        for other, start in ((suffix + depth, suffix), (suffix - depth, suffix - depth)):
            at = np.where(other >= 0, place[other], -1)
            found = (at >= from_) & (at <= to) & ((at < low) | (at > high))
            starts.append(start[found])
            halves.append(depth[found])
    return (np.concatenate(starts), np.concatenate(halves)) if starts else (np.empty(0, np.int64),) * 2


def runs(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of at least ``least`` symbols and two periods, by start and period."""
    # A run of a shorter period has a tandem of that many symbols all the same: of a multiple of the period.
    half = max(1, least // 2) // 2 + 1 if least >= 4 else 1
    suffixes = Suffixes(symbols, half)
    start, period = tandems(suffixes, half)
    end = start + 2 * period
    start = start - suffixes.behind(start, start + period)
    long = end - start >= least
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
        start, end, period = start[first], end[first], period[first]
    for shorter in range(half - 1, 0, -1):
        divides = np.flatnonzero(period % shorter == 0)
        holds = suffixes.ahead(start[divides], start[divides] + shorter) >= period[divides]
        period[divides[holds]] = shorter
    out = np.stack([start, end - start, period], axis=1)
    return out[np.lexsort((period, start))]


def _symbols(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of several texts, different in different texts, an end after each; and where texts start."""
    codes, starts, used = [], [], 0
    for words in texts:
        starts.append(len(codes))
        known = {w: used + i for i, w in enumerate(dict.fromkeys(words))}
        codes += map(known.__getitem__, words)
        used += len(known) + 1
        codes.append(used - 1)
    return np.array(codes, dtype=np.int64), np.array(starts, dtype=np.int64)


def texts_runs(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each text, given as words."""
    if not texts:
        return []
    symbols, starts = _symbols(texts)
    found = runs(symbols, least)
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    found[:, 0] -= starts[owner]
    return np.split(found, np.searchsorted(owner, np.arange(1, len(texts))))


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by blanks."""
    if len(found):
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, found[:, 0] + found[:, 2], 1)
        np.add.at(edge, found[:, 0] + found[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its runs: doc_id, n_words, runs, collapsed.

    Words are what stands between blanks and the signs 9 to 13. ``runs`` holds (start, length, period) in words, by start
    and period: stretches of at least ``least`` words and two periods that no neighbouring word extends.
    ``collapsed`` is the text without the words that lie in a run after its first period, joined by single blanks.
    A NULL or empty text has no words, no runs and an empty rest. Every row is judged on its own, also
    where ids are missing or repeat. Further columns are ignored. A text is held by one task, about 300 bytes a word.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch):
                words = [(t or b"").split() for t in texts]
                found = texts_runs(words, least)
                flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(fields)),
                )
                rest = pa.array([collapsed(w, f) for w, f in zip(words, found)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array([len(w) for w in words], pa.int64()), lists, rest],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = texts.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
