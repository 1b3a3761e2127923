"""SimHash near-dedup by tiled exact comparison.

Fingerprints are 64 bits over word shingles. Equal ones collapse to one row first, so a
group of copies costs nothing further. Distinct fingerprints are laid in tiles by the bit
counts of their four quarters: two fingerprints within the radius differ by no more than
the radius in these counts, summed, so only tiles of neighbouring counts are compared and
all others are skipped. A comparison is an exclusive or and a bit count over whole
tiles; it hands on a spanning forest of its links, never all pairs. Components of the
links are found by joins.

Wide fingerprints, of 256 bits over distinct shingles, propose texts of a given similarity:
the radius is the distance such texts have, and six standard deviations more. They are laid
in tiles by the number of shingles, and tiles whose numbers allow the similarity are compared alike.
"""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import PIECE_BYTES, connected_components, forest, row_key, saved

SEED = 42
#: Fingerprints in a tile on average, and rows of a tile compared at once.
TILE, STRIP = 8192, 256
_QUARTERS = (0, 16, 32, 48)
#: Words of a wide fingerprint, wide fingerprints in a tile on average, and pairs of them compared at once.
WIDE, WIDE_TILE, WIDE_PAIRS = 4, 16384, 1 << 17
_BLANK = re.compile(rb"[ \t-\r]")


def word_lists(data: bytes):
    data = data.lower()
    at = 0
    while len(data) - at > PIECE_BYTES:
        cut = _BLANK.search(data, at + PIECE_BYTES)
        if cut is None:
            break
        yield data[at : cut.start()].split()
        at = cut.start()
    yield data[at:].split()


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """Bits set in over half of the XXH64 values of the word shingles, repeats included."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    carried: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for words in word_lists(data):
        words = carried + words
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts = np.concatenate([[0], ends[: len(words) - shingle]]).tolist()
            stops = (ends[shingle - 1 :] - 1).tolist()
            values = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
            ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(values)
            words = words[len(words) - shingle + 1 :] if shingle > 1 else []
        carried = words
    if not n and carried:
        return digest(b" ".join(carried), SEED)
    return int(((2 * ones > n) * (1 << np.arange(64, dtype=np.uint64))).sum(dtype=np.uint64)) if n else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``. A NULL text counts as empty: fingerprint 0."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(text or b"", shingle) for text in batch.column("text").to_pylist()]
            values = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _celled(distinct: DataFrame) -> DataFrame:
    """Fingerprints with their cell: the four bit counts in one number."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", q).bitwiseAND(F.lit(65535))) for q in _QUARTERS]
    return distinct.select("fp", sum((c * 32**k for k, c in enumerate(counts)), F.lit(0)).cast("int").alias("cell"))


def _near_cells(radius: int) -> list[tuple[int, bool]]:
    """Steps from a cell to those within the radius, one of each two opposite ones; whether it is no step."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius and s >= (0,) * 4]
    return [(sum(x * 32**k for k, x in enumerate(s)), not any(s)) for s in steps]


def _compare(radius: int):
    def links_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(a)
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, n, STRIP):
            near = np.bitwise_count(a[i : i + STRIP, None] ^ b[None, :]) <= radius
            x, y = np.nonzero(near)
            if len(x):
                root = forest(n + len(b), x + i, y + n)
                held = np.flatnonzero(root != np.arange(len(root)))
                lefts.append(held)
                rights.append(root[held])
        root = forest(n + len(b), np.concatenate(lefts), np.concatenate(rights))
        held = np.flatnonzero(root != np.arange(len(root)))
        both = np.concatenate([a, b])
        return both[held], both[root[held]]

    def run(batches):
        for batch in batches:
            ours, theirs = batch.column("ours"), batch.column("theirs")
            for k in range(batch.num_rows):
                x, y = links_of(*(np.asarray(c[k].values.to_numpy()).view(np.uint64) for c in (ours, theirs)))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["src", "dst"])

    return run


def near_links(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links (src, dst) that connect the same fingerprints as all pairs within the radius do.

    ``distinct`` holds each fingerprint once, in a bigint column fp.
    """
    pairs = _tile_pairs(_celled(distinct), "fp", _near_cells(radius), tile)
    return pairs.mapInArrow(_compare(radius), "src bigint, dst bigint")


def _tile_pairs(celled: DataFrame, column: str, steps: list[tuple[int, bool]], tile: int) -> DataFrame:
    """Lists (ours, theirs) of ``column``: each two tiles whose cells are a step apart, once."""
    # Crowded cells get several chunks. Cells are few (17^4 at most), one row each: safe to broadcast.
    sizes = F.broadcast(saved(celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")), "cells"))
    chunk = F.pmod(F.xxhash64(column), F.col("chunks")).cast("int").alias("chunk")
    tiles = saved(celled.join(sizes, "cell").groupBy("cell", chunk).agg(F.collect_list(column).alias("members")), "tiles")
    near = F.explode(F.array(*[F.struct(F.lit(d).alias("step"), F.lit(z).alias("same")) for d, z in steps]))
    ours = tiles.select("cell", F.col("chunk").alias("our_chunk"), F.col("members").alias("ours"), near.alias("near")).select(
        (F.col("cell") + F.col("near.step")).alias("cell"), "our_chunk", "ours", "near.same"
    )
    # Each pair of tiles gets a key of its own.
    pairs = ours.join(sizes, "cell").select(
        "cell", "our_chunk", "ours", "same", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    return (
        pairs.where("not same or our_chunk <= chunk")
        .join(tiles.withColumnRenamed("members", "theirs"), ["cell", "chunk"])
        .select("ours", "theirs")
    )


def wide_fingerprint(values: np.ndarray) -> list[int]:
    """Signed words of the bits set in over half of the distinct 64-bit values and of mixtures of these; none for no value."""
    n, ones = len(values), np.zeros(64 * WIDE, dtype=np.int64)
    for i in range(0, n, 255):  # sums of 255 bits fit a byte
        some = values[i : i + 255]
        mixed = [some]
        for k in range(1, WIDE):
            x = some + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed.append(x ^ (x >> np.uint64(31)))
        laid = np.stack(mixed, axis=1).astype("<u8").view(np.uint8)
        ones += np.unpackbits(laid, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<i8").tolist() if n else []


def wide_radius(similarity: float, bits: int = 64 * WIDE) -> int:
    """Bits in which texts of this Jaccard similarity differ: those expected, by the angle between them, and six deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + 6 * math.sqrt(bits * share * (1 - share)))


def _compare_wide(similarity: float):
    radius, first = wide_radius(similarity), wide_radius(similarity, 64)

    def links_of(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Both ends of links between members (ids, then words) of two tiles: a spanning forest of the near pairs."""
        n, m = len(a[0]), len(b[0])
        same = a[0][0] == b[0][0]  # a tile with itself
        both = a[0] if same else np.concatenate([a[0], b[0]])
        step = max(1, WIDE_PAIRS // m)
        lefts, rights, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def shrink() -> None:
            root = forest(len(both), np.concatenate(lefts), np.concatenate(rights))
            held = np.flatnonzero(root != np.arange(len(both)))
            lefts[:], rights[:] = [held], [root[held]]

        for i in range(0, n, step):
            start = i if same else 0
            apart = np.bitwise_count(a[1][i : i + step, None] ^ b[1][None, start:])
            at = np.flatnonzero(apart.ravel() <= first)
            x, y = at // (m - start) + i, at % (m - start) + start
            bits = apart.ravel()[at].astype(np.int64)
            for ours, theirs in zip(a[2:], b[2:]):
                bits += np.bitwise_count(ours[x] ^ theirs[y])
            near = bits <= radius
            lefts.append(x[near])
            rights.append(y[near] + (0 if same else n))
            waiting += len(lefts[-1])
            if waiting > 8 * (n + m):
                shrink()
                waiting = 0
        shrink()
        return both[lefts[0]], both[rights[0]]

    def run(batches):
        for batch in batches:
            ours, theirs = batch.column("ours"), batch.column("theirs")
            for k in range(batch.num_rows):
                a, b = ([np.asarray(x.to_numpy()) for x in c[k].values.flatten()] for c in (ours, theirs))
                src, dst = links_of(*([x[0], *(w.view(np.uint64) for w in x[1:])] for x in (a, b)))
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return run


def wide_links(distinct: DataFrame, similarity: float, tile: int = WIDE_TILE) -> DataFrame:
    """Links (src, dst) that connect the same nodes as all pairs whose wide fingerprints are as near as texts
    of this similarity are, and whose sizes allow it.

    ``distinct``: node (bigint, each once), size (its shingles), sketch (its wide fingerprint, none if empty).
    """
    # Sets of this similarity differ in size by no more than its inverse: in one cell or two neighbouring ones.
    cell = F.floor(F.log("size") / F.lit(math.log(1 / similarity)) + 1e-9).cast("int").alias("cell")
    words = [F.col("sketch")[k].alias(f"w{k}") for k in range(WIDE)]
    celled = distinct.where("size > 0").select(cell, F.struct("node", *words).alias("member"))
    return _tile_pairs(celled, "member", [(0, True), (1, False)], tile).mapInArrow(_compare_wide(similarity), "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (bigint), component_id.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id
    is the smallest doc_id reachable. Empty and NULL texts have fingerprint 0 and are linked
    like any others. Rows without doc_id take part but never name a component, unless no
    other row is in it. Further columns of ``docs`` are ignored.
    """
    marked = saved(fingerprints(docs, shingle), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    labels = connected_components(near_links(distinct.select("fp"), radius, tile))
    rooted = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "least_id", F.coalesce("label", "fp").alias("root")
    )
    rooted = saved(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = saved(rooted.join(named, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, groups=near_duplicates, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that name their component: one of each group.

    ``groups`` gives doc_id and component_id of every row of (doc_id, text).
    Rows with the same id and text are copies, of which the least by its columns stays; other rows that share
    the smallest id stay once each group. Rows without id stay only where their group has no other.
    """
    columns = docs.columns
    once = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *row_key())
        .groupBy("key_a", "key_b").agg(F.min("row").alias("row"))
    )
    # The key takes the place of the id: missing ids last, then by id, then the key tells equal ids apart.
    key = F.struct(F.isnull("doc_id").alias("missing"), "doc_id", *row_key()).alias("doc_id")
    first = groups(docs.select(key, "text"), **settings).where("doc_id = component_id")
    kept = once.join(first.select("doc_id.key_a", "doc_id.key_b").distinct(), ["key_a", "key_b"], "left_semi")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
