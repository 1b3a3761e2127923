"""Suffix-array dedup: removes every byte in a string of ``span`` bytes that occurs more than once.

Sorting all suffixes of a corpus isn't needed to find long repeats. Each string of ``span``
bytes has an anchor, its part with the smallest hash, and equal strings have equal anchors in
equal places. Strings next to each other that share their anchor form a segment; each
string is in exactly one. A first scan finds the anchors that repeat, a second their segments.
Segments that are equal as a whole are counted, which settles copies.

Different segments around the same anchor are cut into narrow ranges by their place
relative to it. All strings of a range have a long core in common, which becomes a single
symbol, so a range is a short string: some bytes, the core, some bytes. Equal ranges are counted
again. The others meet, by core, in tasks that build the Burrows-Wheeler transforms of shards
of them and merge these by interleave refinement; the common prefixes tell which strings
repeat. A core with very many different surroundings is split by place instead and its
strings are counted.

What one scan found reaches the next in a Bloom filter of fixed size; what that lets through
by mistake changes no result.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.bwt import repeated
from siteglass.llm.common import document_ref, parts, same_document, saved

SPAN = 200
#: First bytes of strings hashed at once.
STRETCH = 1 << 20
#: Size of a Bloom filter (16 MB), collected and broadcast.
FILTER_BITS = 27
#: Different ranges around one core that are merged in one task; more are split by place.
CROWD = 4096
#: Ranges merged at once, and in one shard.
MERGED, SHARD = 16384, 4096
_BASE = 0x9E3779B97F4A7C15
_ROOM = 22  # bits for a place in a stretch


def _mixed(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(29))
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    least, size = values, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - size : width - size + n])


class _Scanner:
    """Anchors and cores of documents laid end to end."""

    def __init__(self, span: int):
        self.span, self.gram, self.bin = span, max(span // 2, 1), max(span // 8, 1)
        self.core = span - self.bin + 1
        room = 2 * STRETCH + span
        self.up, self.down = self._powers(_BASE, room), self._powers(pow(_BASE, -1, 1 << 64), room)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def stretches(self, texts: list[bytes]):
        """Lists of (row, first byte, bytes); long texts come in parts that share span - 1 bytes."""
        rows, size = [], 0
        for row, text in enumerate(texts):
            for at in range(0, len(text) - self.span + 1, STRETCH):
                part = text[at : at + STRETCH + self.span - 1]
                rows.append((row, at, part))
                size += len(part)
                if size >= STRETCH:
                    yield rows
                    rows, size = [], 0
        if rows:
            yield rows

    def lay(self, rows: list) -> None:
        self.data = b"".join(part for _, _, part in rows)
        lengths = np.array([len(part) for _, _, part in rows])
        self.ends = np.cumsum(lengths)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.down[: len(raw)], out=self.sums[1:])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[at + length] - self.sums[at]) * self.up[at])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, place, first, last): each anchor with the range of strings that have it as theirs."""
        n = len(self.data) - self.span + 1
        own = self.hashes(np.arange(len(self.data) - self.gram + 1), self.gram)
        low = np.uint64((1 << _ROOM) - 1)
        placed = (own & ~low) | np.arange(len(own), dtype=np.uint64)
        place = (_least(placed, self.span - self.gram + 1) & low).astype(np.int64)
        edge = np.zeros(len(self.data) + 1, dtype=np.int64)
        starts = np.concatenate([[0], self.ends[:-1]])
        np.add.at(edge, starts, 1)
        np.add.at(edge, self.ends - self.span + 1, -1)
        inside = np.flatnonzero(np.cumsum(edge[:n]) > 0)
        place = place[inside]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        return own[place[first]], place[first], inside[first], inside[last]

    def segments(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for the anchors among the wanted."""
        found = self.anchors()
        keep = _among(found[0], wanted)
        own, place, first, last = (x[keep] for x in found)
        return own, place, first, last

    def digests(self, starts: np.ndarray, ends: np.ndarray, numbers: int) -> np.ndarray:
        """One or two numbers for each stretch of bytes."""
        data, size = self.data, 8 * numbers
        each = [blake2b(data[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist())]
        return np.frombuffer(b"".join(each), dtype=np.int64).reshape(-1, numbers)

    def ranges(self, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(core, first, last): segments cut at fixed distances from their anchor."""
        near, far = (place - last) // self.bin, (place - first) // self.bin
        count = far - near + 1
        which = np.repeat(np.arange(len(place)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + near[which]
        core = place[which] - self.bin * step
        return core, np.maximum(first[which], core - self.bin + 1), np.minimum(last[which], core)

    def places(self, rows: list, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Row and byte in its text for places in the stretch."""
        part = np.searchsorted(self.ends, at, side="right")
        before = np.concatenate([[0], self.ends[:-1]])
        return pa.array(np.array([r[0] for r in rows])[part]), at + (np.array([r[1] for r in rows]) - before)[part]


def _among(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (wanted[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _filter(hashes: DataFrame):
    """A Bloom filter of the values of ``hash``: 2^FILTER_BITS bits, however many values there are."""
    at = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))
    words = hashes.select(F.shiftrightunsigned(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def _scan(span: int, make):
    """A pass over documents: ``make`` turns each stretch of them into the columns of a batch."""

    def run(batches):
        scanner = _Scanner(span)
        for batch in batches:
            for part in parts(batch):
                for rows in scanner.stretches(part.column("text").to_pylist()):
                    scanner.lay(rows)
                    columns = make(scanner, part, rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], list(columns))

    return run


def _hashes(scanner, batch, rows) -> dict:
    return {"hash": scanner.anchors()[0].view(np.int64)}


def _told_apart(scanner, batch, rows, anchors) -> tuple:
    """Segments with a wanted anchor: digest and a number of the place (pick), besides what the scanner knows of them."""
    own, place, first, last = scanner.segments(anchors.value)
    digest = scanner.digests(first, last + scanner.span, 1)[:, 0].copy()
    row, start = scanner.places(rows, first)
    tie = batch.column("tie").take(row).to_numpy().view(np.uint64)
    pick = _mixed(own ^ _mixed(digest.view(np.uint64) ^ _mixed(start.astype(np.uint64) ^ _mixed(tie))))
    return own, place, first, last, digest, row, start, pick


def _kinds(anchors):
    """Anchor and digest of every segment, which name it, and a number that chooses one of its places."""

    def make(scanner, batch, rows) -> dict:
        own, _, _, _, digest, _, _, pick = _told_apart(scanner, batch, rows, anchors)
        return {"anchor": own.view(np.int64), "digest": digest, "pick": pick.view(np.int64)}

    return make


def _segments(anchors):
    """Anchor and digest of every segment, and its place."""

    def make(scanner, batch, rows) -> dict:
        own, _, first, last = scanner.segments(anchors.value)
        row, start = scanner.places(rows, first)
        return {
            "anchor": own.view(np.int64), "digest": scanner.digests(first, last + scanner.span, 1)[:, 0].copy(),
            "doc_id": batch.column("doc_id").take(row), "tie": batch.column("tie").take(row), "first": start, "last": start + last - first,
        }

    return make


def _ranges(anchors, picks):
    """The ranges of the segments at the chosen places: the core's digest, the bytes on either side, and the place."""

    def make(scanner, batch, rows) -> dict:
        _, place, first, last, _, _, _, pick = _told_apart(scanner, batch, rows, anchors)
        keep = _among(pick, picks.value)
        core, first, last = scanner.ranges(place[keep], first[keep], last[keep])
        digests = scanner.digests(core, core + scanner.core, 2)
        row, start = scanner.places(rows, first)
        data, size, span = scanner.data, scanner.core, scanner.span
        return {
            "core_a": digests[:, 0].copy(), "core_b": digests[:, 1].copy(),
            "left": pa.array([data[a:c] for a, c in zip(first.tolist(), core.tolist())], pa.binary()),
            "right": pa.array([data[c + size : b + span] for c, b in zip(core.tolist(), last.tolist())], pa.binary()),
            "doc_id": batch.column("doc_id").take(row), "tie": batch.column("tie").take(row), "start": start,
        }

    return make


def _symbols(cores: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Ranges as strings: bytes (plus 1), the core's number after those, bytes, and 0 at the end."""
    flat = np.frombuffer(b"".join(x for l, r in zip(left, right) for x in (l, b"\0", r, b"\0")), dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    lefts, sizes = np.array(list(map(len, left))), np.array(list(map(len, right))) + 2
    ends = np.cumsum(lefts + sizes)
    flat[ends - sizes] = cores + 257
    flat[ends - 1] = 0
    return flat


def _merge(bin_size: int):
    """Of ranges sorted by core: for each the places, from its first, of strings that occur in another too."""

    def solve(rows: list[tuple]) -> list[np.ndarray]:
        numbers: dict = {}
        cores = np.array([numbers.setdefault(r[0], len(numbers)) for r in rows], dtype=np.uint16)
        shards = [slice(k, k + SHARD) for k in range(0, len(rows), SHARD)]
        strings = [_symbols(cores[s], [r[1] for r in rows[s]], [r[2] for r in rows[s]]) for s in shards]
        found = repeated(strings, bin_size)
        out = []
        for s, marks in zip(shards, found):
            at = 0
            for _, left, right, *_ in rows[s]:
                size = len(left) + len(right) + 2
                out.append(np.flatnonzero(marks[at : at + size - bin_size]))
                at += size
        return out

    def run(batches):
        waiting: list[tuple] = []

        def settled(rows):
            hits = solve(rows)
            kept = [(r, h) for r, h in zip(rows, hits) if r[3] == 1 and len(h)]
            columns = [pa.array([r[4][k] for r, _ in kept], t) for k, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([h.tolist() for _, h in kept], pa.list_(pa.int32()))], [*names, "hits"])

        names = ("doc_id", "tie", "start")
        for batch in batches:
            types = [batch.schema.field(c).type for c in names]
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            places = list(zip(*(columns[c] for c in names)))
            waiting += zip(zip(columns["core_a"], columns["core_b"]), columns["left"], columns["right"], columns["n"], places)
            while len(waiting) > MERGED + CROWD:
                cut = MERGED
                while waiting[cut][0] == waiting[cut - 1][0]:
                    cut -= 1
                yield settled(waiting[:cut])
                waiting = waiting[cut:]
        if waiting:
            yield settled(waiting)

    return run


def repeated_strings(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, tie, first, last): places where strings of ``span`` bytes start that occur elsewhere too.

    Equal rows of ``docs`` are copies of each other; both are listed.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(*document_ref(), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= span)
    hashes = texts.mapInArrow(_scan(span, _hashes), "hash bigint")
    anchors = _filter(hashes.groupBy("hash").count().where("count > 1"))

    # Scanning twice costs less than keeping every segment.
    segment = ["anchor", "digest"]
    kinds = texts.mapInArrow(_scan(span, _kinds(anchors)), "anchor bigint, digest bigint, pick bigint")
    distinct = saved(kinds.groupBy(segment).agg(F.count("*").alias("n"), F.min("pick").alias("pick")), "segments")
    placed = texts.mapInArrow(_scan(span, _segments(anchors)), f"anchor bigint, digest bigint, doc_id {kind}, tie bigint, first bigint, last bigint")
    copied = saved(distinct.where("n > 1").select(segment), "copied")
    whole = placed.join(copied, segment, "left_semi").select("doc_id", "tie", "first", "last")
    # Of a segment that occurs often one place stands for all: the others are settled.
    shared = saved(distinct.groupBy("anchor").count().where("count > 1").select("anchor"), "shared")
    unlike = _filter(distinct.join(shared, "anchor", "left_semi").select(F.col("pick").alias("hash")))

    columns = f"core_a bigint, core_b bigint, left binary, right binary, doc_id {kind}, tie bigint, start bigint"
    ranges = saved(texts.mapInArrow(_scan(span, _ranges(anchors, unlike)), columns), "ranges")
    bin_size = _Scanner(span).bin
    core, surroundings = ["core_a", "core_b"], ["core_a", "core_b", "left", "right"]
    places = F.octet_length("left") + F.octet_length("right") - (bin_size - 1)
    place = F.struct("doc_id", "tie", "start")
    distinct = saved(ranges.groupBy(surroundings).agg(F.count("*").alias("n"), F.first(place).alias("place")), "surroundings")
    copied = ranges.join(distinct.where("n > 1").select(surroundings), surroundings, "left_semi")
    whole = whole.union(copied.select("doc_id", "tie", F.col("start").alias("first"), (F.col("start") + places).alias("last")))

    crowds = saved(distinct.groupBy(core).agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowds")
    several = distinct.join(crowds, core).select(*surroundings, "n", "crowd", "place.*")
    sorted_by_core = several.where(F.col("crowd") <= CROWD).drop("crowd").repartition(*core).sortWithinPartitions(*core)
    merged = sorted_by_core.mapInArrow(_merge(bin_size), f"doc_id {kind}, tie bigint, start bigint, hits array<int>")
    apart = merged.select("doc_id", "tie", F.explode(F.transform("hits", lambda h: F.col("start") + h)).alias("first"))

    spread = several.where(F.col("crowd") > CROWD).withColumn("hit", F.explode(F.sequence(F.lit(0), places.cast("int"))))
    before = F.octet_length("left") - F.col("hit")
    string = F.concat(F.substring("left", F.col("hit") + 1, F.lit(bin_size)), F.substring("right", F.lit(1), bin_size - 1 - before))
    spread = spread.withColumns({"before": before, "string": string})
    key = [*core, "before", "string"]
    often = saved(spread.groupBy(key).agg(F.sum("n").alias("n")).where("n > 1").select(key), "often")
    crowded = spread.where("n = 1").join(often, key, "left_semi").select("doc_id", "tie", (F.col("start") + F.col("hit")).alias("first"))
    single = apart.union(crowded).withColumn("last", F.col("first"))
    return whole.union(single)


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) without the bytes that repeated strings of ``span`` bytes cover.

    Columns: doc_id, kept (bytes), n_bytes, n_removed, n_spans (maximal removed runs). All
    occurrences go, overlapping ones and those in one document included, judged on
    the input. A NULL text counts as empty. Further columns are ignored.
    """

    def cut(batches):
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                text = text or b""
                covered = np.zeros(len(text) + 1, dtype=np.int32)
                if found:
                    first, more = np.array(found) >> 16, np.array(found) & 65535
                    np.add.at(covered, first, 1)
                    np.add.at(covered, first + more + span, -1)
                gone = np.cumsum(covered[:-1]) > 0
                kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if found else text)
                sizes.append(len(text))
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans))],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    stretch = F.shiftleft("first", 16) + (F.col("last") - F.col("first"))
    places = repeated_strings(docs, span).groupBy("doc_id", "tie").agg(F.collect_list(stretch).alias("found"))
    texts = docs.select(*document_ref(), F.col("text").cast("binary").alias("text")).alias("d")
    joined = texts.join(places.alias("p"), same_document("d", "p"), "left").select("d.doc_id", "text", "found")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
