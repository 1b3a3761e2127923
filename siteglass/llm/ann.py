"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, normalised, extended by zeros and rotated at random; a code keeps one bit
for each dimension after that, packed, the distance from the centre and a correction scalar (how well
the bits point where the vector points). Codes are made once, of each different vector, and kept. A scan reads only
them: queries, rotated alike, are cut down to whole numbers of a few bits, and counts of the bits that code and
query have in common estimate the inner product, with an error bound that falls with the root of the number of bits.
Vectors whose upper bound reaches the lower bound of enough others are fetched and evaluated exactly.
All queries meet all codes, in blocks of a bounded size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.llm.common import saved

#: Vectors (a fixed choice by hash) that give the centre and the first lower bounds.
SAMPLE_ROWS = 16384
#: Queries broadcast at once, and codes and queries estimated at once.
QUERY_BLOCK, CODE_BLOCK, ASKED_BLOCK = 16384, 1024, 128
#: Exact scores that wait for each other before they are sorted, and bytes of vectors scored at once.
WAITING_PAIRS, SCORED_BYTES = 1 << 17, 1 << 19
#: Bits of a query's component.
PLANES = 3
#: Bits of a code: six for each dimension, 384 at least, in whole words.
BITS_A_DIMENSION, LEAST_BITS = 6, 384
#: Width of the error bound, in standard deviations of the estimate.
CONFIDENCE = 4.0


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vector) that can take part: ids and components present and finite, not all zero."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    )
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("vector", lambda x: x != 0))


def rotation(size: int, seed: int) -> np.ndarray:
    """Where a random rotation takes vectors of ``size`` components and zeros after these; the same everywhere."""
    bits = -(-max(LEAST_BITS, BITS_A_DIMENSION * size) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, size)))
    return (q * np.sign(np.diag(r))).T


def _matrix(column, size: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, offsets = np.asarray(column.values.to_numpy(zero_copy_only=False)), np.asarray(column.offsets)
    flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
    lengths = np.diff(offsets)
    out = np.zeros((len(column), size))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)] = flat
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components: equal vectors score equally."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def codes(vectors: np.ndarray, centre: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, distance from the centre, correction scalar and error scale of each vector."""
    away = vectors - centre
    far = np.sqrt((away * away).sum(axis=1))
    unit = (away / np.where(far > 0, far, 1)[:, None]) @ turned
    bits = unit > 0
    agreement = np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1])
    agreement = np.where(far > 0, agreement, 1)
    scale = np.sqrt(np.maximum(1 - agreement**2, 0) / agreement**2 / max(unit.shape[1] - 1, 1))
    return np.packbits(bits, axis=1), far, 1 / agreement, scale


class Asked:
    """Queries as whole numbers of :data:`PLANES` bits a component, each bit packed into words of its own."""

    def __init__(self, queries: np.ndarray, centre: np.ndarray, turned: np.ndarray):
        bits = turned.shape[1]
        self.length = np.sqrt((queries * queries).sum(axis=1))
        aimed = (queries / self.length[:, None]) @ turned
        self.low = aimed.min(axis=1)
        self.step = np.maximum((aimed.max(axis=1) - self.low) / ((1 << PLANES) - 1), np.finfo(float).tiny)
        whole = np.rint((aimed - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = whole.sum(axis=1, dtype=np.int64)
        self.planes = [np.packbits((whole >> j) & 1, axis=1).view(np.uint64) for j in range(PLANES)]
        # What the whole numbers miss, as the spread it gives a sum of random signs.
        self.missed = np.sqrt(((aimed - (whole * self.step[:, None] + self.low[:, None])) ** 2).sum(axis=1) / bits)
        self.middle = queries @ centre
        self.middle_slack = 1e-9 * np.abs(queries) @ np.abs(centre)


def bounds(code: tuple, asked: Asked, chosen: slice, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (codes by chosen queries) and their error bounds, from counts of common bits."""
    packed, far, correction, scale = code
    words = np.ascontiguousarray(packed).view(np.uint64)
    bits = 64 * words.shape[1]
    common = np.zeros((len(words), len(asked.low[chosen])), dtype=np.int32)
    both, counted = np.empty(common.shape, np.uint64), np.empty(common.shape, np.uint8)
    for j, plane in enumerate(asked.planes):
        held = np.zeros(common.shape, np.uint16)
        for w in range(words.shape[1]):
            np.bitwise_and(words[:, w, None], plane[chosen, w][None, :], out=both)
            np.bitwise_count(both, out=counted)
            held += counted
        common += held.astype(np.int32) << j
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    # Signs are twice the bits less one.
    signed = (2 * common - asked.total[chosen]) * asked.step[chosen] + asked.low[chosen] * (2 * ones - bits)[:, None]
    estimate = signed * (far * correction / np.sqrt(bits))[:, None] * asked.length[chosen] + asked.middle[chosen]
    spread = np.sqrt((scale**2)[:, None] + (correction[:, None] * asked.missed[chosen]) ** 2)
    slack = far[:, None] * (confidence * spread + 1e-9) * asked.length[chosen] + asked.middle_slack[chosen]
    return estimate, slack


class _Best:
    """The greatest ``k`` scores so far of each query of a block, from different vectors; ``floor`` is the least of them."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, score: np.ndarray) -> None:
        query, score = np.append(self.query, query), np.append(self.score, score)
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score = query[keep], score[keep]
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])


def search(vectors: DataFrame, every: int = 20, k: int = 20, confidence: float = CONFIDENCE, seed: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query found, nearest first, ties to the smaller vec_id.

    ``vectors``: vec_id, embedding (array of numbers). Queries are the rows whose vec_id ``every``
    divides; candidates are all rows of another vec_id. Nearness is the inner product in double
    precision; vectors of different lengths count as ending in zeros. Rows without id,
    and vectors that are null, zero or hold null or non-finite components take no part.
    Rows with equal id and vector count once; of the rows with one vector only the k + 1 smallest ids can be
    near anything. Queries that share an id are answered each on its own.
    """
    spark = vectors.sparkSession
    rows = saved(usable(vectors).distinct(), "vectors")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size = rows.agg(F.max(F.size("vector"))).first()[0]
    if not size:
        return empty
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vector")
    n = rows.count()
    spread = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where(spread < SAMPLE_ROWS / n).toArrow()
    sample, sample_ids = _matrix(taken.column("vector"), size), taken.column("vec_id").to_numpy()
    centre = sample.mean(axis=0) if len(sample) else np.zeros(size)
    turned = rotation(size, seed)
    kinds = saved(_kinds(rows, k), "kinds")
    coded = saved(kinds.select("key_a", "key_b", "vector").mapInArrow(_coder(size, centre, turned), _CODE), "codes")
    found = []
    for block in _query_blocks(queries, query_block):
        asked, ids = _matrix(block.column("vector"), size), block.column("vec_id").to_numpy()
        shared = spark.sparkContext.broadcast((ids, asked, _floors(ids, asked, sample_ids, sample, k), Asked(asked, centre, turned)))
        near = saved(coded.mapInArrow(_scanner(shared, k, confidence), _NEAR), "near")
        floor = spark.sparkContext.broadcast(_common_floors(near, len(ids), k))
        hits = near.where("key_a is not null").mapInArrow(_pruner(floor), _NEAR).select("key_a", "key_b", "queries")
        scored = kinds.join(hits, ["key_a", "key_b"]).select("vector", "ids", "queries").mapInArrow(
            _scorer(shared, size, k), "query int, query_id bigint, ids array<bigint>, score double"
        )
        each = scored.select("query", "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(saved(ranked.select("query_id", "rank", "vec_id", "score"), "nearest"))
        shared.destroy()  # the block's result is kept; the next block takes its place
        floor.destroy()
    return reduce(DataFrame.union, found, empty)


_NEAR = "key_a bigint, key_b bigint, queries array<int>, bounds array<double>"
_CODE = "key_a bigint, key_b bigint, code binary, far double, correction double, scale double"


def _kinds(rows: DataFrame, k: int) -> DataFrame:
    """Each different vector under a key of 128 bits, with the ids that can be near anything: the k + 1 smallest."""
    key = [F.xxhash64("vector").alias("key_a"), F.xxhash64(F.lit("second"), "vector").alias("key_b")]
    place = F.row_number().over(Window.partitionBy("key_a", "key_b").orderBy("vec_id"))
    first = rows.select("vec_id", "vector", *key).withColumn("place", place).where(F.col("place") <= k + 1)
    return first.groupBy("key_a", "key_b").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))


def _coder(size: int, centre: np.ndarray, turned: np.ndarray):
    def run(batches):
        for batch in batches:
            packed, *scalars = codes(_matrix(batch.column("vector"), size), centre, turned)
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))])
            columns = [batch.column("key_a"), batch.column("key_b"), code.cast(pa.binary()), *map(pa.array, scalars)]
            yield pa.RecordBatch.from_arrays(columns, ["key_a", "key_b", "code", "far", "correction", "scale"])

    return run


def _query_blocks(queries: DataFrame, most: int):
    """The queries as Arrow tables of about ``most`` rows, one at a time."""
    n = queries.count()
    blocks = -(-n // most)
    for b in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow() if blocks > 1 else queries.toArrow()


def _floors(ids: np.ndarray, asked: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k-th nearest reaches at least: the k-th best of the sample."""
    floors = np.full(len(ids), -np.inf)
    if len(sample) > k:
        for i in range(0, len(ids), 512):
            scores = asked[i : i + 512] @ sample.T
            scores[ids[i : i + 512, None] == sample_ids[None, :]] = -np.inf
            best = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]
            floors[i : i + 512] = np.where(np.isfinite(best), best - 1e-9 * (1 + np.abs(best)), -np.inf)
    return floors


def _lists(rows: np.ndarray, n: int, *values: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Rows (of n) that have any values, and lists of these; ``rows`` says whose each value is, in order."""
    counts = np.bincount(rows, minlength=n)
    held = np.flatnonzero(counts)
    ends = pa.array(np.append(0, np.cumsum(counts[held])).astype(np.int32))
    return held, [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]


def _scanner(shared, k: int, confidence: float):
    """Of the codes in a task, those that may be near: the queries and upper bounds of each. Reads no vector.

    A last row without key has the task's greatest lower bounds of each query.
    """

    def run(batches):
        ids, _, floors, asked = shared.value
        # One more than wanted: a query's own vector may be among them.
        best = _Best(k + 1, floors)
        names = ["key_a", "key_b", "queries", "bounds"]
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            scalars = [batch.column(c).to_numpy() for c in ("far", "correction", "scale")]
            for i in range(0, batch.num_rows, CODE_BLOCK):
                some = slice(i, i + CODE_BLOCK)
                code = (bits[some], *(x[some] for x in scalars))
                hits = []
                for j in range(0, len(ids), ASKED_BLOCK):
                    estimate, slack = bounds(code, asked, slice(j, j + ASKED_BLOCK), confidence)
                    v, q = np.nonzero(estimate + slack >= best.floor[None, j : j + ASKED_BLOCK])
                    hits.append((v, q + j, (estimate - slack)[v, q], (estimate + slack)[v, q]))
                v, q, lower, upper = map(np.concatenate, zip(*hits))
                best.add(q, lower)
                keep = np.flatnonzero(upper >= best.floor[q])
                keep = keep[np.argsort(v[keep], kind="stable")]
                held, lists = _lists(v[keep], len(code[0]), q[keep].astype(np.int32), upper[keep])
                rows = pa.array(held + i)
                yield pa.RecordBatch.from_arrays([batch.column("key_a").take(rows), batch.column("key_b").take(rows), *lists], names)
        none = pa.nulls(1, pa.int64())
        _, lists = _lists(np.zeros(len(best.query), np.int64), 1, best.query.astype(np.int32), best.score)
        if len(lists[0]):
            yield pa.RecordBatch.from_arrays([none, none, *lists], names)

    return run


def _common_floors(near: DataFrame, n: int, k: int) -> np.ndarray:
    """For each of n queries the (k + 1)-th greatest lower bound of all tasks; a number for each query of a block."""
    lows = near.where("key_a is null").select(F.explode(F.arrays_zip("queries", "bounds")).alias("b")).select("b.queries", "b.bounds")
    place = F.row_number().over(Window.partitionBy("queries").orderBy(F.desc("bounds")))
    floors = np.full(n, -np.inf)
    for query, low in lows.withColumn("place", place).where(F.col("place") == k + 1).select("queries", "bounds").collect():
        floors[query] = low
    return floors


def _pruner(floor):
    """The rows of a scan without the queries that bounds of other tasks rule out."""

    def run(batches):
        for batch in batches:
            queries, uppers = batch.column("queries"), batch.column("bounds")
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(queries.offsets)))
            query, upper = queries.flatten().to_numpy(), uppers.flatten().to_numpy()
            keep = upper >= floor.value[query]
            held, lists = _lists(row[keep], batch.num_rows, query[keep], upper[keep])
            rows = pa.array(held)
            yield pa.RecordBatch.from_arrays([batch.column("key_a").take(rows), batch.column("key_b").take(rows), *lists], batch.schema.names)

    return run


class _Nearest:
    """The ``k`` + 1 nearest of each query so far, ties to the smaller least id. Pairs wait until they are many, so that
    a pair is sorted a few times at most; ``floor`` is the least score that can still be among the nearest."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.waiting: list[tuple] = []
        self.most, self.many = max(WAITING_PAIRS, 2 * n * (k + 1)), 0

    def add(self, query: np.ndarray, score: np.ndarray, least: np.ndarray, place: np.ndarray) -> None:
        self.waiting.append((query, score, least, place))
        self.many += len(query)
        if self.many > self.most:
            self.settle()

    def settle(self) -> None:
        query, score, least, place = map(np.concatenate, zip(self.held, *self.waiting))
        self.waiting, self.many = [], 0
        order = np.lexsort((least, -score, query))
        query, score, least, place = query[order], score[order], least[order], place[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k
        self.floor[query[last]] = score[last]
        keep = rank <= self.k
        self.held = query[keep], score[keep], least[keep], place[keep]


def _scorer(shared, size: int, k: int):
    """Exact scores of fetched vectors: of each query the k + 1 nearest in a task, ties to the smaller id."""

    def run(batches):
        ids, asked, _, _ = shared.value
        best = _Nearest(len(ids), k)
        names: list[pa.Array] = []
        first_place = 0
        for batch in batches:
            names.append(batch.column("ids"))
            least = pc.list_element(names[-1], 0).to_numpy()
            counts = np.diff(np.asarray(batch.column("queries").offsets))
            step = max(1, SCORED_BYTES // (8 * size * max(1, int(counts.max(initial=1)))))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                own = _matrix(part.column("vector"), size)
                near = part.column("queries").flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(own)), counts[i : i + step])
                new = exact(own[row], asked[near])
                reach = new >= best.floor[near]
                row, near, new = row[reach], near[reach], new[reach]
                best.add(near, new, least[i + row], first_place + i + row)
            first_place += batch.num_rows
        best.settle()
        query, score, _, place = best.held
        lists = pa.chunked_array(names, pa.list_(pa.int64())).take(pa.array(place)).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(ids[query]), lists, pa.array(score)],
            ["query", "query_id", "ids", "score"],
        )

    return run
