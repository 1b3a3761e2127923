"""The closest comparable projects of named projects.

Comparable means: same technology, another name, and a capacity between ``low``
and ``high`` times the project's own. The ``n`` largest are wanted.

Joining all pairs in the band would grow with the square of a popular technology,
so no pair is ever formed. Instead rows and questions are laid out together in
order of capacity, each question at the upper end of its band, and read once. At any
point of that order every possible answer is among the *recent rows*: of the rows
just passed, the latest ``n`` of each name, and of those the latest ``2n``. A question
skips at most ``n`` of them (its own name) and so finds its ``n`` there. The recent
rows of two neighbouring stretches combine into those of both, which lets the order
be cut anywhere: into equal slices by range, whatever technology, capacity or name is
frequent. Every slice hands on the recent rows it ends with, and what a question
lacks in its own slice it finds in those of the slices before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteglass.operators.filters import first_by_name
from siteglass.sources.workspace import ensure_checkpoint_dir

ROW, QUESTION = 0, 1
_ROW_COLUMNS = ("ref_id", "site_name", "capacity_mw", "region", "status", "score")
# Up to this many rows a table of inherited rows is sent to every task.
_BROADCAST_ROWS = 100_000
# Up to this many names are part of a condition; more are joined.
_FEW_NAMES = 10
# Merged bands that a condition may hold.
_BANDS = 200


def comparables(df: DataFrame, low: float = 0.7, high: float = 1.3, n: int = 5) -> DataFrame:
    """Up to ``n`` comparables, ranked by capacity, of the first record of every name.

    Ties in capacity go to the lower ``ref_id``. The call itself reads ``df``: it
    runs the pass and keeps its results in the checkpoint folder, which it needs.
    """
    return _answered(_layout(df, high), low, n)


def comparables_among(df: DataFrame, names: DataFrame, low: float = 0.7, high: float = 1.3, n: int = 5) -> DataFrame:
    """The same for the names in column ``site_name`` of a table, however many; those that don't occur give no rows.

    The bands of their first records, merged where they touch, become one condition that reaches
    the scan; the rows it lets through are read in one pass like all rows in ``comparables``.
    The call looks the names up and keeps their records in the checkpoint folder.
    """
    ensure_checkpoint_dir(df.sparkSession)
    wanted = names.select("site_name").where(F.col("site_name").isNotNull()).distinct()
    few = [row.site_name for row in wanted.limit(_FEW_NAMES + 1).collect()]
    # A few names are looked up at the scan, like one.
    held = df.where(F.col("site_name").isin(few)) if len(few) <= _FEW_NAMES else df.join(wanted, "site_name", "left_semi")
    chosen = _comparable(first_by_name(held)).checkpoint()
    return _answered(_laid_out(_comparable(df).where(_in_bands(chosen, low, high)), chosen, high), low, n)


def _in_bands(questions: DataFrame, low: float, high: float) -> Column:
    """Whether a row can be comparable to any question: its capacity lies in a merged band of its technology.

    Bands are taken up to whole steps of the logarithm, a few each, so their number follows the range of
    capacities and not the number of questions. Many bands are merged further, up to one a technology.
    """
    if not 0 < low <= 1 <= high:
        return F.lit(True)
    step = math.log(max(high / low, 1.01)) / 8
    positive = F.col("capacity_mw") > 0
    # One step more on either side takes up the rounding.
    first = F.floor((F.ln("capacity_mw") + math.log(low)) / step) - 1
    last = F.floor((F.ln("capacity_mw") + math.log(high)) / step) + 1
    held = questions.where(positive & (F.col("capacity_mw") < float("inf")))
    steps = held.select("technology", F.explode(F.sequence(first, last)).alias("step")).distinct()
    order = Window.partitionBy("technology").orderBy("step")
    island = F.col("step") - F.row_number().over(order)
    bands = steps.withColumn("island", island).groupBy("technology", "island").agg(F.min("step").alias("a"), F.max("step").alias("b"))
    if bands.count() > _BANDS:
        bands = bands.groupBy("technology").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    found = bands.orderBy("technology", "a").limit(_BANDS + 1).collect()
    # Without a band of their own: no capacity, which only equals itself, and an infinite one.
    odd = F.col("capacity_mw").isin(0.0, float("inf"))
    if len(found) > _BANDS:
        return F.lit(True)
    own = [
        (F.col("technology") == r.technology) & F.col("capacity_mw").between(math.exp(r.a * step), math.exp((r.b + 1) * step)) for r in found
    ]
    return reduce(or_, own, odd)


def _answered(laid: DataFrame, low: float, n: int) -> DataFrame:
    """Comparables of every question among the rows of a layout."""
    ensure_checkpoint_dir(laid.sparkSession)
    # Answers and summaries come out of one pass, so its results are kept where lost
    # executors cannot take them along. Each slice stays one partition.
    passed = _read_in_order(laid, ["slice", "technology"], _reader(n, low)).checkpoint()
    asked = passed.where(F.col("kind") == QUESTION)
    answers = asked.join(_inherited_rows(passed, n), ["slice", "technology"], "left").select(
        "technology",
        "payload.ref_id",
        "payload.site_name",
        "payload.capacity_mw",
        "rows",
        F.coalesce("inherited", F.array().cast(passed.schema["rows"].dataType)).alias("inherited"),
    )
    # What a question lacks in its own slice it finds further back.
    further = F.filter(
        F.col("inherited"),
        lambda row: ~row["site_name"].eqNullSafe(F.col("site_name"))
        & (row["capacity_mw"] >= F.col("capacity_mw") * F.lit(low)),
    )
    found = F.when(F.size("rows") == n, F.col("rows")).otherwise(F.slice(F.concat("rows", further), 1, n))
    return _placed(answers.select("ref_id", "site_name", "technology", "capacity_mw", found.alias("found")))


def comparables_of(df: DataFrame, *names: str, low: float = 0.7, high: float = 1.3, n: int = 5) -> DataFrame:
    """The same for the chosen names only.

    The call looks up the first record of each name (one small row a name); technology
    and band then are constants that reach the scan, and only the ``n`` largest
    rows are ever sorted. Names that don't occur, or whose record has no band, give no rows.
    """
    first = first_by_name(df.where(F.col("site_name").isin(*names))) if names else df.limit(0)
    tables = []
    for own in _comparable(first).orderBy("ref_id").collect():
        band = F.col("capacity_mw").between(own["capacity_mw"] * low, own["capacity_mw"] * high)
        others = _comparable(df.where((F.col("technology") == own["technology"]) & band)).where(
            ~F.col("site_name").eqNullSafe(own["site_name"])
        )
        nearest = others.orderBy(F.desc("capacity_mw"), "ref_id").limit(n)
        found = F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("capacity_mw")).alias("order"), *_ROW_COLUMNS))),
            lambda row: F.struct(*[row[name].alias(name) for name in _ROW_COLUMNS]),
        )
        tables.append(
            nearest.groupBy("technology").agg(found.alias("found")).select(
                F.lit(own["ref_id"]).cast("bigint").alias("ref_id"), F.lit(own["site_name"]).alias("site_name"),
                "technology", F.lit(own["capacity_mw"]).cast("double").alias("capacity_mw"), "found",
            )
        )
    if not tables:
        nothing = F.array().cast(T.ArrayType(_comparable(df).select(F.struct(*_ROW_COLUMNS).alias("row")).schema["row"].dataType))
        tables = [_comparable(df).limit(0).select("ref_id", "site_name", "technology", "capacity_mw", nothing.alias("found"))]
    return _placed(reduce(DataFrame.union, tables))


def _placed(answers: DataFrame) -> DataFrame:
    """One row per question and comparable, from the arrays in ``found``."""
    return answers.select(
        "ref_id", "site_name", "technology", "capacity_mw", F.posexplode("found").alias("position", "other")
    ).select(
        "ref_id",
        "site_name",
        "technology",
        "capacity_mw",
        (F.col("position") + 1).alias("place"),
        *[F.col(f"other.{name}").alias(f"comparable_{name}") for name in _ROW_COLUMNS],
    )


def _comparable(df: DataFrame) -> DataFrame:
    """Rows that have a band at all: with a technology and a capacity of 0 or more."""
    return df.where(F.col("technology").isNotNull() & (F.col("capacity_mw") >= 0)).select(
        "technology", *_ROW_COLUMNS
    )


def _layout(df: DataFrame, high: float) -> DataFrame:
    """All rows, and the question of every name, in slices by range."""
    return _laid_out(_comparable(df), _comparable(first_by_name(df)), high)


def _laid_out(rows: DataFrame, questions: DataFrame, high: float) -> DataFrame:
    """Rows and questions in slices by range. Only this and the first record per name move rows."""
    asked = _events(questions, F.col("capacity_mw") * F.lit(high), QUESTION)
    laid = _events(rows, F.col("capacity_mw"), ROW).unionByName(asked).repartitionByRange("technology", "at", "kind", F.desc("ref_id"))
    return laid.sortWithinPartitions("technology", "at", "kind", F.desc("ref_id")).withColumn("slice", F.spark_partition_id())


def _events(df: DataFrame, at: Column, kind: int) -> DataFrame:
    return df.select(
        "technology", at.alias("at"), F.lit(kind).alias("kind"), "ref_id", F.struct(*_ROW_COLUMNS).alias("payload")
    )


def _inherited_rows(passed: DataFrame, n: int) -> DataFrame:
    """(slice, technology, inherited): the recent rows of all slices before a slice.

    Works on what the pass handed on, at most ``2n`` rows per technology and slice, so
    its size follows the number of slices and not the data.
    """
    ends = passed.where(F.col("kind") == ROW)
    handed_on = ends.select("technology", "slice", F.posexplode("rows").alias("place", "payload"))
    # The latest comes first among the rows handed on and must be read last. What a
    # slice inherits is asked before its own rows; its number travels as ref_id.
    rows = handed_on.select("technology", "slice", (-F.col("place")).alias("at"), F.lit(ROW).alias("kind"), "payload")
    number = F.col("slice").cast("bigint")
    blank = [
        number.alias("ref_id") if field.name == "ref_id" else F.lit(None).cast(field.dataType).alias(field.name)
        for field in passed.schema["payload"].dataType
    ]
    asked = passed.select("technology", "slice").distinct().select(
        "technology", "slice", F.lit(None).cast("int").alias("at"), F.lit(QUESTION).alias("kind"), F.struct(*blank).alias("payload")
    )
    summary = rows.unionByName(asked).repartition("technology").sortWithinPartitions("technology", "slice", "at")
    inherited = (
        _read_in_order(summary, ["technology"], _reader(n, None))
        .where((F.col("kind") == QUESTION) & (F.size("rows") > 0))
        .select(F.col("payload.ref_id").cast("int").alias("slice"), "technology", F.col("rows").alias("inherited"))
    )
    # Only a technology that reaches across a cut inherits: at most one per slice.
    slices = passed.rdd.getNumPartitions()
    return F.broadcast(inherited) if slices * 2 * n <= _BROADCAST_ROWS else inherited


def _read_in_order(events: DataFrame, groups: list[str], reader: Callable) -> DataFrame:
    """The group's columns, kind, payload and rows of every question, and of the end of every group."""
    ordered = events.select(F.struct(*groups).alias("group"), "kind", "payload")
    payload = events.schema["payload"].dataType
    schema = T.StructType(
        [
            T.StructField("group", ordered.schema["group"].dataType),
            T.StructField("kind", T.IntegerType()),
            T.StructField("payload", payload),
            T.StructField("rows", T.ArrayType(payload)),
        ]
    )
    return ordered.mapInArrow(reader, schema).select("group.*", "kind", "payload", "rows")


def _reader(n: int, low: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over ordered events that carries only the recent rows of the current group along.

    With ``low`` a question gets its ``n`` comparables, without it all recent rows. The
    end of a group gives an event of kind ``ROW`` with its recent rows, latest first.
    The function is complete in itself: workers need not have this package.
    """

    def recent(np, rows, names):
        """Of rows (positions in order) the latest n of each name, and of those the latest 2n; latest first."""
        kept, held = [], {}
        for i in reversed(rows.tolist()):
            if held.setdefault(names[i], 0) < n:
                held[names[i]] += 1
                kept.append(i)
                if len(kept) == 2 * n:
                    break
        return np.array(kept, dtype=np.int64)

    def nearest(np, questions, rows, seen, first, names, capacities):
        """For each question the latest n rows before it of another name and within the band.

        Looks back over a window of rows, which widens for the few questions whose own name fills it.
        """
        found, width = [None] * len(questions), 4 * n
        pending = np.arange(len(questions))
        while len(pending):
            later = []
            for some in np.array_split(pending, -(-len(pending) * width // (1 << 20))):
                at = seen[some, None] - 1 - np.arange(width)
                there = rows[np.maximum(at, 0)] if len(rows) else np.zeros(at.shape, np.int64)
                own = questions[some]
                enough = capacities[there] >= capacities[own, None] * low
                fits = (at >= first[some, None]) & (names[there] != names[own, None]) & enough
                fits &= fits.cumsum(axis=1) <= n
                done = (fits.sum(axis=1) == n) | (at[:, -1] <= first[some]) | ~enough[:, -1]
                for k, i in enumerate(some.tolist()):
                    if done[k]:
                        found[i] = there[k, fits[k]]
                later.append(some[~done])
            pending, width = np.concatenate(later), width * 4
        return found

    def read(batches):
        import numpy as np

        def codes(column):
            """A number per value, -1 for NULL."""
            return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

        def handed_out(batch, asked, kinds, picks):
            ends = np.concatenate([[0], np.cumsum([len(p) for p in picks], dtype=np.int64)])
            flat = np.concatenate([np.zeros(0, np.int64), *picks]).astype(np.int64)
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), batch.column("payload").take(pa.array(flat)))
            chosen = batch.take(pa.array(asked, pa.int64()))
            return pa.RecordBatch.from_arrays(
                [chosen.column("group"), pa.array(kinds, pa.int32()), chosen.column("payload"), rows],
                ["group", "kind", "payload", "rows"],
            )

        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            payload = batch.column("payload")
            keys = np.stack([codes(part) for part in batch.column("group").flatten()])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            names, capacities = codes(payload.field("site_name")), payload.field("capacity_mw").to_numpy(zero_copy_only=False)
            asks = batch.column("kind").to_numpy() == 1
            rows, questions = np.flatnonzero(~asks), np.flatnonzero(asks)
            seen = np.cumsum(~asks) - ~asks
            first = seen[starts]
            group = np.searchsorted(starts, questions, side="right") - 1
            if low is None:
                picks = [recent(np, rows[first[g] : seen[q]], names) for q, g in zip(questions, group)]
            else:
                picks = nearest(np, questions, rows, seen[questions], first[group], names, capacities)
            last = [recent(np, rows[a:b], names) for a, b in zip(first, [*first[1:], len(rows)])]
            # The last group may go on in the next batch; the others end here.
            ended = [(a, r) for a, r in zip(starts, last[:-1]) if len(r)]
            yield handed_out(
                batch, [*questions, *(r[0] for _, r in ended)], [1] * len(questions) + [0] * len(ended), [*picks, *(r for _, r in ended)]
            )
            held = batch.take(pa.array(last[-1][::-1], pa.int64()))
        if held is not None and held.num_rows:
            yield handed_out(held, [0], [0], [np.arange(held.num_rows)[::-1]])

    return read
