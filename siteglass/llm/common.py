"""What several operators share: tables, kept intermediate results, text pieces, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.sources.workspace import new_dir

#: Bytes of text that a task works on at once; longer texts go through in pieces.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs its running tasks and no finished work.
    """
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two numbers that stand for a document in joins, also where ids are missing or repeat.

    Rows that agree in id and text get the same key and count as one document.
    """
    parts = [F.col(doc_id).cast("string"), F.lit("|"), F.col(text)]
    return [F.xxhash64(*parts).alias("key_a"), F.xxhash64(F.lit("second"), *parts).alias("key_b")]


def document_ref() -> list[Column]:
    """doc_id and a 64-bit number (tie) that tells documents under the same id apart by their text.

    Texts meet by chance only in billions under one id; where ids are different nothing depends on it.
    """
    return [F.col("doc_id"), F.xxhash64(F.col("text"), F.lit("tie")).alias("tie")]


def same_document(a: str, b: str) -> Column:
    """Join condition on :func:`document_ref` between aliases a and b, for missing ids too."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tie") == F.col(f"{b}.tie"))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; NULL for a missing id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def parts(batch: pa.RecordBatch, column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts whose texts hold about ``size`` bytes together."""
    total = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    edges = [*(np.flatnonzero(np.diff(total // size)) + 1).tolist(), batch.num_rows]
    start = 0
    for end in edges:
        if end > start:
            yield batch.slice(start, end - start)
            start = end


def slices(batch: pa.RecordBatch, column: str = "text", size: int = PIECE_BYTES) -> Iterator[tuple[int, list]]:
    """The same parts as their first row and their texts."""
    start = 0
    for part in parts(batch, column, size):
        yield start, part.column(column).to_pylist()
        start += part.num_rows


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (left, right) connect it with."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        differ = a != b
        if not differ.any():
            return root
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected ``links`` (src, dst: bigint, not null);
    label is the smallest node reachable.

    Every round takes the smallest label among the neighbours and then the label of
    the label, so that paths halve. Minima combine on the map side; the links of a hub
    meet a kept table with one row per node, a join that Spark can split.
    """
    pairs = links.where("src <> dst").select("src", "dst")
    both = saved(pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = saved(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label"))
        .select("node", F.least("node", "label").alias("label"), F.lit(True).alias("changed")),
        "labels",
    )
    while not labels.where("changed").isEmpty():
        reached = (
            both.join(labels.select(F.col("node").alias("dst"), "label"), "dst")
            .groupBy(F.col("src").alias("node")).agg(F.min("label").alias("offered"))
        )
        hooked = saved(
            labels.join(reached, "node").select("node", F.col("label").alias("old"), F.least("label", "offered").alias("label")),
            "hooked",
        )
        onward = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = saved(
            hooked.join(onward, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("changed")),
            "labels",
        )
    return labels.select("node", "label")


def bounded(chosen: DataFrame, rows: int, size: int) -> DataFrame:
    """About ``rows`` rows of ``chosen`` at most, whose texts hold about ``size`` bytes together at most.

    Rows are kept by a hash of id and text, so one id that very many rows carry counts as its rows do.
    """
    n, total = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, rows / max(n, 1), size / max(total, 1))
    if share == 1.0:
        return chosen
    spread = F.pmod(F.xxhash64("doc_id", "text", F.lit("bounded")), F.lit(1 << 30)) / float(1 << 30)
    return chosen.where(spread < share)
