"""Near duplicates by word shingles: texts whose sets of shingles have a Jaccard similarity of at
least a given one.

Texts with equal sets collapse to one row first. Wide SimHash fingerprints of the sets (``by_fingerprints``)
or least values under many permutations, taken in bands (``near_duplicates``), propose who may be similar.
Near fingerprints hand on a spanning forest of their links; everyone in a bucket of a band is
tied to its smallest member, never to all. These ties are checked on the shingles themselves.
Where what is tied together isn't confirmed as one group, all pairs between its parts are
checked, in tiles. Components of the confirmed links are found by joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import connected_components, parts, saved
from siteglass.llm.simhash import SEED, wide_fingerprint, wide_links, word_lists

#: Words in a shingle, and the similarity from which two texts are near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Two texts of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 for 0.8.
BANDS, ROWS = 20, 5
#: Members and bytes of shingles in a tile on average; shingles permuted at once.
TILE, TILE_BYTES, STRIP = 256, 4 << 20, 4096
_FACTORS, _TERMS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 values of the word shingles, in order. A text of fewer words is one shingle."""
    digest, found, carried = xxhash.xxh64_intdigest, [], []
    for words in word_lists(data):
        words = carried + words
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts = np.concatenate([[0], ends[: len(words) - shingle]]).tolist()
            stops = (ends[shingle - 1 :] - 1).tolist()
            found.append(np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)))
            words = words[len(words) - shingle + 1 :] if shingle > 1 else []
        carried = words
    if not found:
        return np.array([digest(b" ".join(carried), SEED)] if carried else [], dtype=np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def bands(values: np.ndarray) -> list[int]:
    """A number for each band; none for an empty set."""
    if not len(values):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(values), STRIP):
        np.minimum(least, (values[i : i + STRIP] * _FACTORS + _TERMS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _mark(sketch):
    def run(batches):
        for batch in batches:
            for part in parts(batch):
                sets = [shingle_set(t or b"") for t in part.column("text").to_pylist()]
                nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
                sketches = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
                columns = [part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), sketches]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "size", "sketch"])

    return run


def _sets(batches):
    for batch in batches:
        for part in parts(batch):
            sets = [shingle_set(t or b"").tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])


def _alike(shared, a: int, b, similarity: float):
    return shared >= similarity * (a + b - shared) - 1e-9


def _check(similarity: float):
    """Keeps the links (src, dst) whose sets (ours, theirs) are similar."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, "ours"):
                keep = []
                for x, y in zip(part.column("ours").to_pylist(), part.column("theirs").to_pylist()):
                    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    near = min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-9
                    keep.append(bool(near and _alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), similarity)))
                yield part.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def tile_links(ours: list, theirs: list, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between similar members (node, part, shingles) of two tiles that unite their parts.
    Pairs whose parts are united already are left out."""
    top: dict[int, int] = {m["part"]: m["part"] for m in (*ours, *theirs)}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    b = [np.frombuffer(m["shingles"], np.uint64) for m in theirs]
    sizes = np.array([len(s) for s in b])
    known, codes = np.unique(np.concatenate(b), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = []
    for m in ours:
        a = np.frombuffer(m["shingles"], np.uint64)
        at = np.minimum(np.searchsorted(known, a), len(known) - 1)
        held = np.zeros(len(known), dtype=np.int64)
        held[at[known[at] == a]] = 1
        shared = np.add.reduceat(held[codes], starts)
        for j in np.flatnonzero(_alike(shared, len(a), sizes, similarity)).tolist():
            x, y = root(m["part"]), root(theirs[j]["part"])
            if x != y:
                top[x] = y
                out.append((m["node"], theirs[j]["node"]))
    return out


def _compare(similarity: float):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ours, theirs = (batch.column(c)[k].as_py() for c in ("ours", "theirs"))
                links = tile_links(ours, theirs, similarity)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["src", "dst"])

    return run


def _between_parts(tied: DataFrame, confirmed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs among what ``tied`` puts together and ``confirmed`` doesn't."""
    divided = saved(
        tied.join(confirmed.select("node", F.col("label").alias("part")), "node", "left")
        .select("node", "label", F.coalesce("part", "node").alias("part")),
        "divided",
    )
    open_labels = divided.groupBy("label").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("label")
    members = saved(divided.join(open_labels, "label").join(sets, "node").select("label", "node", "part", "shingles"), "members")
    chunks = F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.length("shingles")) / TILE_BYTES)).cast("int")
    sizes = saved(members.groupBy("label").agg(chunks.alias("chunks")), "sizes")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")
    tiles = saved(
        members.join(sizes, "label").groupBy("label", "chunks", chunk).agg(F.collect_list(F.struct("node", "part", "shingles")).alias("ours")),
        "tiles",
    )
    within = tiles.select("ours", F.col("ours").alias("theirs"))
    across = (
        tiles.where("chunk < chunks - 1")
        .select("label", "ours", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("chunk"))
        .join(tiles.select("label", "chunk", F.col("ours").alias("theirs")), ["label", "chunk"]).select("ours", "theirs")
    )
    return within.union(across).mapInArrow(_compare(similarity), "src bigint, dst bigint")


def band_ties(distinct: DataFrame, similarity: float) -> DataFrame:
    """Ties (src, dst) of everyone in a bucket of a band to its smallest member."""
    rows = distinct.select("node", F.explode("sketch").alias("band"))
    hubs = saved(
        rows.groupBy("band").agg(F.min("node").alias("dst"), F.max("node").alias("last")).where("dst <> last").select("band", "dst"), "hubs"
    )
    return rows.join(hubs, "band").where("node <> dst").select(F.col("node").alias("src"), "dst")


def by_fingerprints(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """:func:`near_duplicates`, proposed by SimHash: every text whose wide fingerprint is near another's is checked."""
    return near_duplicates(docs, similarity, wide_fingerprint, wide_links)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, sketch=bands, ties_of=band_ties) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, component_id, the smallest doc_id reachable
    over texts of at least this similarity. ``doc_id`` names one text. Texts without words are alike.

    ``sketch`` makes a list of numbers of a set; ``ties_of`` proposes links from these (node, size, sketch).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    marked = saved(texts.mapInArrow(_mark(sketch), f"doc_id {kind}, node bigint, size int, sketch array<bigint>"), "marked")
    distinct = saved(
        marked.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.max("size").alias("size"), F.max("sketch").alias("sketch")), "distinct"
    )
    ties = saved(ties_of(distinct, similarity).distinct(), "ties")
    tied = connected_components(ties)
    chosen = distinct.select("node", "least_id").join(tied.select("node"), "node", "left_semi")
    shown = texts.join(chosen, texts.doc_id == chosen.least_id).select("node", "text")
    sets = saved(shown.mapInArrow(_sets, "node bigint, shingles binary").dropDuplicates(["node"]), "sets")
    ours, theirs = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("src", "ours"), ("dst", "theirs")))
    checked = saved(ties.join(ours, "src").join(theirs, "dst").select("src", "dst", "ours", "theirs").mapInArrow(_check(similarity), "src bigint, dst bigint"), "checked")
    more = saved(_between_parts(tied, connected_components(checked), sets, similarity), "more")
    labels = connected_components(checked.union(more))
    rooted = saved(distinct.join(labels, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("root")), "rooted")
    named = saved(rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("node", "component_id"), "named")
    return marked.join(named, "node").select("doc_id", "component_id")
