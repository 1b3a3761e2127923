import random

import pytest
import xxhash

from siteglass.llm import simhash
from siteglass.llm.common import connected_components, table
from siteglass.llm.queries import op9_simhash
from tests.llm.corpus import documents, empty


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(pairs, radius=2):
    """pairs: (doc_id, fp) -> component of each fp."""
    least = {}
    for d, fp in pairs:
        least.setdefault(fp, []).append(d)
    group = {fp: fp for fp in least}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    fps = list(least)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                group[top(a)] = top(b)
    out = {}
    for fp in fps:
        ids = [d for d in least[fp] if d is not None]
        root = top(fp)
        out[root] = min([*ids, *([out[root]] if out.get(root) is not None else [])], default=None)
    return {fp: out[top(fp)] for fp in fps}


def test_fingerprints_and_components(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    expected = sorted((r.doc_id is None, r.doc_id or 0, f := brute_fingerprint(r.text), want[f] is None, want[f] or 0) for r in rows)
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id is None, r.component_id or 0) for r in found) == expected


@pytest.mark.parametrize("tile", [8192, 5])
def test_tiles_lose_no_link(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", 3)
    rng = random.Random(1)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 12])):
            fps.add(fp)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                fp ^= 1 << b
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), tile=tile)
    assert all(((r.src ^ r.dst) % 2**64).bit_count() <= 64 for r in links.collect())
    labels = {r.node: r.label for r in connected_components(links).collect()}
    want = brute_components([(s, s % 2**64) for s in signed])
    assert {s: labels.get(s, s) for s in signed} == {s: want[s % 2**64] for s in signed}


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    monkeypatch.setattr(simhash, "PIECE_BYTES", 100)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(path + hub + [(5, 5)], "src bigint, dst bigint")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = docs.select("doc_id", "text").distinct().collect()
    want = brute_components([((r.doc_id is None, r.doc_id, r.text or "", r.text is None), brute_fingerprint(r.text)) for r in rows])
    assert kept.count() == len(set(want.values()))
    assert {brute_fingerprint(r.text) for r in kept.collect()} <= set(want)


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.without_near_duplicates(empty(spark)).collect() == []


def test_query(spark):
    rows = op9_simhash(spark, "/root/testdata/sf0.001").collect()
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted(
        (r.doc_id, f"{(f := brute_fingerprint(r.text)):016x}", want[f]) for r in docs
    )
