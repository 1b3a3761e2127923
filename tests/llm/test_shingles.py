import random

import numpy as np
import pytest

import corpus_pipeline
from siteglass.llm import shingles, simhash
from siteglass.llm.common import connected_components, table
from tests.llm.corpus import documents, empty, words


def brute_set(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute_groups(pairs):
    """pairs: (doc_id, text) -> the smallest doc_id linked with each."""
    sets = {d: brute_set(t) for d, t in pairs}
    ids, top = sorted(sets), {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if 10 * len(x & y) >= 8 * len(x | y):
                r, s = sorted((root(a), root(b)))
                top[s] = r
    return {d: root(d) for d in ids}


def near_copies(rng, text, n):
    out = text.split()
    for _ in range(n):
        out[rng.randrange(len(out))] = "changed" + str(rng.random())
    return " ".join(out)


def made(spark):
    """Chains of copies that drift apart, and copies around the border of 0.8."""
    rng, texts = random.Random(5), []
    for _ in range(25):
        text = words(rng, rng.randint(60, 200))
        texts.append(text)
        for _ in range(6):
            text = near_copies(rng, text, rng.randint(0, max(1, len(text.split()) // 45)))
            texts.append(text)
    texts += ["one two three", "one two three", "One  two\nthree", "one two", "", None, " "]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_groups(spark, monkeypatch):
    monkeypatch.setattr(shingles, "TILE", 3)
    docs = made(spark)
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    found = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    assert found == want and 30 < len(set(want.values())) < 150


def test_bands_reach_the_border():
    """Sets of similarity 0.8 share a band; 64-bit fingerprints often differ in more than ten bits."""
    rng, missed = np.random.default_rng(3), 0
    for _ in range(2000):
        values = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        missed += not set(shingles.bands(values[:162])) & set(shingles.bands(values[18:]))
    assert missed <= 5


@pytest.mark.parametrize("tile", [16384, 7])
def test_groups_by_fingerprints(spark, monkeypatch, tile):
    monkeypatch.setattr(shingles, "TILE", 3)
    monkeypatch.setattr(shingles, "wide_links", lambda distinct, similarity: simhash.wide_links(distinct, similarity, tile))
    docs = made(spark)
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    found = {r.doc_id: r.component_id for r in shingles.by_fingerprints(docs).collect()}
    assert found == want


def test_wide_fingerprints_reach_the_border():
    """Sets of similarity 0.8, of equal and unequal sizes and small, stay within the radius; unlike ones don't."""
    rng = np.random.default_rng(3)
    radius, first = simhash.wide_radius(0.8), simhash.wide_radius(0.8, 64)
    for total, ours, theirs in ((180, 162, 162), (45, 36, 45), (10, 9, 9), (5, 5, 4)):
        for _ in range(500):
            values = rng.integers(0, 1 << 63, total, dtype=np.uint64)
            a, b = (np.array(simhash.wide_fingerprint(v)).view(np.uint64) for v in (values[:ours], values[total - theirs :]))
            apart = np.bitwise_count(a ^ b)
            assert apart.sum() <= radius and apart[0] <= first
    many = np.array([simhash.wide_fingerprint(rng.integers(0, 1 << 63, 180, dtype=np.uint64)) for _ in range(500)]).view(np.uint64)
    unlike = np.bitwise_count(many[:250] ^ many[250:]).sum(axis=1)
    assert unlike.min() > radius


def test_near_fingerprints_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_PAIRS", 20)
    rng, rows = np.random.default_rng(8), []
    for _ in range(30):
        values = rng.integers(0, 1 << 63, rng.integers(4, 400), dtype=np.uint64)
        for _ in range(rng.choice([1, 1, 6])):
            rows.append((len(rows) - 20, len(values), simhash.wide_fingerprint(values)))
            values = np.append(values[rng.random(len(values)) < 0.95], rng.integers(0, 1 << 63, len(values) // 20, dtype=np.uint64))
    words = np.array([r[2] for r in rows]).view(np.uint64)
    top = {r[0]: r[0] for r in rows}

    def root(x):
        return x if top[x] == x else root(top[x])

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            sizes = sorted((a[1], b[1]))
            if np.bitwise_count(words[i] ^ words[j]).sum() <= simhash.wide_radius(0.8) and sizes[0] >= 0.8 * sizes[1]:
                r, s = sorted((root(a[0]), root(b[0])))
                top[s] = r
    frame = spark.createDataFrame([*rows, (999, 0, [])], "node bigint, size int, sketch array<bigint>")
    for tile in (16384, 7):
        labels = {r.node: r.label for r in connected_components(simhash.wide_links(frame, 0.8, tile)).collect()}
        # Neighbouring numbers of shingles share a cell, so a link may be wider than the sizes allow; none may be lost.
        assert all(labels.get(r[0], r[0]) == labels.get(root(r[0]), root(r[0])) for r in rows) and 999 not in labels
        assert len({labels.get(r[0], r[0]) for r in rows}) >= 25


def test_pipeline_stage_goes_by_fingerprints(spark, monkeypatch):
    """The stage's pairs come from SimHash fingerprints of its texts."""
    seen = []

    def noted(distinct, similarity):
        seen.extend(r.sketch for r in distinct.collect())
        return simhash.wide_links(distinct, similarity)

    monkeypatch.setattr(shingles, "wide_links", noted)
    docs = made(spark)
    want = {tuple(simhash.wide_fingerprint(shingles.shingle_set((r.text or "").encode()))) for r in docs.collect()}
    assert corpus_pipeline.near_duplicate_stage(spark, docs, "").count() < docs.count()
    assert {tuple(s) for s in seen} == want


def test_pipeline_stage_drops_near_copies(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_groups(rows).values()))


def test_empty_and_awkward(spark):
    assert corpus_pipeline.near_duplicate_stage(spark, empty(spark), "").collect() == []
    assert corpus_pipeline.near_duplicate_stage(spark, documents(spark), "").count() > 0
