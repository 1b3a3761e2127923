import hashlib
import random
import time
from zlib import crc32

import numpy as np
import pytest

from siteglass.llm import periods
from siteglass.llm.common import table
from siteglass.llm.queries import made_periodic, op12_periodic_runs
from tests.llm.corpus import documents, empty


def brute_runs(words, least=12):
    """All runs: for every period, the stretches in which words that far apart are the same."""
    best, n = {}, len(words)
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    symbols = np.array([codes[w] for w in words])
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], symbols[q:] == symbols[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for a, b in zip(edges[::2], edges[1::2]):
            if b + q - a >= max(least, 2 * q):
                best.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in best.items())


def brute_kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def brute_changed(doc_id, text):
    words = (text or "").encode().split()
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(300):
        least, texts = rng.choice([2, 3, 4, 5, 6, 7, 8, 12, 13, 20]), []
        for _ in range(rng.randint(1, 4)):
            k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 60)
            words = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 6)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        assert [[tuple(r) for r in f.tolist()] for f in periods.texts_runs(texts, least)] == [brute_runs(t, least) for t in texts]


def test_asked_in_steps(monkeypatch):
    monkeypatch.setattr(periods, "ASKED", 7)
    rng = random.Random(9)
    words = [b"%d" % rng.randrange(2) for _ in range(400)]
    assert [tuple(r) for r in periods.texts_runs([words])[0].tolist()] == brute_runs(words)


def test_long_texts_take_no_square_of_their_length():
    began = time.time()
    assert periods.texts_runs([[b"a"] * 300_000])[0].tolist() == [[0, 300_000, 1]]
    a, b = [b"a"], [b"b"]
    while len(a) < 300_000:
        a, b = a + b, a
    assert len(periods.texts_runs([a])[0]) > 10_000
    assert time.time() - began < 60


def test_query(spark):
    docs = {r.doc_id: brute_changed(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    found = op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(docs) and sum(r.n_runs for r in found) > 10
    for r in found:
        want = brute_runs(docs[r.doc_id])
        best = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in want)
        assert r.n_runs == len(want) and r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(brute_kept(docs[r.doc_id], want))).hexdigest()


def test_awkward_rows(spark):
    docs = documents(spark)
    refrain = "la la la\tland\n" * 9
    more = spark.createDataFrame([(500, refrain, *["x"] * 2, 1, 0.5, "y"), (500, refrain, *["x"] * 2, 1, 0.5, "y"), (None, refrain, *["x"] * 2, 1, 0.5, "y")], docs.schema)
    changed = made_periodic(docs.union(more))
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.union(more).collect())
    for (_, d, before), r in zip(texts, sorted(changed.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))):
        if (r.doc_id or 0) not in (7, 4):  # ids that several texts share
            assert (r.text or "").encode().split() == brute_changed(r.doc_id, before)
    found = periods.periodic_runs(docs.union(more)).collect()
    assert len(found) == docs.count() + 3
    for r in found:
        words = (r.collapsed or "").split(" ")
        assert r.collapsed is not None and r.n_words >= len(words) - 1
    mine = [r for r in found if [tuple(x) for x in r.runs] == [(0, 36, 4)]]
    assert len(mine) == 3 and all(r.collapsed == "la la la land" for r in mine)
    assert periods.periodic_runs(empty(spark)).collect() == []
