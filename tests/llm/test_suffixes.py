import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siteglass.llm import bwt, suffixes
from siteglass.llm.common import table
from siteglass.llm.queries import op3_suffix_repeats
from tests.llm.corpus import colliding, documents, empty


def brute(texts, span):
    """(kept, removed, runs) of each text, by counting every string."""
    counts = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - span + 1):
            if counts[t[i : i + span]] > 1:
                gone.update(range(i, i + span))
        out.append((bytes(c for i, c in enumerate(t) if i not in gone), len(gone), sum(i - 1 not in gone for i in gone)))
    return out


def strings(rng, n, size, letters):
    found = set()
    while len(found) < n:
        found.add(tuple(rng.choice(letters) for _ in range(rng.randint(1, size))))
    return sorted(found, key=lambda s: rng.random())


@pytest.mark.parametrize("seed", range(6))
def test_merged_transforms(seed):
    rng = random.Random(seed)
    own = strings(rng, 60, 12, [1, 2, 3] if seed % 2 else [1, 700])
    shards = [own[:20], own[20:21], own[21:]]
    flat = [np.array([c for s in shard for c in (*s, 0)], dtype=np.uint16) for shard in shards]
    depth = 4
    done = [bwt.shard_transform(f) for f in flat]

    def rotations(shard):
        return [(s + (0,))[k:] + (s + (0,))[:k] for s in shard for k in range(len(s) + 1)]

    for shard, (order, before) in zip(shards, done):
        rows = rotations(shard)
        endless = [(rows[i] * 30)[:60] for i in order]
        assert endless == sorted(endless) and [rows[i][-1] for i in order] == before.tolist()
    source, common = bwt.merge([b for _, b in done], depth)
    taken = [iter(order) for order, _ in done]
    merged = [(rotations(shards[k])[next(taken[k])] * 30)[:60] for k in source.tolist()]
    prefixes = [m[:depth] for m in merged]
    assert prefixes == sorted(prefixes)
    for a, b, c in zip(merged, merged[1:], common[1:]):
        assert min(depth, next(i for i in range(61) if i == 60 or a[i] != b[i])) == c
    counts = Counter(s[k : k + depth] for s in own for k in range(len(s) - depth + 1))
    marks = bwt.repeated(flat, depth)
    for shard, mark in zip(shards, marks):
        at = 0
        for s in shard:
            assert [bool(x) for x in mark[at : at + max(len(s) - depth + 1, 0)]] == [counts[s[k : k + depth]] > 1 for k in range(len(s) - depth + 1)]
            at += len(s) + 1


def awkward(rng):
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(900))
    texts = [base[rng.randint(0, 300) :][: rng.randint(10, 600)] for _ in range(30)]
    texts += [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    for _ in range(40):  # near copies
        t = bytearray(base[: rng.randint(100, 900)])
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(b"xyz")
        texts.append(bytes(t))
    texts += [b"a" * 300, b"ab" * 150, b"abc" * 7, b"", "é漢字 ".encode() * 60, base[:100], base[:100]]
    # one passage amid very many surroundings
    return texts + [bytes(rng.choice(b"0123456789") for _ in range(40)) + base[500:560] + bytes(rng.choice(b"0123456789") for _ in range(40)) for _ in range(60)]


@pytest.mark.parametrize("span", [8, 24, 50])
@pytest.mark.parametrize("crowd", [4096, 3])
def test_matches_brute_force(spark, span, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    texts = [t.decode() for t in awkward(random.Random(span))]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    rows += [rows[3], (5, "other text under a taken id", 1, "y"), (None, texts[70], 1, "y"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int, left string").repartition(3)
    want = brute([(r[1] or "").encode() for r in rows], span)
    found = suffixes.without_repeats(docs, span).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in found), key=key)
    assert got == sorted(((r[0], k, len((r[1] or "").encode()), n, s) for r, (k, n, s) in zip(rows, want)), key=key)


def test_small_stretches_and_shards(monkeypatch):
    """Long documents in parts, many shards and rounds, without Spark."""
    rng = random.Random(3)
    texts = awkward(rng)
    monkeypatch.setattr(suffixes, "STRETCH", 64)
    scanner = suffixes._Scanner(24)
    seen = Counter()
    everything = np.full(1 << (suffixes.FILTER_BITS - 6), 2**64 - 1, dtype=np.uint64)
    for rows in scanner.stretches(texts):
        scanner.lay(rows)
        core, first, last = scanner.ranges(*scanner.segments(everything)[1:])
        assert (first <= last).all() and (last <= core).all() and (core - first < scanner.bin).all()
        for a, b in zip(first.tolist(), last.tolist()):
            part = int(np.searchsorted(scanner.ends, a, side="right"))
            row, at, _ = rows[part]
            for s in range(a, b + 1):
                seen[row, s - int(scanner.ends[part - 1] if part else 0) + at] += 1
    assert seen == {(r, s): 1 for r, t in enumerate(texts) for s in range(len(t) - 23)}


def test_empty_and_edges(spark):
    assert suffixes.without_repeats(empty(spark)).collect() == []
    docs = documents(spark)
    assert suffixes.without_repeats(docs).count() == docs.count()


def test_query(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    want = {d.doc_id: w for d, w in zip(docs, brute([d.text.encode() for d in docs], 200))}
    rows = op3_suffix_repeats(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.kept_sha256, r.n_removed, r.n_spans) for r in rows} == {
        d: (hashlib.sha256(k).hexdigest(), n, s) for d, (k, n, s) in want.items()
    }
    assert any(r.n_removed for r in rows) and any(not r.n_removed for r in rows)


def test_texts_under_one_id_that_agree_in_32_bits(spark):
    a, b = colliding(spark, 700)
    for own in (None, 5):
        texts = [a, b, b[:300] + a[:60], a, "y" * 20 + b[100:450]]
        found = suffixes.without_repeats(spark.createDataFrame([(own, t) for t in texts], "doc_id bigint, text string")).collect()
        want = brute([t.encode() for t in texts], suffixes.SPAN)
        assert sorted((bytes(r.kept), r.n_removed, r.n_spans) for r in found) == sorted(want)
