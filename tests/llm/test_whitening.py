import math

import numpy as np
import pytest

from siteglass.llm import whitening
from siteglass.llm.common import table
from siteglass.llm.queries import op11_whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, component double"


def frame(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "own", 2.0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors):
    """Whole numbers, n, exact deviations, eigenvalues and eigenvectors in exact and long arithmetic."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = [[n * a - b for a, b in zip(row, sums)] for row in x]
    deviation = [sum(a * a for a in row) for row in off]
    z = np.array(off, dtype=np.longdouble) / n
    values, vectors = np.linalg.eigh(np.array(z.T @ z / n, dtype=float))
    return n, deviation, np.array(z, dtype=float), values[::-1], vectors[:, ::-1]


def check(found, vectors, ids, top):
    n, deviation, z, values, directions = brute(vectors)
    by = {(r.vec_id, r.component): r for r in found}
    assert len(found) == len(by) == len(ids) * top
    for k in range(top):
        want = z @ directions[:, k] / math.sqrt(values[k])
        got = np.array([by[i, k + 1].whitened for i in ids])
        want *= np.sign(want[np.abs(want).argmax()] * got[np.abs(want).argmax()])
        assert np.abs(got - want).max() < 1e-6
        for i, d in zip(ids, deviation):
            r = by[i, k + 1]
            assert (r.n, r.deviation) == (n, d) and r.identity_error < 1e-9
            assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9


def test_query_on_the_whole_table(spark):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings").collect()
    check(op11_whitening(spark, "/root/testdata/sf0.01").collect(), [r.embedding for r in rows], [r.vec_id for r in rows], 8)


def test_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 40)
    rng = np.random.default_rng(4)
    good = (rng.normal(size=(150, 6)) * [9, 5, 3, 2, 1, 0.5]).astype(np.float32).tolist()
    good += [good[3], good[3], [0.0] * 6]
    bad = [None, [], [1.0, None, 1, 1, 1, 1], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1e30] + [1.0] * 5, [1.0, 2.0]]
    found = whitening.whiten(frame(spark, good + bad)).collect()
    check(found, good, list(range(len(good))), 6)
    same = whitening.whiten(frame(spark, bad + [[2.0] * 3] * 2 + [[1.0] * 6])).collect()
    assert same == []  # most vectors have two or three entries, none of those vary
    missing = frame(spark, good).selectExpr("if(vec_id < 3, null, vec_id) vec_id", "embedding", "label")
    assert sum(r.vec_id is None for r in whitening.whiten(missing).collect()) == 18


@pytest.mark.parametrize("spread", [1.0, 3e-3, 0.0])
def test_dependent_dimensions(spark, spread):
    """A constant dimension, an exact copy, a near copy and widths that differ a million times."""
    rng = np.random.default_rng(7)
    base = np.rint(rng.normal(size=(400, 4)) * [2000.0, 30.0, 1.0, 0.01] * 1024) / 1024
    near = np.rint((base[:, 0] + spread * rng.normal(size=400)) * 1024) / 1024
    all_ = np.column_stack([base, np.full(400, 7.0), base[:, 0], near]).astype(np.float32)
    found = whitening.whiten(frame(spark, all_.tolist())).collect()
    z = brute(all_.tolist())[2]
    values = np.linalg.svd(z, compute_uv=False) ** 2 / 400
    top = max(r.component for r in found)
    assert top == (5 if spread else 4)
    w = np.array([r.whitened for r in sorted(found, key=lambda r: (r.vec_id, r.component))]).reshape(400, top)
    assert np.abs(w.T @ w / 400 - np.eye(top)).max() < 1e-6 and max(r.identity_error for r in found) < 1e-6
    for k in range(top):
        assert abs([r.explained for r in found if r.component == k + 1][0] / (values[k] / values.sum()) - 1) < 1e-4


def test_few_or_no_vectors(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]):
        assert whitening.whiten(frame(spark, vectors, 2)).collect() == []
    two = whitening.whiten(frame(spark, [[1.0, 2.0], [2.0, 2.0]], 2)).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.n, r.deviation) for r in two) == [(0, 1, 1.0, 2, 1024**2), (1, 1, 1.0, 2, 1024**2)]


def test_deviations_beyond_64_bits(spark):
    wide = [[4.0e9, 1.0], [-4.0e9, 2.0], [0.0, 3.0], [1.0, 4.0]]
    n, deviation, *_ = brute(wide)
    found = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, wide)).collect()}
    assert found == {i: d if d < 1 << 63 else None for i, d in enumerate(deviation)} and None in found.values()


def test_substitution():
    rng = np.random.default_rng(2)
    upper, rows = np.triu(rng.normal(size=(5, 5))) + 3 * np.eye(5), rng.normal(size=(5, 20))
    assert np.allclose(upper.T @ whitening.solve_lower(upper, rows), rows)
