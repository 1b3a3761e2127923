import numpy as np
import pyarrow as pa
import pytest

from siteglass.llm import ann
from siteglass.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0, 2) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, every=20, k=20):
    rows = list({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    size = max((len(v) for _, v in rows), default=0)
    ids = np.array([i for i, _ in rows], dtype=np.int64)
    full = np.array([np.pad(np.array(v, np.float32).astype(float), (0, size - len(v))) for _, v in rows]).reshape(len(rows), size)
    out = []
    for i in range(len(rows)):
        if ids[i] % every == 0:
            scores = ann.exact(full, np.tile(full[i], (len(rows), 1)))
            near = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
            out += [(int(ids[i]), r, int(ids[j]), scores[j]) for r, j in enumerate(near, 1)]
    return sorted(out)


def vectors(n=700, size=32, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)).astype(np.float32)
    x[: n // 3] = x[n - 1]  # a third are copies of one vector
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("settings", [{}, {"query_block": 7}])
def test_exact_with_copies_and_awkward_rows(spark, settings):
    rows = vectors()
    rows += [rows[3], (1000, None), (1001, [0.0] * 32), (1002, [1.0, None]), (1003, [float("nan")] * 32), (1004, [float("inf")]), (None, rows[1][1]), (1020, [1.0, 2.0]), (-40, rows[9][1]), (1040, [])]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame(spark, rows), **settings).collect())
    assert found == brute(rows)


@pytest.mark.parametrize("size", [1e-20, 3e37])
def test_very_small_and_large_components(spark, size):
    rows = [(i, [float(np.float32(size * c)) for c in v]) for i, v in vectors(150)]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame(spark, rows)).collect())
    assert found == brute(rows)


def test_few_and_no_candidates(spark):
    rows = vectors(5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame(spark, rows)).collect()) == brute(rows)
    assert ann.search(frame(spark, [(0, [1.0])])).collect() == []
    assert ann.search(frame(spark, [])).collect() == []
    assert ann.search(frame(spark, [(1, [1.0]), (2, [2.0])])).collect() == []


def test_bounds_hold(spark):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(50, 64))
    centre, turned = x.mean(axis=0), ann.rotation(64, 1)
    assert turned.shape == (64, 384) and np.allclose(turned @ turned.T, np.eye(64))
    code = ann.codes(x, centre, turned)
    assert code[0].dtype == np.uint8 and code[0].shape == (3000, 48)
    estimate, slack = ann.bounds(code, ann.Asked(q, centre, turned), slice(0, 50), ann.CONFIDENCE)
    error = estimate - x @ q.T
    assert (np.abs(error) > slack).mean() < 0.001
    # No bias; the spread is what 384 bits leave: about 0.75 of the lengths' product over the root of 384.
    spread = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :] / 384**0.5
    assert abs((error / spread).mean()) < 0.05 and 0.6 < (error / spread).std() < 0.9


def test_counts_of_bits_are_the_product_with_the_whole_numbers():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(70, 20)), rng.normal(size=(9, 20))
    centre, turned = x.mean(axis=0), ann.rotation(20, 1)
    asked = ann.Asked(q, centre, turned)
    code = ann.codes(x, centre, turned)
    signs = np.unpackbits(code[0], axis=1).astype(float) * 2 - 1
    aimed = (q / np.linalg.norm(q, axis=1)[:, None]) @ turned
    whole = np.rint((aimed - asked.low[:, None]) / asked.step[:, None])
    rough = whole * asked.step[:, None] + asked.low[:, None]
    want = (signs @ rough.T) * (code[1] * code[2] / np.sqrt(turned.shape[1]))[:, None] * asked.length + q @ centre
    assert 0 <= whole.min() and whole.max() == (1 << ann.PLANES) - 1 and np.allclose(ann.bounds(code, asked, slice(0, 9), 4.0)[0], want)


def test_vectors_are_read_for_few_pairs_only(spark, monkeypatch):
    """The scan reads codes alone; what it hands on is a small share of all pairs."""
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    asked = []
    saved = ann.saved

    def noted(df, name):
        if name == "codes":
            assert df.columns == ["key_a", "key_b", "code", "far", "correction", "scale"]
        out = saved(df, name)
        if name == "near":
            asked.append(out.where("key_a is not null").selectExpr("sum(size(queries))").first()[0])
        return out

    monkeypatch.setattr(ann, "saved", noted)
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(rows).collect())
    n = rows.count()
    assert found == brute([(r.vec_id, r.embedding) for r in rows.collect()])
    assert sum(asked) < 0.2 * n * (n // 20)  # of 2,000 vectors, of which 20 are wanted; fewer of more


def test_many_ids_of_one_vector(spark):
    rng = np.random.default_rng(9)
    one = [float(c) for c in rng.normal(size=8).astype(np.float32)]
    rows = [(i, one) for i in range(300)] + [(i, [float(c) for c in rng.normal(size=8).astype(np.float32)]) for i in range(300, 340)]
    rows += [(400 + i, [2.0 if j == i % 4 else 0.0 for j in range(8)]) for i in range(60)] + [(500, [5.0, 5.0, 5.0, 5.0, 0.0, 0.0, 0.0, 0.0])]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame(spark, rows)).collect())
    assert found == brute(rows)
    kinds = ann._kinds(ann.usable(frame(spark, rows)).distinct(), 20).collect()
    assert len(kinds) == 46 and max(len(r.ids) for r in kinds) == 21


def test_exact_scores_are_sorted_a_few_times_only(spark, monkeypatch):
    """A pair waits until many others are there: sorts go with the pairs, not with the blocks that bring them."""
    rng, sorts = np.random.default_rng(2), []
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(len(keys[0])) or lexsort(keys))

    class Shared:
        value = (np.arange(40) * 20, rng.normal(size=(40, 16)), None, None)

    x = rng.normal(size=(3000, 16))
    every = pa.array([list(range(40))] * 1000, pa.list_(pa.int32()))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(list(x[i : i + 1000])), pa.array([[j, j + 5000] for j in range(i, i + 1000)]), every], ["vector", "ids", "queries"])
        for i in (0, 1000, 2000)
    ]
    (out,) = ann._scorer(Shared, 16, 3)(batches)
    assert sum(sorts) < 2 * 3000 * 40 and len(sorts) <= 3
    found = sorted(zip(out.column("query").to_pylist(), out.column("score").to_pylist(), out.column("ids").to_pylist()))
    want = []
    for q in range(40):
        scores = ann.exact(x, np.tile(Shared.value[1][q], (3000, 1)))
        want += [(q, scores[j], [int(j), int(j) + 5000]) for j in np.argsort(-scores)[:4]]
    assert found == sorted(want) and out.column("query_id").to_pylist() == [20 * q for q in out.column("query").to_pylist()]
