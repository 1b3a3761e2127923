import zlib

import pytest
from pyspark.sql import functions as F

from siteglass.llm import quality
from siteglass.llm.common import table
from siteglass.llm.queries import op7_quality
from tests.llm.corpus import documents, empty

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"), rows=1000)


def test_held_out_accuracy(spark):
    rows = op7_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    above = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.98 and sum(r.predicted == r.quality for r in rows) > 0.97 * len(rows)


def test_edges(spark, model):
    docs = documents(spark)
    scored = quality.score(docs, model)
    assert scored.columns == [*[c for c in docs.columns if c != "score"], "score"]
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if not (r.text or "").strip()}
    assert len(blank) == 1
    assert quality.score(empty(spark), model).collect() == []


def test_long_texts_in_stretches_have_the_same_features(monkeypatch):
    text = b"Some words, and  signs!! and and again " * 50
    whole = sorted(b for _, x in quality._features(quality._Hasher(), [text]) for b in x)
    monkeypatch.setattr(quality, "STRETCH", 100)
    hasher = quality._Hasher()
    assert sorted(b for _, x in quality._features(hasher, [text]) for b in x) == whole
    assert len(list(quality._features(hasher, [b"x" * 350]))) == 4


def test_nothing_to_learn(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 5)], "doc_id bigint, quality int")
    model = quality.train(documents(spark), labels)
    assert {r.score for r in quality.score(documents(spark), model).collect()} == {0.5}


def test_labels_of_repeated_ids(spark):
    labels = table(spark, SF, "labels").where(F.col("doc_id") < 100)
    twice = quality.labelled_sample(documents(spark), labels.union(labels), "quality", 4000)
    assert twice.count() == quality.labelled_sample(documents(spark), labels, "quality", 4000).count()


def test_one_id_on_very_many_rows_stays_bounded(spark, monkeypatch):
    docs = spark.range(20_000).select(F.lit(3).cast("bigint").alias("doc_id"), F.concat(F.lit("some text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id bigint, quality int")
    n = quality.labelled_sample(docs, labels, "quality", 500).count()
    assert 400 < n < 850
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 2000)
    assert 40 < quality.labelled_sample(docs, labels, "quality", 5000).count() < 250
    assert quality.train(docs, labels, rows=50).bias != 0


def test_a_column_of_the_same_name_stays(spark, model):
    docs = spark.createDataFrame([(1, "a text", "own", 7)], "doc_id bigint, text string, __text string, __text_ int")
    row = quality.score(docs, model).collect()[0]
    assert (row["__text"], row["__text_"]) == ("own", 7) and 0 <= row.score <= 1
