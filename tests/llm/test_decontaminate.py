import hashlib
import re

import pytest

from siteglass.llm import decontaminate
from siteglass.llm.queries import op5_decontaminate
from tests.llm.corpus import documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(UPPER))


def expected(text, items, window=13):
    words, hit, found = split(text), set(), set()
    for item, other in items:
        theirs = split(other)
        width = min(window, len(theirs))
        for k in range(len(theirs) - width + 1 if width else 0):
            for i in range(len(words) - width + 1):
                if words[i : i + width] == theirs[k : k + width]:
                    hit.update(range(i, i + width))
                    found.update([] if item is None else [str(item)])
    return len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.fixture
def benchmark(spark):
    texts = [r.text for r in documents(spark).where("text is not null").orderBy("doc_id").collect()]
    items = [(1, texts[3]), (2, "THE and,the"), (10, " ".join(texts[5].split()[:20])), (3, texts[3]), (3, None), (4, "!!"), (None, "漢字 end"), (5, texts[8].upper())]
    return spark.createDataFrame(items, "item_id bigint, text string"), items


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 300, "blocks_a_pass": 2}, {"window": 2}])
def test_matches_brute_force(spark, benchmark, settings, monkeypatch):
    items, listed = benchmark
    monkeypatch.setattr(decontaminate, "PART_WINDOWS", 7 if settings else 4096)
    for row in decontaminate.contamination(documents(spark), items, **settings).collect():
        n, hit, found, bad = expected(row.text, listed, settings.get("window", 13))
        assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (n, hit, found, bad), row.doc_id


def test_long_texts_in_pieces(spark, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 64)
    text = b"one Two, " * 100
    assert sum(decontaminate.words_of(text), []) == [b"one", b"two"] * 100


def test_spans_are_cut_and_documents_dropped(spark):
    docs = spark.createDataFrame([(1, "keep Alpha beta, gamma! tail", 5), (2, "clean " * 30, 6), (3, "alpha beta gamma " + "w " * 200, 7)], "doc_id bigint, text string, items int")
    items = spark.createDataFrame([(9, "alpha BETA gamma")], "item_id bigint, text string")
    found = decontaminate.contamination(docs, items)
    assert {r.doc_id: r.text for r in decontaminate.without_spans(found).collect()}[1] == "keep ! tail"
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_empty_tables(spark, benchmark):
    items, _ = benchmark
    assert decontaminate.contamination(empty(spark), items).collect() == []
    rows = decontaminate.contamination(documents(spark), items.limit(0)).collect()
    assert rows and all(r.n_hit == 0 and not r.contaminated for r in rows) and any(r.n_words for r in rows)


def test_query(spark):
    rows = op5_decontaminate(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and any(r.contaminated for r in rows)
    assert all(r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if not r.n_items)
