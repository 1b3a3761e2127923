import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from siteglass.llm import bpe
from siteglass.llm.common import table
from siteglass.llm.queries import RANKS, op8_byte_bpe
from tests.llm.corpus import documents, empty


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as file:
        return bpe._Encoder(bpe.read_ranks(file.read()), public_tokenizers.PATTERN)


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_random_texts_as_the_reference_library(reference, encoder, monkeypatch):
    rng = random.Random(5)
    alphabets = ["abc  \n\t'", "éàüñ ß", "漢字かな", "мир ", "<|endoftext|> [INST]", "\x00\x1c\x85 ​ ", "👩‍👧 1٣½"]
    for k in range(400):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60)))
        assert encoder.encode([text]) == [packed(reference.encode_ordinary(text))], text
    for text in (" " * 3000, "a" * 5000, "ab" * 3000, "\n \n" * 500):
        assert encoder.encode([text]) == [packed(reference.encode_ordinary(text))]
    monkeypatch.setattr(bpe, "STRETCH", 12)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts = ["the cat's  hat " * 40, "", "x", "12 of them"] * 3
    assert encoder.encode(texts) == [packed(reference.encode_ordinary(t)) for t in texts]


def test_round_trip_and_edges(spark, reference):
    tokens = bpe.load_tokens(spark, RANKS)
    docs = documents(spark)
    coded = bpe.decode(bpe.encode(docs, tokens, public_tokenizers.PATTERN), tokens)
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode() and bytes(r.ids) == packed(reference.encode_ordinary(r.text or ""))
    assert bpe.decode(bpe.encode(empty(spark), tokens, public_tokenizers.PATTERN), tokens).collect() == []
    at_once = bpe.encode_and_decode(docs, tokens, public_tokenizers.PATTERN)
    assert at_once.schema == coded.schema and sorted(map(str, at_once.collect())) == sorted(map(str, rows))


def test_pipeline_stage_needs_one_python_worker_a_task(spark):
    encoded = corpus_pipeline.encoding_stage(spark, documents(spark), "")
    assert encoded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_query(spark, reference):
    found = {r.doc_id: r for r in op8_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in table(spark, "/root/testdata/sf0.001", "documents").collect():
        ids = reference.encode_ordinary(d.text)
        r = found[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        bpe.read_ranks(b"YQ== 0\nYg== 2\n")
