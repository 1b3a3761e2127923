import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from siteglass.llm import pieces
from siteglass.llm.bpe import _field
from siteglass.llm.common import table
from siteglass.llm.queries import PIECES, op13_sentencepiece
from tests.llm.corpus import documents, empty


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PIECES, "rb") as file:
        return pieces.read_model(file.read())


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def random_texts(library, n, seed):
    rng = random.Random(seed)
    alphabets = ["abcdefgh  \n\t'", "éàüñ ß", "漢字かな", "мир ", "<0x0A><s></s>[INST]▁", "\x00\x1c\x85 ​ ", "👩‍👧 1٣½", "the ing er and ion est ", "aaaa    "]
    for k in range(n):
        if k % 2:
            yield "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60)))
        else:
            yield "".join(library.id_to_piece(rng.randrange(3, len(library))).replace("▁", " ") for _ in range(rng.randint(0, 8)))


@pytest.mark.parametrize("long", [pieces.LONG, 8, 1])
def test_random_texts_as_the_library(library, vocabulary, long):
    """With any border between merge rounds and the queue."""
    encoder, decoder = pieces.Encoder(vocabulary, long), pieces.Decoder(vocabulary)
    texts = list(random_texts(library, 3000, 5))
    for text, packed in zip(texts, encoder.encode(texts)):
        want = library.encode(text)
        assert ids(packed) == want, text
        assert decoder.decode(want) == library.decode(want) == text.replace("▁", " ")


def test_any_ids_decode_as_the_library(library, vocabulary):
    decoder, rng = pieces.Decoder(vocabulary), random.Random(8)
    for _ in range(5000):
        some = [rng.randrange(len(library)) if rng.random() < 0.4 else rng.randrange(300) for _ in range(rng.randint(0, 12))]
        assert decoder.decode(some) == library.decode(some), some


def test_long_texts_and_short_memory(library, vocabulary, monkeypatch):
    encoder = pieces.Encoder(vocabulary)
    for text in (" " * 5000, "a" * 5000, "ab" * 3000, "\n \n" * 500, "x" * 100_000):
        assert ids(encoder.encode([text])[0]) == library.encode(text)
    monkeypatch.setattr(pieces, "STRETCH", 12)
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    texts = ["the cat's  hat " * 40, "", "x", "12 of them"] * 3
    assert [ids(p) for p in encoder.encode(texts)] == [library.encode(t) for t in texts]


def made(words, fallback=True):
    """A model file of the given pieces by rank."""
    own = [(b"<unk>", 0.0, 2), (b"<s>", 0.0, 3)] + [(b"<0x%02X>" % b, 0.0, 6) for b in range(256 if fallback else 0)]
    own += [(w.encode(), float(-r), 1) for r, w in words]
    data = b"".join(_field(1, _field(1, p) + _field(2, s) + _field(3, k)) for p, s, k in own)
    trainer = _field(3, 2) + _field(4, len(own)) + (_field(35, 1) if fallback else b"") + _field(40, 0) + _field(41, 1) + b"".join(_field(n, (1 << 64) - 1) for n in (42, 43))
    return data + _field(2, trainer) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))


@pytest.mark.parametrize("fallback", [True, False])
def test_vocabularies_with_ties_and_reversed_ranks(fallback):
    """Pieces that make better pieces than themselves, share a rank, or reach across blanks."""
    rng = random.Random(3)
    for _ in range(60):
        words = [(0, c) for c in rng.sample("abc▁", 3)]
        for _ in range(rng.randint(1, 14)):
            words.append((rng.randrange(1, 9), "".join(rng.choice("abc▁") for _ in range(rng.randint(2, 4)))))
        words = [*{w: (r, w) for r, w in words}.values()]
        data = made(words, fallback)
        library, vocabulary = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.read_model(data)
        texts = ["".join(rng.choice("abc aé\n") for _ in range(rng.randint(0, 25))) for _ in range(40)]
        for long in (3, 100):
            encoder = pieces.Encoder(vocabulary, long)
            for text, packed in zip(texts, encoder.encode(texts)):
                assert ids(packed) == library.encode(text), (words, text)
        for text in texts:
            assert pieces.Decoder(vocabulary).decode(library.encode(text)) == library.decode(library.encode(text))


def test_other_models_are_refused():
    plain = made([(1, "ab")])
    pieces.read_model(plain)
    for spoilt in (_field(2, _field(3, 1)), _field(3, _field(4, 1)), _field(1, _field(1, b"x") + _field(3, 4))):
        with pytest.raises(ValueError):
            pieces.read_model(plain + spoilt)


def test_round_trip_and_edges(spark, library):
    vocabulary = pieces.load_vocabulary(spark, PIECES)
    docs = documents(spark).withColumnRenamed("fp", "decoded")
    coded = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    assert coded.columns == [*(c for c in docs.columns if c != "decoded"), "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.decoded == (r.text or "") and r.ids == library.encode(r.text or "")
    assert pieces.decode(pieces.encode(empty(spark), vocabulary), vocabulary).collect() == []


def test_query(spark, library):
    found = {r.doc_id: r for r in op13_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for d in table(spark, "/root/testdata/sf0.001", "documents").collect():
        want = library.encode(d.text)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, want)), library.decode(want))]
        r = found[d.doc_id]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(want), *digests]
