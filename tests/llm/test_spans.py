import re
import zlib

from siteglass.llm import spans
from siteglass.llm.common import table
from siteglass.llm.queries import op1_sentence_spans
from tests.llm.corpus import colliding, documents, empty, words


def brute(docs, length=3, least=12):
    """docs: (doc_id, text) -> {(doc_id, text): (kept, sentences, removed)}; written apart from the operator."""
    cut = {}
    for d, t in set(docs):
        if t is None:
            continue
        parts, lengths = [], []
        data, at, ahead = t.encode(), 0, b""
        bounds = [m.end() for m in re.finditer(rb"[.!?][^0-9A-Za-z\x80-\xff\s]*\s+|\s*\n\s*", data)] + [len(data)]
        for end in bounds:
            tokens = re.findall(rb"\S+\s*", data[at:end])
            total, blank = len(tokens), not tokens
            lead = data[at:end][: len(data[at:end]) - len(data[at:end].lstrip())]
            while tokens:
                marks = [k for k, w in enumerate(tokens[:24], 1) if zlib.crc32(w.rstrip().lower()) % 8 == 0 or k == 24]
                some = tokens[: marks[0]] if total > 12 and marks else tokens
                tokens = tokens[len(some) :]
                parts.append(lead + b"".join(some))
                lengths.append(len(some))
                lead = b""
            if blank and parts:
                parts[-1] += data[at:end]
            elif blank:
                ahead += data[at:end]
            at = end
        cut[d, t] = (parts, lengths, ahead)
    places = {}
    for (d, t), (parts, lengths, _) in cut.items():
        for a in range(len(parts)):
            b = a + length
            while b <= len(parts) and sum(lengths[a:b]) < least:
                b += 1
            if b <= len(parts):
                key = b"\n".join(b" ".join(p.split()).lower() for p in parts[a:b])
                places.setdefault(key, []).append((d is not None, d or 0, d, t, a, b))
    gone = {k: set() for k in cut}
    for found in places.values():
        if len(found) > 1:
            least_id = min(f[:2] for f in found)
            firsts = [f for f in found if f[:2] == least_id]
            one_doc = len({f[3] for f in firsts}) == 1
            first = min(firsts, key=lambda f: f[4]) if one_doc else None
            for f in found:
                if f is not first:
                    gone[f[2], f[3]].update(range(f[4], f[5]))
    return {
        k: (ahead + b"".join(p for i, p in enumerate(parts) if i not in gone[k]), len(parts), len(gone[k]))
        for k, (parts, _, ahead) in cut.items()
    }


def corpus(spark):
    import random

    rng = random.Random(8)
    passage = [words(rng, rng.randint(2, 30)).capitalize() + "." for _ in range(8)]
    rows = []
    for i in range(40):
        own = [words(rng, rng.randint(1, 25)) + rng.choice([".", "!", "?!", '."', ""]) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            at = rng.randint(0, len(own))
            own[at:at] = passage[rng.randint(0, 3) : rng.randint(5, 8)]
        rows.append((100 + i, rng.choice([" ", "\n", " \n "]).join(own)))
    rows += [rows[0], rows[0], (500, rows[1][1]), (500, rows[2][1]), (501, "same here. and there. " * 30), (None, rows[3][1]), (502, " \n x"), (503, "Er. Er. Th.")]
    return rows + [(r.doc_id, r.text) for r in documents(spark).collect()]


def test_matches_brute_force(spark):
    rows = corpus(spark)
    want = brute(rows)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, start int, tie int").repartition(4)
    found = spans.without_repeats(docs).collect()
    assert len(found) == len(rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "").encode(), r.n_sentences, r.n_removed) for r in found))
    assert got == sorted((d is None, d or 0, *(want[d, t] if t is not None else (b"", 0, 0))) for d, t in rows)
    assert any(r.n_removed for r in found) and not [r.n_removed for r in found if r.doc_id == 503][0]


def test_long_passages_are_caught(spark):
    import random

    rng = random.Random(9)
    long = words(rng, 60)  # over 50 words, no sentence ends
    docs = [(i, words(rng, 20) + ".\n" + long + ".\n" + words(rng, 30) + ".") for i in range(5)] + [(9, words(rng, 300))]
    found = {r.doc_id: r.n_removed for r in spans.without_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found[0] == 0 and found[9] == 0 and all(found[i] >= 3 for i in range(1, 5))


def test_passages_inside_sentences_are_caught(spark):
    import random

    rng = random.Random(10)
    long = words(rng, 70)
    docs = [(i, words(rng, 20 + i) + " " + long + " " + words(rng, 30)) for i in range(6)] + [(9, words(rng, 300))]
    found = {r.doc_id: r.n_removed for r in spans.without_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found[0] == 0 and found[9] == 0 and all(found[i] >= 3 for i in range(1, 6))


def test_empty(spark):
    assert spans.without_repeats(empty(spark)).collect() == []


def test_query(spark):
    rows = op1_sentence_spans(spark, "/root/testdata/sf0.001").collect()
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    want = brute([(r.doc_id, r.text) for r in docs])
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in rows} == {d: x[1:] for (d, _), x in want.items()}
    assert any(r.n_removed for r in rows)


def test_texts_under_one_id_that_agree_in_32_bits(spark):
    """Three rows without id and two under one id, one of each with a repeated passage."""
    a, b = colliding(spark, 400)
    passage = " This passage comes again. It has three sentences in it. They are all the same words everywhere."
    for own in (None, 5):
        rows = [(own, a), (own, b), (own, b + passage), (1, "x." + passage), (own, a)]
        got = {(r.doc_id, r.n_sentences, r.n_removed, r.text) for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        want = {(d, n, k, kept.decode()) for (d, _), (kept, n, k) in brute(rows).items()}
        assert got == want and any(k for _, _, k, _ in got)
