import itertools
import zlib

import numpy as np

from sparkloom.llm import language as L
from sparkloom.llm.queries import op7_language_id


def test_query_predicts_held_out_rows(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert sum(held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def brute_total(word, pieces, probs):
    """The sum over all ways to cut the word, one by one."""
    word, total = "_" + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        p = 1.0
        for x in parts:
            p *= probs[pieces.index(x)] if x in pieces else probs[len(pieces)] if len(x) == 1 else 0.0
        total += p
    return total


def small_model():
    pieces = ["_", "a", "b", "ab", "_a", "ba", "aba", "_ab", "c"]
    rng = np.random.default_rng(3)
    probs = rng.random((len(pieces) + 1, 2))
    return pieces, L.Languages(["x", "y"], pieces, probs / probs.sum(axis=0), 100)


def test_forward_sums_are_those_of_all_segmentations():
    pieces, model = small_model()
    words = ["a", "ab", "abab", "cab", "zab", "bbabaz", "éa"]
    got = np.exp(model.word_scores(words))
    for w, row in zip(words, got):
        for lang in (0, 1):
            assert np.isclose(row[lang], brute_total(w, pieces, model.probs[:, lang]))
    long = "abc" * 10
    assert np.allclose(model._long(long), model.word_scores([long])[0])


def test_expected_counts_are_a_gradient():
    """Expected counts are p times the derivative of the log likelihood by p."""
    _, model = small_model()
    lattice, counts = L.Lattice(["abab", "cab"], model.vocab), np.array([[2.0, 0.0], [1.0, 3.0]])
    like = lambda p: (np.log(lattice.total(lattice.forward(p))) * counts).sum()
    want = lattice.expected(model.probs, counts)
    for i in range(len(model.probs)):
        for lang in (0, 1):
            p = model.probs.copy()
            p[i, lang] += 1e-7
            assert np.isclose((like(p) - like(model.probs)) / 1e-7 * model.probs[i, lang], want[i, lang], atol=1e-4)


def test_forgetting_changes_nothing():
    pieces, model = small_model()
    texts = ["ab ba", "abab, cab!", None, "12 34", "c a b", "", "ab-ba"]
    first = model.predict(texts)
    model.memory = 1
    assert model.predict(texts) == model.predict(texts) == first
    assert first[0][2] == first[0][3] == first[0][5] == "und"


def test_edges(spark):
    rows = [(i, t, g, 1) for i, (t, g) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), (None, "en"), ("", None), ("1234 !", "en"), ("the dog", None), ("ü" * 4000 + " the", "fr")] * 3)]
    df = spark.createDataFrame([*rows, rows[0], (None, "the", "en", 1)], "doc_id long, text string, lang string, score int")
    got = L.identify(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        t = "the" if r.doc_id is None else rows[r.doc_id][1]
        assert (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
    assert L.identify(df.filter("false")).count() == 0
    assert {r.lang_pred for r in L.identify(df.filter("lang is null")).collect()} == {"und"}


def test_long_words_and_long_texts_teach(spark):
    import random

    rnd = random.Random(2)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    samples = [(lang, " ".join(word(letters, 70) for _ in range(20))) for lang, letters in (("a", "abcde"), ("b", "vwxyz")) for _ in range(5)]
    names, _ = L.learn(samples).predict([word("abcde", 50), word("vwxyz", 12)])
    assert names == ["a", "b"]
    rows = [(i, " ".join(word("abcde" if i % 2 else "vwxyz", 6) for _ in range(3000)), "a" if i % 2 else "b") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.identify(df, L.Identify(sample_chars=500)).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in got)
