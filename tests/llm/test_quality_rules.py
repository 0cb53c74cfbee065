import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import quality_rules
from sparkloom.llm.queries import op3_quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def check(rows, docs):
    for r in rows:
        want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op3_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, docs)


def features(text):
    n_words, chars, symbols, dup, rep = brute(text)
    n, c = max(1, n_words), max(1, chars)
    lines = max(1, sum(bool(WORDS.search(x)) for x in (text or "").split("\n")))
    caps, marks = len(re.findall("[A-Z]", text or "")), len(re.findall("[!?]", text or ""))
    raw = [4 * math.log(c / n), math.log1p(20 * symbols / n), 2 * dup / lines, 4 * rep / n, math.log1p(10 * caps / c), math.log1p(20 * marks / n)]
    return [int(math.floor(x * 256 + 0.5)) for x in raw]


def brute_distances(rows, r):
    """{id: distance} of rows (id, text, lang, source): the same estimates in numpy, one group after another."""
    fit, lang_of = defaultdict(list), {}
    for i, text, lang, source in rows:
        n_words, _, _, _, rep = brute(text)
        lang_of[lang, source] = lang
        if n_words >= 50 and 100 * rep <= 50 * n_words:
            fit[lang, source].append(features(text))
    x = {g: np.array(v, float) / 256 for g, v in fit.items()}

    def lower_median(v):
        return np.sort(v, axis=0)[(len(v) - 1) // 2]

    def estimates(inner):
        """Shrunk mean and covariance of each group from its rows."""
        def moments(rows):
            return rows.mean(axis=0), np.cov(rows.T, bias=True).reshape(6, 6)
        whole, out = moments(np.vstack(list(inner.values()))), {}
        for g, v in inner.items():
            mean, cov = whole
            for part in (np.vstack([w for h, w in inner.items() if lang_of[h] == lang_of[g]]), v):
                a, (m, s) = len(part) / (len(part) + r.prior_rows), moments(part)
                mean, cov = m * a + mean * (1 - a), s * a + cov * (1 - a)
            out[g] = mean, cov + np.eye(6) * r.floor**2
        return out

    def distances(v, est):
        y = np.linalg.solve(np.linalg.cholesky(est[1]), (v - est[0]).T)
        return (y * y).sum(axis=0)

    def edge(d):
        b = np.sort(np.floor(np.log2(np.maximum(d, 1e-3)) * 32))
        return 2.0 ** ((b[math.ceil(len(b) * r.share) - 1] + 1) / 32)

    def step(est):
        return estimates({g: v[(d := distances(v, est[g])) < edge(d)] for g, v in x.items()})

    det = lambda e: np.linalg.slogdet(e[1])[1]
    scales = {}
    for g, v in x.items():
        coarse = np.floor((np.round(v * 256) + 8) / 16)
        mid = lower_median(coarse)
        scales[g] = mid / 16, np.maximum(1.4826 * lower_median(np.abs(coarse - mid)) / 16, r.floor)
    starts = [{g: (m, np.diag(s * s)) for g, (m, s) in scales.items()}, estimates(x)]
    trimmed = {g: v[(np.abs(v - scales[g][0]) <= r.trim * scales[g][1]).all(axis=1)] for g, v in x.items()}
    starts.append(estimates({g: v for g, v in trimmed.items() if len(v)}))
    starts[2] |= {g: (np.full(6, np.nan), np.eye(6) * 1e9) for g in x if g not in starts[2]}
    found = [step(step(s)) for s in starts]
    est = {g: min((f[g] for f in found), key=lambda e: round(det(e), 9)) for g in x}
    for _ in range(r.steps - 2):
        new = step(est)
        still = all(abs(det(new[g]) - det(est[g])) <= r.tolerance for g in x)
        est = new
        if still:
            break
    out, all_d = {}, {g: distances(v, est[g]) for g, v in x.items()}
    for i, text, lang, source in rows:
        g = lang, source
        if g in est:
            up = edge(np.concatenate([d for h, d in all_d.items() if lang_of[h] == lang]))
            a = len(x[g]) / (len(x[g]) + r.prior_rows)
            h = math.exp(a * math.log(edge(all_d[g])) + (1 - a) * math.log(up))
            out[i] = distances(np.array([features(text)]) / 256, est[g])[0] * EXPECTED / max(h, EXPECTED / 4)
    return out


EXPECTED = quality_rules._expected(0.75)


def test_verdicts_against_brute_force(spark, sf):
    """Distances and verdicts of whole tables, recomputed; hot, small and single-row groups."""
    rows = [(r.doc_id, r.text, r.lang, "hot" if r.doc_id % 3 == 0 else r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rules = quality_rules.Rules()
    want = brute_distances(rows, rules)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules.judge(df, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in want:
            assert r.distance == pytest.approx(want[r.doc_id], rel=1e-4, abs=1e-4)
        assert r.kept == (not r.base_failed and want[r.doc_id] <= rules.cut)
    assert {r.kept for r in got if not r.base_failed} == {True, False}
    assert EXPECTED == pytest.approx(7.84, abs=0.02)


def test_edges(spark):
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c a", "x\nx\n\n \nx", " é ß\x0b\x0cq", "a a a a a a", "# * $ % & | < >", "one " * 30000]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", i, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, kept int, _g string")
    got = quality_rules.judge(df).collect()
    assert len(got) == len(rows) + 3
    check(got, dict(enumerate(texts)))
    assert quality_rules.judge(df.filter("false")).count() == 0


def test_outliers_go_and_clean_rows_stay(spark):
    import random

    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(400):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(80, 300))]
        if i % 8 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", "hot"))
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id % 8 != 0) for r in got)
