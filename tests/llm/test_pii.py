import hashlib
import random
import re

import numpy as np
import pytest

from sparkloom.llm import pii
from sparkloom.llm.queries import op6_personal_data

FAST = pii.Detect(steps=3)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_on_random_strings():
    rnd = random.Random(4)
    for _ in range(4000):
        text = "".join(rnd.choice(["a", "1", "25", ".", "@", "-", "+", " ", "(", "4111111111111111", "é", "_", "9.8"]) for _ in range(rnd.randint(0, 18)))
        assert pii._base_only(text) == brute(text), text


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_personal_data(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.spell(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert not {f"{k}:{s}:{e}" for k, s, e in base} - set(spans) and len(spans) == len(base) + r.n_added


def test_gradients_are_right():
    net = pii.Network(4, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii._CLASSES, (7, 3)), rng.integers(0, pii._LABELS, (7, 3))
    _, grads = net.loss_grad(x, y)
    for k in net.p:
        i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old, eps = net.p[k][i], 1e-2
        net.p[k][i] = old + eps
        up = net.loss_grad(x, y)[0]
        net.p[k][i] = old - eps
        down = net.loss_grad(x, y)[0]
        net.p[k][i] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(grads[k][i]), rel=0.03, abs=1e-3), k


def test_viterbi_is_the_best_of_all_paths():
    import itertools

    net = pii.Network(2, 1)
    rng = np.random.default_rng(5)
    net.p["t"] = rng.standard_normal((pii._LABELS, pii._LABELS)).astype(np.float32)
    parts = [rng.standard_normal((n, pii._LABELS)).astype(np.float32) for n in (1, 3, 4)]
    for e, path in zip(parts, net.viterbi(parts)):
        value = lambda ys, e=e: sum(e[i, y] for i, y in enumerate(ys)) + sum(net.p["t"][a, b] for a, b in zip(ys, ys[1:]))
        assert value(path.tolist()) == pytest.approx(max(value(ys) for ys in itertools.product(range(pii._LABELS), repeat=len(e))), abs=1e-4)


@pytest.fixture(scope="module")
def net():
    return pii.train(["some plain words go here and there without any meaning at all. " * 4] * 3)


def test_network_adds_what_patterns_miss(net):
    rng = np.random.default_rng(99)
    hit = 0
    for _ in range(60):
        d = lambda n: "".join(map(str, rng.integers(0, 10, n)))  # noqa: E731, B023
        value = [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"][rng.integers(3)]
        text = f"call me tomorrow at {value} or later in the week, when there is time"
        assert pii._base_only(text) == [] or "card" in str(pii._base_only(text))
        hit += any(k == "phone" and text[s:e] in (value, value.strip("()")) for k, s, e in pii.find([text], net)[0])
    assert hit >= 40


def test_clean_text_is_left_alone(net):
    text = "It was founded in 1998, cost $1,250.00 on 2019-05-17 at 12:30, page 4711, version 2.10.3, ISBN 978-3-16-148410-0, order 20240117-338, and 100% of it is gone. "
    assert pii.find([text * 5], net)[0] == []


def test_windows_are_reconciled(net):
    """A number at any place of a long text is found alike, windows' edges or not."""
    found = []
    for lead in range(0, 100, 7):
        text = "word " * 40 + "x" * lead + " +1 (216) 555-1361 " + "word " * 40
        found.append([text[s:e] for _, s, e in pii.find([text], net)[0]])
    assert all(f == ["+1 (216) 555-1361"] for f in found)


def test_edges(spark, net):
    texts = [None, "", "@", "a@b", "é me@b.co, 1.2.3.4", "1" * 50000, "a" * 50000 + "@x.yz", "4111 1111 1111 1111"]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, spans string, n_ip int")
    got = pii.detect(df, net=net).collect()
    assert len(got) == 9
    for r in got:
        base = brute(texts[r.doc_id]) if r.doc_id != 5 else []
        assert r.base_sha256 == hashlib.sha256(pii.spell(base).encode()).hexdigest()
    assert pii.detect(df.filter("false"), FAST).count() == 0
