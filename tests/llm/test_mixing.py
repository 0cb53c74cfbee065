import math
import re
import struct
from collections import defaultdict

import pytest
import xxhash

from sparkloom.llm import mixing
from sparkloom.llm.queries import op8_mix_sources


def brute_targets(size):
    """size: words by source; water-filling with weights 1, 2, 3 in order of code points, null last."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        w = sum(weight[s] for s in size if s not in capped)
        out = {s: 3.0 * size[s] if s in capped else left * weight[s] / w for s in size}
        more = {s for s in size if s not in capped and out[s] > 3 * size[s]}
        if not more:
            return out
        capped |= more


def check(rows, docs):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    by = defaultdict(int)
    for i, n in sizes.items():
        by[source[i]] += n
    want, taken = brute_targets(by), defaultdict(int)
    for r in rows:
        assert (r.size, r.source_size) == (sizes[r.doc_id], by[source[r.doc_id]])
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[source[r.doc_id]] += r.taken
    return want, taken, by


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op8_mix_sources(spark, sf)
    first = rows.collect()
    want, taken, _ = check(first, docs)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.1 * t, 25), (s, taken[s], t)
    assert sorted(first) == sorted(op8_mix_sources(spark, sf).collect())


def test_many_documents_and_levels(spark):
    docs = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 2 else "hot") for i in range(6000)]
    rows = mixing.sample(spark.createDataFrame(docs, "doc_id long, text string, source string"), mixing.Mix(region=40, length_power=0)).collect()
    want, taken, _ = check(rows, docs)
    assert all(abs(taken[s] - t) <= 4 for s, t in want.items())
    ratio = {s: want[s] / sum(r.size for r, d in zip(sorted(rows), docs) if d[2] == s) for s in want}
    for r in rows:  # whole copies are certain, and one more at most
        assert r.copies - int(ratio[docs[r.doc_id][2]] + 1e-9) in (0, 1)


def brute_order(docs, p):
    """{id: (expected copies, rank)}: odds of XXH64 numbers over inclusion odds, by the definition."""

    def number(i, text, source):
        h = 42
        h = xxhash.xxh64_intdigest(struct.pack("<i", p.seed), h)
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), h)
        own = xxhash.xxh64_intdigest((text or "").encode(), 42) if text is not None else 42
        h = xxhash.xxh64_intdigest(struct.pack("<Q", own), h)
        h = xxhash.xxh64_intdigest(("-" if source is None else "=" + source).encode(), h)
        return ((h >> 11) + 0.5) / 2.0**53

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    by = defaultdict(int)
    for i, _, s in docs:
        by[s] += size[i]
    want, out = brute_targets(by), {}
    for s in by:
        mine = [(i, t) for i, t, x in docs if x == s]
        imp = {i: 2 ** (round(16 * math.log2(max(size[i], 1) ** p.length_power)) / 16) for i, _ in mine}
        capped = set()
        while True:
            mass = sum(size[i] * imp[i] for i in imp if i not in capped)
            scale = (want[s] - p.cap * sum(size[i] for i in capped)) / mass if mass else 0.0
            more = {i for i in imp if i not in capped and size[i] and scale * imp[i] > p.cap * (1 + 1e-9)}
            if not more:
                break
            capped |= more
        for i, t in mine:
            e = p.cap if i in capped else min(p.cap, scale * imp[i])
            e = round(e) if abs(e - round(e)) < 1e-9 else e
            u, part = number(i, t, s), e - int(e)
            out[i] = (e, math.log(u / (1 - u)) - math.log(max(part, 1e-12) / (1 - min(part, 1 - 1e-12))))
    return out, want, size


def test_pareto_order_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(10_000 + i, "w " * (1 + i * i % 91), "hot" if i % 3 else None) for i in range(3000)]
    p = mixing.Mix(region=64)
    order, want, size = brute_order(docs, p)
    rows = mixing.sample(spark.createDataFrame(docs, "doc_id long, text string, source string"), p).collect()
    taken = defaultdict(int)
    unequal = 0
    for r in rows:
        taken[r.doc_id] = r.copies
        assert int(order[r.doc_id][0]) <= r.copies <= int(order[r.doc_id][0]) + 1 and r.copies <= 3
    for s in want:
        mine = sorted((order[i][1], i) for i, _, x in docs if x == s and size[i] and order[i][0] % 1)
        left = want[s] - sum(int(order[i][0]) * size[i] for i, _, x in docs if x == s)
        unequal += len({round(order[i][0], 6) for _, i in mine}) > 1
        end, words = 0, 0.0
        while end < len(mine) and words + size[mine[end][1]] <= left:
            words, end = words + size[mine[end][1]], end + 1
        got = [taken[i] - int(order[i][0]) for _, i in mine]
        assert all(got[: max(0, end - 128)]) and not any(got[end + 128 :]), s  # mended at its end only
        assert abs(sum(taken[i] * size[i] for i, _, x in docs if x == s) - want[s]) <= max(0.1 * want[s], 25)
    assert unequal > 5  # sources at three times their size have equal odds


def test_mixture_has_the_copies_of_the_sample(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.limit(1).selectExpr("doc_id", "text", "lang", "'many' as source", "n_chars").crossJoin(spark.range(700).select()).unionAll(docs.limit(60).selectExpr("cast(null as long)", "concat(text, doc_id)", "lang", "null", "n_chars"))
    for p, most in ((mixing.Mix(), 400_000), (mixing.Mix(region=16), 0)):
        monkeypatch.setattr(mixing, "_LOOKED_UP", most)
        df = docs.unionAll(more)
        want, got = defaultdict(int), defaultdict(int)
        rows = mixing.repeat(df, p).collect()
        assert all(r.copy < 3 for r in rows)
        for r in rows:
            got[r.doc_id] += 1
        for r in mixing.sample(df, p).collect():
            want[r.doc_id] += r.copies
        assert {k: v for k, v in want.items() if v} == dict(got)


def test_importance_is_followed(spark):
    docs = [(i, "a b c d", "x" if i % 4 else "y", 3.0 if i % 2 else 1.0) for i in range(8000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, w double")
    rows = mixing.sample(df, mixing.Mix(weights=(1, 9), importance="w")).collect()
    by = defaultdict(list)
    for r in rows:
        if docs[r.doc_id][2] == "x":
            by[docs[r.doc_id][3]].append(r.copies)
    mean = {w: sum(c) / len(c) for w, c in by.items()}
    assert mean[3.0] / mean[1.0] == pytest.approx(3, rel=0.15)


def test_edges(spark):
    docs = [(1, None, "a", 0), (2, "", "a", 0), (3, "one two", None, 0), (4, "x", "b", 1), (5, "y " * 50000, "b", 1), (6, " \n", "z", 1)]
    df = spark.createDataFrame([*docs, docs[3], (None, "p q", "c", 2)], "doc_id long, text string, source string, size int")
    rows = mixing.sample(df).collect()
    assert len(rows) == 8
    assert all(r.taken <= 3 * r.size for r in rows)
    assert {r.doc_id for r in rows if r.size == 0} == {1, 2, 6}
    assert mixing.sample(df.filter("false")).count() == 0
    assert mixing.repeat(df.filter("doc_id is not null")).filter("copy >= 3").count() == 0
