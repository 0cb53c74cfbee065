import random
import re

import numpy as np
import xxhash

from sparkloom.llm import simhash
from sparkloom.llm.queries import op2_simhash_near_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=4):
    """prints: (row id, fingerprint) pairs; the least row id that can be reached, in their order."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    fps = np.array([f for _, f in prints], dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius).tolist():
            up[root(i)] = root(j)
    least = {}
    for i, (row, _) in enumerate(prints):
        least[root(i)] = min(row, least.get(root(i), row))
    return [least[root(i)] for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    rnd = random.Random(1)
    all_masks = simhash.masks(4)
    assert len(all_masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
        assert any(not m & diff for m in all_masks)


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, brute_print(t)) for i, t in docs]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(prints, brute_groups(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash_near_dedup(spark, sf).collect()}
    assert got == want


def links_match(spark, fps, p):
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    edges = [(r.u, r.v) for r in simhash.links(spark.createDataFrame(signed, "_fp long"), p).collect()]
    place = {s[0]: i for i, s in enumerate(signed)}
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for u, v in edges:
        assert bin((u ^ v) & (2**64 - 1)).count("1") <= p.radius
        up[root(place[u])] = root(place[v])
    want = brute_groups(list(enumerate(fps)))
    assert len({root(i) for i in range(len(fps))}) == len(set(want))


def test_large_buckets_lose_no_link(spark):
    rnd = random.Random(2)
    fps = set()
    for _ in range(4):
        center = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))))
    fps = sorted(fps)
    links_match(spark, fps, simhash.SimHash(bucket=5))
    links_match(spark, fps, simhash.SimHash())


def test_edges(spark):
    texts = [None, "", " \n", "a b c", "A B C", "é É", "x " * 40000, "one two three four five"]
    rows = [(10 + i, t, "clash", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (None, "a b c", None, None)], "doc_id long, text string, fingerprint string, _fp int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(df).collect()]
    want = {10: 10, 11: 10, 12: 10, 13: 13, 14: 13, 15: 15, 16: 16, 17: 17, None: 13}
    assert len(got) == 10 and all(c == want[i] for i, _, c in got)
    assert all(f == f"{brute_print(dict((r[0], r[1]) for r in rows).get(i, 'a b c')):016x}" for i, f, _ in got)
    assert simhash.groups(df.filter("false")).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [10, 13, 15, 16, 17]


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "A B C", 1), (13, "a b c", 2), (13, "A b c", 3), (14, "a b c", 4), (None, "one two three four five", 5), (None, "one two three four five", 6), (7, "x y z", 7), (7, "x y z", 7), (7, "u v w", 8)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n int, _key string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text.lower()) for r in kept.collect()), key=str)
    assert got == sorted([(13, "a b c"), (None, "one two three four five"), (7, "x y z"), (7, "u v w")], key=str)
    assert simhash.keep_one(df.filter("n = 8")).count() == 1 and simhash.keep_one(df.filter("false")).count() == 0
