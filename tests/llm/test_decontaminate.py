import hashlib
import random
import re

from sparkloom.llm import decontaminate as D
from sparkloom.llm.queries import op10_decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    words, hit, found = split(text), set(), set()
    for item, body in items:
        ws = split(body)
        n = min(13, len(ws))
        windows = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), sha, 0 < len(hit) and 20 * len(hit) >= len(words)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op10_decontaminate(spark, sf).collect()}
    assert got == {r.doc_id: brute(r.text, items) for r in docs}
    assert any(x[1] for x in got.values())


def test_automaton_on_small_alphabets():
    rnd = random.Random(5)
    for _ in range(300):
        items = [(str(i), " ".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 3, 5, 13, 14, 20])))) for i in range(rnd.randint(1, 6))]
        if rnd.random() < 0.6:
            items = [x for x in items if len(x[1].split()) > 4] or [("0", "a b c a b")]
        text = " ".join(rnd.choice("abcd" if rnd.random() < 0.5 else "abc") for _ in range(60))
        if rnd.random() < 0.7:
            text += " " + rnd.choice(items)[1] + " x"
        machine = D.Automaton([(i, D.words(t)) for i, t in items], 13)
        spans, found = machine.scan(D.words(text))
        want = brute(text, items)
        assert (sum(e - b for b, e in spans), len(found)) == want[1:3]


def test_shards_and_edges(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([("a", item), ("b", "Short item"), ("c", None), (None, item), ("d", "..."), ("a", item)], "item_id string, text string")
    texts = [None, "", "...", f"see {item.upper()}, ok", "x " * 300 + item, "a short-item here", "y " * 50000]
    rows = [(i, t, i, "spans") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, n_words int, items string")
    want = {i: brute(t, [("a", item), ("b", "Short item")]) for i, t in enumerate(texts)}
    for p in (D.Contamination(), D.Contamination(shard_words=20)):
        got = D.with_verdict(D.hits(docs, bench, p), p).select("_all.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert len(got) == len(rows) + 1
        assert all(tuple(r)[1:] == want[r.doc_id] for r in got)
    kept = {r.doc_id: r for r in D.remove(docs, bench).collect()}
    assert set(kept) == {0, 1, 2, 6} | ({4} if not want[4][4] else set())
    assert D.hits(docs.filter("false"), bench).count() == 0
    assert {r.n_words for r in D.hits(docs, bench.filter("false")).collect()} == {x[0] for x in want.values()}


def test_spans_are_cut(spark):
    item = " ".join(f"w{i}" for i in range(20))
    text = "A b, " * 300 + item.replace("w5", "W5") + "; the end."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert D.remove(docs, bench).first().text == "A b, " * 300 + "; the end."


def test_items_without_ids_make_hits(spark):
    items = [" ".join(f"{c}{i}" for i in range(20)) for c in "vw"]
    bench = spark.createDataFrame([("a", items[0]), (None, items[1]), (None, "short one")], "item_id string, text string")
    docs = spark.createDataFrame([(1, items[1]), (2, f"{items[0]} {items[1]}"), (3, "a short one"), (4, "y " * 800 + items[1] + " z")], "doc_id long, text string")
    for p in (D.Contamination(), D.Contamination(shard_words=20)):
        got = {r._all.doc_id: (r.n_hit, list(r["items"]), r.contaminated) for r in D.with_verdict(D.hits(docs, bench, p), p).collect()}
        assert got == {1: (20, [], True), 2: (40, ["a"], True), 3: (2, [], True), 4: (20, [], False)}
    assert [(r.doc_id, r.text) for r in D.remove(docs, bench).collect()] == [(4, "y " * 800 + " z")]
