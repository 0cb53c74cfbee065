from collections import Counter

import corpus_pipeline as P
from sparkloom.llm import decontaminate as D
from sparkloom.llm import mixing, quality_rules, secret_scan
from test_decontaminate import brute as contamination
from test_simhash import brute_groups, brute_print


def test_stages_against_brute_force(spark, sf):
    """Each stage on its predecessor's rows; the verdict of the iterated estimates is taken as given."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    prints = [(i, brute_print(t)) for i, t in rows.items()]
    rows = {i: rows[i] for (i, _), c in zip(prints, brute_groups(prints)) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    machine = D.Automaton([(str(i), D.words(t)) for i, t in items], 13)
    rows = {i: t for i, t in rows.items() if not contamination(t, items)[4]}
    rows = {i: D.without(t, [s for s in machine.scan(D.words(t))[0] if s[1] - s[0] >= 13]) for i, t in rows.items()}
    ranks = secret_scan.load_ranks(secret_scan.Scan().vocabulary)
    for i, t in rows.items():
        for _, s, e in reversed(secret_scan.find(t, ranks)):
            t = t[:s] + "[SECRET]" + t[e:]
        rows[i] = t
    got = P.run(spark, sf).collect()
    assert all(r.n_chars == len(r.text) and 0 <= r.copy < 3 and rows[r.doc_id] == r.text for r in got)
    source = {r.doc_id: r.source for r in docs.collect()}
    last = spark.createDataFrame([(i, t, source[i]) for i, t in rows.items()], "doc_id long, text string, source string")
    want = {r.doc_id: r.copies for r in mixing.sample(last).collect() if r.copies}  # held against brute force in its own tests
    assert Counter(r.doc_id for r in got) == want
    assert Counter((r.doc_id, r.copy) for r in got) == Counter((i, c) for i, n in want.items() for c in range(n))


def test_columns_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert P.STAGES[-1][1](spark, docs, sf).count() == 0


def test_stages_with_nulls_repeats_and_odd_columns(spark, sf):
    """Each stage takes nulls in any column, empty and long texts, repeated rows and columns with clashing names."""
    plain = " ".join(f"word{i % 70}x{i % 11}" for i in range(120))
    other = " ".join(f"some{i % 90}y{i % 13}" for i in range(140))
    rows = [(1, plain, "en", "a"), (1, plain, "en", "a"), (2, plain, None, None), (3, None, "en", "a"), (4, "", None, "b"), (None, other, "en", None), (5, "long " * 30000, "en", "b"), (6, other + " password=abcdef123456", None, None)]
    df = spark.createDataFrame([(*r, None, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, copies int, _g int")
    docs = df
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == df.columns, name
        docs = spark.createDataFrame(docs.collect(), df.schema)
    assert {r.doc_id for r in docs.collect()} == {1, 6}  # the row without an id is nearly the sixth's copy
    assert "[SECRET]" in {r.doc_id: r.text for r in docs.collect()}[6]
    mixed = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in mixed} <= {1, 6} and all(r.copy < 3 for r in mixed)
    for _, stage in P.STAGES:
        assert stage(spark, df, sf).count() >= 0
    total = sum(len((r.text or "").split()) for r in df.collect())
    assert abs(sum(len((r.text or "").split()) for r in P.STAGES[-1][1](spark, df, sf).collect()) - total) <= 0.7 * total


def test_clean_rows_stay_beside_rejected_ones_of_their_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = quality_rules.judge(docs).filter("kept").first().doc_id
    good = docs.filter(f"doc_id = {clean}").first()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, *good[1:]), (None, None, "en", "a", 0), (None, "", None, None, 0), (clean, "no", good.lang, good.source, 2), (clean, "en", None, good.source, 2)]
    added = docs.select(*[x.split()[0] for x in kind.split(", ")]).unionAll(spark.createDataFrame(rows, kind))
    got = [(r.doc_id, r.text) for r in P.quality(spark, added, sf).collect()]
    assert sorted((x for x in got if x[0] in (None, clean)), key=str) == sorted([(None, good.text), (clean, good.text)], key=str)
