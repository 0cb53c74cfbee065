import zlib

import numpy as np

from sparkloom.llm import quality_model as Q
from sparkloom.llm.queries import op1_quality_classifier


def test_query_learns_and_holds_out(spark, sf):
    big = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = op1_quality_classifier(spark, big).collect()
    assert len(rows) == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        y, w = rng.random(8), rng.integers(1, 5, 8).astype(float)
        fit = Q.isotonic(y, w)
        assert (np.diff(fit) >= -1e-12).all()
        for _ in range(50):  # no monotone vector is nearer
            other = np.sort(fit + rng.normal(0, 0.1, 8))
            assert (w * (fit - y) ** 2).sum() <= (w * (other - y) ** 2).sum() + 1e-12


def test_sums_over_partitions_are_the_normal_equations(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((300, Q.STATS)).astype(np.float32), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "_x array<float>, _y double").repartition(40)
    got = Q._sums(df, 3, lambda a, b: np.array([len(a), a.sum(), b.sum()]))
    assert np.allclose(got, [300, x.sum(), y.sum()], rtol=1e-4)


def test_edges(spark):
    texts = [None, "", " \n", "word", "é" * 50, "x " * 60000, "Plain words here. " * 30, "NO!! " * 50]
    docs = spark.createDataFrame([(i, t, "s", 2.0) for i, t in enumerate(texts)] + [(3, "word", "s", 2.0), (None, "a", "s", 2.0)], "doc_id long, text string, score string, _x double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(2, None), (None, 1)], "doc_id long, quality int")
    for truth in (labels, labels.filter("quality = 1"), labels.filter("false")):
        rows = Q.classify(docs, truth).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in Q.classify(docs, labels.filter("false")).collect()} == {0.5}
    assert Q.classify(docs.filter("false"), labels).count() == 0
    assert all(np.isfinite(Q.statistics(t)).all() and len(Q.statistics(t)) == Q.STATS for t in texts)
