import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.operators import neighbors as N

SRC, TGT = "source string, vec array<float>, label string", "target string, vec array<float>, label string"


def basis(n, names="S"):
    return [(f"{names}{i}", [1.0 if j == i else 0.0 for j in range(n)], "P" if i % 2 == 0 else "N") for i in range(n)]


def test_top_one_on_basis_vectors(spark):
    src = spark.createDataFrame(basis(4), SRC)
    tgt = spark.createDataFrame([("t0", [0.9, 0.2, 0.1, 0.0], "P"), ("t1", [0.3, 0.8, 0.0, 0.2], "P"), ("t2", [0.1, 0.2, 0.7, 0.3], "P")], TGT)
    for metric in ("euclidean", "cosine", "manhattan"):
        for pairs in (N.nearest(tgt, src, 1, metric), N.exact_pairs(tgt, src, 1, metric)):
            assert {(r.target, r.source) for r in pairs.collect()} == {("t0", "S0"), ("t1", "S1"), ("t2", "S2")}


def test_blocks_equal_expressions(spark):
    rng = np.random.default_rng(0)
    src = spark.createDataFrame([(f"s{i:03d}", rng.integers(0, 3, 4).astype(float).tolist(), "x") for i in range(200)], SRC).repartition(7)
    tgt = spark.createDataFrame([(f"t{i}", rng.integers(0, 3, 4).astype(float).tolist(), "x") for i in range(9)], TGT)
    for metric in ("euclidean", "manhattan"):
        a = {(r.target, r["rank"], r.source) for r in N.nearest(tgt, src, 6, metric).collect()}
        assert a == {(r.target, r["rank"], r.source) for r in N.exact_pairs(tgt, src, 6, metric).collect()}


def test_many_targets_go_in_slices(spark, monkeypatch):
    src, tgt = spark.createDataFrame(basis(8), SRC), spark.createDataFrame([(f"t{i}", v, x) for i, (_, v, x) in enumerate(basis(8))], TGT)
    monkeypatch.setattr(N, "TARGET_ROWS", 3)
    assert {(r.target, r.source) for r in N.nearest(tgt, src, 1).collect()} == {(f"t{i}", f"S{i}") for i in range(8)}


def test_threshold_and_labels(spark):
    src = spark.createDataFrame([("a", [1.0, 0.0], " p"), ("b", [-1.0, 0.0], "P"), ("c", [0.0, 1.0], "N")], SRC)
    tgt = spark.createDataFrame([("t", [1.0, 0.0], "P ")], TGT)
    pairs = N.exact_pairs(tgt, src, 3)
    labels = (tgt.select("target", "label"), src.select("source", "label"))
    assert {r.source for r in N.mine(pairs, labels).collect()} == {"a", "b"}
    assert {r.source for r in N.mine(pairs, labels, 1.5).collect()} == {"a"}
    assert {r.source for r in N.mine(pairs, None, 2.0).collect()} == {"a", "b", "c"}  # a distance equal to the threshold stays


def test_rollback_when_a_target_gets_too_few():
    rows = [("t0", "S0", 0.1), ("t0", "S1", 0.2), ("t1", "S0", 0.1), ("t1", "S2", 0.2), ("t2", "S2", 0.1), ("t2", "S3", 0.2)]
    got = N.assign_once(pd.DataFrame(rows, columns=["target", "source", "distance"]), ["t0", "t1", "t2"], 2)
    assert set(got.rows["source"]) == {"S0", "S1", "S2", "S3"} and got.retry == ["t1"]


def test_assignment_is_unique_capped_and_widens(spark):
    src, tgt = spark.createDataFrame(basis(8), SRC), spark.createDataFrame([(f"t{i}", basis(8)[i][1], "P") for i in (0, 2, 4)], TGT)
    got = N.assign(tgt, src, 5)
    assert len(got) == 5 == len({s for s, _ in got}) and N.assign(tgt, src, 5) == got
    assert not {"S0", "S2"} & {s for s, _ in N.assign(tgt, src, 5, taken={"S0", "S2"})}
    both = spark.createDataFrame([("t0", [1.0, 0.1, 0.0, 0.0], "P"), ("t1", [1.0, 0.0, 0.1, 0.0], "P")], TGT)
    four = spark.createDataFrame(basis(4), SRC)
    assert len(N.assign(both, four, 2, factor=1, rounds=1)) == 1 and len(N.assign(both, four, 2, factor=4)) == 2
    assert N.assign(tgt.filter("false"), src, 3) == [] == N.assign(tgt, src, 0)


def test_strata_own_their_pools(spark):
    src = spark.createDataFrame([(s, v, ["Person", "car"] if i < 2 else []) for i, (s, v, _) in enumerate(basis(4))], "source string, vec array<float>, classes array<string>")
    tgt = spark.createDataFrame([("t0", [1.0, 0.0, 0.0, 0.0], ["person"]), ("t1", [0.0, 1.0, 0.0, 0.0], ["car"]), ("t2", [0.0, 0.0, 1.0, 0.0], [])], "target string, vec array<float>, classes array<string>")
    got = N.assign_stratified(tgt, src, 3, ["person", "car"])
    assert len({s for _, s, _ in got}) == len(got) == 3 and {c for c, _, _ in got} == {"person", "car", "non_rare"}


@pytest.mark.parametrize("total", [1, 3, 5, 7, 100])
def test_quotas_sum_up(spark, total):
    for ratios in ({"a": 0.5, "b": 0.3, "non_rare": 0.2}, {**{c: 0.1 for c in "abcde"}, "non_rare": 0.5}):
        got = {r["name"]: r.quota for r in N.quotas(spark.createDataFrame(list(ratios.items()), "name string, ratio double"), total).collect()}
        assert sum(got.values()) == total and min(got.values()) >= 0
        assert all(abs(got[k] - v * total) < 1 for k, v in ratios.items())


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 6), st.integers(1, 3), st.randoms())
def test_no_source_is_assigned_twice(targets, topn, rnd):
    rows = [(f"t{t}", f"s{rnd.randint(0, 8)}", round(rnd.random(), 1)) for t in range(targets) for _ in range(5)]
    order = [f"t{t}" for t in range(targets)]
    got = N.assign_once(pd.DataFrame(rows, columns=["target", "source", "distance"]), order, topn)
    assert got.rows["source"].is_unique and set(got.retry) | set(got.rows["target"]) == set(order)
    assert (got.rows.groupby("target").size() == topn).all()
