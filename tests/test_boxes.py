import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import boxes
from sparkloom.operators import box_quality as Q
from sparkloom.operators import detection as D

BOX = "type string, truncated double, occluded int, bbox_xmin double, bbox_ymin double, bbox_xmax double, bbox_ymax double, img_width int, img_height int"


def test_classification(spark):
    rows = [
        ("ok", 0.0, 0, 1, 1, 5, 5, 10, 10), ("truncated", 1.5, 0, 1, 1, 5, 5, 10, 10), ("occluded", 0.0, 7, 1, 1, 5, 5, 10, 10), ("negative", 0.0, 0, -1, 1, 5, 5, 10, 10),
        ("flat", 0.0, 0, 1, 1, 1, 5, 10, 10), ("inverted", 0.0, 0, 5, 1, 1, 5, 10, 10), ("beyond", 0.0, 0, 1, 1, 11, 5, 10, 10), ("unknown size", 0.0, 0, 1, 1, 11, 5, None, 0),
        ("both", 0.0, 0, -1, 9, -3, 5, 10, 10), ("null", 0.0, 0, None, 1, 5, 5, 10, 10),
    ]
    df = Q.classify(spark.createDataFrame([(r[0], r[1], r[2], *[None if x is None else float(x) for x in r[3:7]], *r[7:]) for r in rows], BOX))
    got = {r.type: (r.status, r.out_of_box_coordinates, r.zero_area_bounding_box, r.inverted_coordinates) for r in df.collect()}
    assert got["ok"] == ("VALID", False, False, False)
    assert got["truncated"][0] == got["occluded"][0] == "GOOD_TO_CORRECT"
    assert got["negative"] == ("INVALID", True, False, False)
    assert got["flat"] == ("INVALID", False, True, False)
    assert got["inverted"] == ("INVALID", False, False, True)
    assert got["beyond"][1] and not got["unknown size"][1]
    assert got["both"] == ("INVALID", True, False, True)
    assert got["null"][0] == "NOT_PARSED"


def test_corrections_differ_in_order(spark):
    df = spark.createDataFrame([("a", 0.0, 0, 12.0, -3.0, 4.0, 15.0, 10, 10)], BOX)
    r = Q.correct_labels(df).first()
    assert (r.bbox_xmin, r.bbox_ymin, r.bbox_xmax, r.bbox_ymax) == (4, 0, 12, 10)
    r = Q.correct_xywh(df).first()
    assert (r.x, r.y, r.w, r.h) == (4, 0, 6, 10)


def test_empty_summary(spark):
    r = Q.summary(Q.classify(spark.createDataFrame([], BOX))).first()
    assert (r.total, r.invalid, r.invalid_pct, r.warns) == (0, 0, None, False)


def test_iou_borders(spark):
    df = spark.createDataFrame([(0.0, 0.0, 9.0, 9.0, 0.0, 0.0, 9.0, 4.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    one, two = [tuple(F.col(c) for c in x) for x in ("abcd", "efgh")]
    r = df.select(*[boxes.iou(one, two, m).alias(m) for m in ("half", "include", "exclude")]).first()
    assert r.half == pytest.approx(36 / 81) and r.include == pytest.approx(50 / 100) and r.exclude == pytest.approx(24 / 64)


def test_affine_keeps_corners():
    m = boxes.affine((100, 50), 90)
    x, y = m[0][0] * 50 + m[0][1] * 25 + m[0][2], m[1][0] * 50 + m[1][1] * 25 + m[1][2]
    assert (x, y) == (pytest.approx(50), pytest.approx(25))
    assert boxes.affine((100, 50), flip=(True, False))[0] == [-1, 0, 100]
    assert math.isclose(boxes.affine((100, 50), out_size=(50, 50))[0][0], 0.5)


def brute_match(gt, pred, thr, min_area=0.0):
    """Pairs of one image and class, by a plain loop."""

    def iou(a, b):
        i = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
        return i / u if u else 0.0

    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    free, out = [True] * len(gt), []
    for p in sorted(pred, key=lambda p: (-p[1], p[0])):
        if not gt:
            out.append((0, p[1]))
            continue
        ov = [iou(p[2], g[1]) * f for g, f in zip(gt, free)]
        k = ov.index(max(ov))
        if ov[k] >= thr:
            if size(gt[k][1]) >= min_area:
                free[k] = False
                out.append((1, p[1]))
        else:
            out.append((0, p[1]))
    return sorted(out + [(1, 0.0) for g, f in zip(gt, free) if f and size(g[1]) >= min_area])


@pytest.mark.parametrize("min_area", [0.0, 30.0])
def test_matching_against_a_plain_loop(spark, min_area):
    rnd = random.Random(6)
    gt, pred = [], []
    for image in range(40):
        for side, rows in (("g", gt), ("p", pred)):
            for k in range(rnd.randint(0, 6)):
                x, y = rnd.randint(0, 12), rnd.randint(0, 12)
                b = (float(x), float(y), float(x + rnd.randint(1, 10)), float(y + rnd.randint(1, 10)))
                rows.append((image, "c", f"{side}{image}-{k}", *b) + ((round(rnd.random(), 1),) if side == "p" else ()))
    schema = "image_id int, type string, row_id string, x1 double, y1 double, x2 double, y2 double"
    got = D.match(spark.createDataFrame(gt, schema), spark.createDataFrame(pred, schema + ", score double"), 0.3, 0.2, min_area).collect()
    for image in {g[0] for g in gt}:
        g = sorted((r[2], r[3:7]) for r in gt if r[0] == image)
        p = [(r[2], r[7], r[3:7]) for r in pred if r[0] == image and r[7] >= 0.2 and (r[5] - r[3]) * (r[6] - r[4]) >= min_area]
        assert sorted((r.t, r.score) for r in got if r.image_id == image and r.t is not None) == brute_match(g, p, 0.3, min_area)
    assert not {r.image_id for r in got} - {g[0] for g in gt}


def test_average_precision_by_hand(spark):
    pairs = spark.createDataFrame([(1, "c", 1, 0.9, "a"), (1, "c", 0, 0.8, "b"), (1, "c", 1, 0.7, "d"), (2, "c", 1, 0.0, "e")], "image_id int, type string, t int, score double, pos string")
    points = D.curve(pairs, 0.1)
    assert [(round(r.precision, 4), round(r.recall, 4)) for r in points.orderBy("n").collect()] == [(1, 0.3333), (0.5, 0.3333), (0.6667, 0.6667), (0.6667, 0.6667)]
    assert D.average_precision(points).first().ap == pytest.approx((4 * 1 + 3 * 2 / 3) / 11)
    assert D.average_precision(points, "integrate").first().ap == pytest.approx(1 / 3 + 1 / 3 * 2 / 3)
    m = D.metrics(pairs, 0.1).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 1, 0) and m.re == pytest.approx(2 / 3, abs=1e-6)


def test_suppression(spark):
    rows = [(1, "c", "a", 0.0, 0.0, 10.0, 10.0, 0.9), (1, "c", "b", 1.0, 0.0, 10.0, 10.0, 0.8), (1, "c", "d", 20.0, 0.0, 30.0, 10.0, 0.7), (1, "e", "f", 0.0, 0.0, 10.0, 10.0, 0.1)]
    got = D.suppress(spark.createDataFrame(rows, "image_id int, type string, row_id string, x1 double, y1 double, x2 double, y2 double, score double")).collect()
    assert {r.row_id for r in got} == {"a", "d", "f"}


def test_sequence_summary(spark):
    rows = [("s1", "person", 8, 2, 0, 0, 0.8, 1.0, 0.8, 0.5), ("s2", "person", 0, 0, 10, 0, 0.0, 0.0, 0.0, 0.1), ("s2", "car", 1, 0, 0, 0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sequence string, type string, tp long, fp long, fn long, tn long, pr double, re double, acc double, ap double")
    got = {r.sequence: r for r in D.summarize(df, "person").collect()}
    assert set(got) == {"s1", "s2", "Summary"}
    assert got["Summary"].re == pytest.approx(8 / 18, abs=1e-6) and got["Summary"].ap == pytest.approx(0.3)


#: As many truths of one image and class as a table of 1 GB has.
MANY = 24_000


def far_apart(spark):
    """Truths of one image and class, none near another, and a prediction for every second one, moved by a pixel."""
    x, y = F.col("id") % 200 * 12.0, F.floor(F.col("id") / 200) * 12.0
    box = lambda s: [(x + s).alias("x1"), y.alias("y1"), (x + s + 10).alias("x2"), (y + 10).alias("y2")]
    key = [F.lit(1).alias("image_id"), F.lit("c").alias("type"), F.lpad(F.col("id").cast("string"), 6, "0").alias("row_id")]
    rows = spark.range(MANY)
    return rows.select(*key, *box(0)), rows.filter("id % 2 = 0").select(*key, *box(1), (F.col("id") % 7 / 10.0).alias("score"))


def test_matching_of_an_image_with_very_many_boxes(spark):
    began = time.monotonic()
    counts = D.match(*far_apart(spark)).groupBy("t", (F.col("pos").cast("int") % 2).alias("odd")).agg(F.count("*").alias("n"), F.count_distinct("pos").alias("ids"))
    assert sorted(map(tuple, counts.collect())) == [(1, 0, MANY // 2, MANY // 2), (1, 1, MANY // 2, MANY // 2)]
    assert time.monotonic() - began < 60


def test_key_figures_of_an_image_with_very_many_boxes(spark):
    began = time.monotonic()
    r = D.evaluate(*far_apart(spark), conf=0.1).first()
    low = len(range(0, MANY, 14))  # scores under 0.1
    assert (r.tp, r.fp, r.fn, r.tn) == (MANY // 2 - low, 0, MANY // 2 + low, 0)
    assert time.monotonic() - began < 60


def test_weak_images_among_very_many_boxes(spark):
    began = time.monotonic()
    pairs = D.match(*far_apart(spark))
    low = len(range(0, MANY, 14))  # scores under 0.1
    assert [tuple(r)[2:5] for r in D.weak_images(pairs, 0.1, 0.6).collect()] == [(MANY // 2 - low, 0, MANY // 2 + low)]
    assert D.weak_images(pairs, 0.1, 0.3).isEmpty()
    assert time.monotonic() - began < 60


def test_weak_images_of_boxes_above_one_another(spark):
    """All left edges are near: only the upper ones tell boxes apart. Every truth is found, by one of two copies."""
    began = time.monotonic()
    box = lambda s: [F.lit(s).alias("x1"), (F.col("id") * 12.0).alias("y1"), F.lit(s + 10).alias("x2"), (F.col("id") * 12.0 + 10).alias("y2")]
    key = [F.lit(1).alias("image_id"), F.lit("c").alias("type"), F.lpad(F.col("id").cast("string"), 6, "0").alias("row_id")]
    n = 80_000
    gt = spark.range(n).select(*key, *box(0.0))
    pred = spark.range(n).select(*key, *box(1.0), (F.col("id") % 7 / 10.0).alias("score"))
    pred = pred.unionAll(pred.withColumn("row_id", F.concat("row_id", F.lit("x"))))
    low = len(range(0, n, 7))  # scores under 0.1
    found = D.image_counts(gt, pred, sure=0.1)
    assert [tuple(r) for r in D.weak_images(found, precision=0.6).collect()] == [(1, "c", n - low, n - low, low, 0.5, (n - low) / n)]
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("threshold, min_area, sure", [(0.3, 0.0, 0.4), (0.5, 30.0, 0.0), (0.0, 9.0, 0.6)])
def test_counts_of_images_are_those_of_their_pairs(spark, threshold, min_area, sure):
    rnd, gt, pred = random.Random(5), [], []
    for image in range(60):
        for rows in (gt, pred):
            for k in range(rnd.randint(0, 9)):
                x, y = rnd.randint(0, 9), rnd.randint(0, 9)
                b = (float(x), float(y), float(x + rnd.randint(-1, 9)), float(y + rnd.randint(-1, 9)))
                rows.append((image, rnd.choice("cd"), f"{len(rows)}", *b) + ((rnd.choice([0.0, 0.4, 0.6, float("nan")]),) if rows is pred else ()))
    schema = "image_id int, type string, row_id string, x1 double, y1 double, x2 double, y2 double"
    sides = spark.createDataFrame(gt, schema), spark.createDataFrame(pred, schema + ", score double")
    want = D.weak_images(D.match(*sides, threshold, 0.2, min_area), sure, recall=2.0)
    got = D.weak_images(D.image_counts(*sides, threshold, 0.2, min_area, sure=sure), recall=2.0)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("strip, measured, windows", [(1, 1, 1), (3, 5, 40), (64, 1 << 18, 1 << 21)])
def test_matching_of_crowds_and_copies(monkeypatch, strip, measured, windows):
    """Many equal boxes and equal overlaps, in blocks of any size."""
    for name, value in (("STRIP", strip), ("MEASURED", measured), ("WINDOWS", windows)):
        monkeypatch.setattr(D, name, value)
    rng = np.random.default_rng(strip)
    for threshold in (0.1, 0.34, 0.5, 1.0):
        images = []
        for _ in range(6):
            x, y = rng.integers(0, 8, (2, 70))
            w, h = rng.integers(-1, 7, (2, 70))
            images.append((np.stack([x, y, x + w, y + h]).astype(float), int(rng.integers(0, 70))))
        g, p = [b[:, :n] for b, n in images], [b[:, n:] for b, n in images]
        key = lambda parts: np.repeat(np.arange(6), [b.shape[1] for b in parts])
        big = [(b[2] - b[0]) * (b[3] - b[1]) >= 4.0 for b in g]
        t, free = D._meet(key(g), list(np.concatenate(g, 1)), np.concatenate(big), key(p), list(np.concatenate(p, 1)), threshold, 0.0)
        for k in range(6):
            hits = brute_match([(f"{i:03}", tuple(b)) for i, b in enumerate(g[k].T.tolist())], [(i, 0.5, tuple(b)) for i, b in enumerate(p[k].T.tolist())], threshold, 4.0)
            mine, left = t[key(p) == k], free[key(g) == k] & big[k]
            assert sorted([(int(v), 0.5) for v in mine if v >= 0] + [(1, 0.0)] * int(left.sum())) == hits


def test_suppression_in_an_image_with_very_many_boxes(spark):
    """All boxes stay, and each has a worse copy that goes."""
    began = time.monotonic()
    truths, _ = far_apart(spark)
    good = truths.withColumn("score", F.lit(0.9))
    rows = good.unionByName(good.select("image_id", "type", F.concat(F.lit("x"), "row_id").alias("row_id"), "x1", "y1", (F.col("x2") - 1).alias("x2"), "y2", F.lit(0.5).alias("score")))
    got = D.suppress(rows)
    assert [tuple(r) for r in got.agg(F.count("*"), F.min("score"), F.count_distinct("row_id")).collect()] == [(MANY, 0.9, MANY)]
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("threshold", [-1.0, 0.0, 0.3])
def test_suppression_against_a_plain_loop(spark, threshold):
    rnd, rows = random.Random(8), []
    for image in (1, 2, None):
        for k in range(90):
            x, y = rnd.randint(0, 40), rnd.randint(0, 40)
            rows.append((image, rnd.choice("ab"), f"{image}-{k}", float(x), float(y), float(x + rnd.randint(-3, 20)), float(y + rnd.randint(-3, 20)), round(rnd.random(), 1)))

    def iou(a, b):
        i = max(min(a[5], b[5]) - max(a[3], b[3]), 0) * max(min(a[6], b[6]) - max(a[4], b[4]), 0)
        u = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - i
        return i / u if u else 0.0

    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[2])):
        if all(k[:2] != r[:2] or iou(r, k) <= threshold for k in kept):
            kept.append(r)
    got = D.suppress(spark.createDataFrame(rows, "image_id int, type string, row_id string, x1 double, y1 double, x2 double, y2 double, score double"), threshold)
    assert sorted(r.row_id for r in got.collect()) == sorted(k[2] for k in kept)
