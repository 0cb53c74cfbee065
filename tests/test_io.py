import itertools
import json
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.functions import text as T
from sparkloom.operators import datasets as D
from sparkloom.operators import detection as K
from sparkloom.operators import enrich as E
from sparkloom.operators import person_sets as PS
from sparkloom.plans import io_queries
from sparkloom.sources import files, readers, writers
from test_entry import TABLES, rows

QUERIES = sorted(k for k, v in entry.queries().items() if v.__module__ == io_queries.__name__)


@pytest.mark.parametrize("name", QUERIES)
def test_files_and_calls_equal_their_oracles(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, rel = entry.queries()[name](spark, sf), c.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.select(*sorted(df.columns)).collect()) == rows(rel.select(*[f'"{x}"' for x in sorted(rel.columns)]).fetchall())


def test_staged_folders_take_the_place_or_nothing_changes(spark, tmp_path):
    target = str(tmp_path / "out")
    with writers.staged(spark, target) as folder:
        files.stream(["one"], f"{folder}/a.txt")
    with pytest.raises(RuntimeError), writers.staged(spark, target) as folder:
        files.stream(["two"], f"{folder}/a.txt")
        raise RuntimeError
    assert open(f"{target}/a.txt").read() == "one" and os.listdir(tmp_path) == ["out"]
    with writers.staged(spark, target) as folder:
        files.stream(["three"], f"{folder}/b.txt")
    assert [x for x in os.listdir(target) if not x.startswith(".")] == ["b.txt"] and os.listdir(tmp_path) == ["out"]


def test_nothing_is_written_without_gaps(spark, tmp_path):
    none = spark.createDataFrame([], "id long, error_type string")
    assert writers.gap_report(none, str(tmp_path)) is False and os.listdir(tmp_path) == []


def test_status_lines(tmp_path):
    path = str(tmp_path / "status.json")
    writers.status(path, "merge", "STARTED")
    writers.status(path, "merge", "SUCCESS", "done", {"rows": 3})
    got = [json.loads(x) for x in open(path)]
    assert [x["status"] for x in got] == ["STARTED", "SUCCESS"] and got[1]["data"] == {"rows": 3}


def test_json_files_of_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, video string")
    writers.json_array(empty, str(tmp_path / "a.json"), ["id"])
    assert json.load(open(tmp_path / "a.json")) == []


def test_label_lines_of_any_white_space(spark, tmp_path):
    lines = ["Car 0 0 0 1 2 3 4 5", "Car  0\t0 0 1.5 2 3 4 5", "Car 0 0 0 1 2 3 4", "DontCare 0 0 0 1 2 3 4 5", "Car 0 0 0 1 x 3 4 5", "", "Van 0 0 0 1 2 9 9 1 1 1 1 1 1 1 0.5", "Van 0 0 0 1 2 9 9 1 1 1 1 1 1 1 high"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    df = readers.label_lines(spark, str(tmp_path))
    got = sorted((r.type, r.x, r.w, r.score) if r.score else (r.type, r.x, r.w) for r in readers.boxes_by_stem(df, True).collect())
    assert got == [("Car", 1.0, 2.0), ("Car", 1.5, 1.5), ("Van", 1.0, 8.0), ("Van", 1.0, 8.0, 0.5)]
    assert readers.boxes_by_stem(df).columns == ["stem", "type", "x", "y", "w", "h"]
    assert [list(r.box) for r in readers.corner_labels(df).filter("type = 'Car'").orderBy("pos").collect()][1] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        readers.boxes_by_stem(df.filter("false"))


def test_permuted_choices(spark):
    data = [("q", ["A. one", "B. two", "C. one"], "c"), ("q", ["A. one"], "A"), ("q", ["A. x", "B. y"], "Z"), ("q", [], ""), ("p", ["A. a", "A. b", "B. c"], "a")]
    df = spark.createDataFrame(data, "q string, choices array<string>, answer string")
    got = [(list(r.p.choices), r.p.answer) for r in df.select(T.permuted(F.col("q"), F.col("choices"), F.col("answer")).alias("p")).collect()]
    assert sorted(x[3:] for x in got[0][0]) == ["one", "one", "two"] and [x[:2] for x in got[0][0]] == ["A.", "B.", "C."]
    assert got[0][1] == max(x[0] for x in got[0][0] if x.endswith("one"))
    assert got[1:4] == [(["A. one"], "A"), (["A. x", "B. y"], "Z"), ([], "")]
    assert sorted(x[3:] for x in got[4][0]) == ["b", "c"] and f"{got[4][1]}. b" in got[4][0]


def test_overlapping_equals_all_pairs(spark):
    rng = random.Random(1)
    boxes = [(i, i % 3, *[float(rng.randrange(-2, 20)) for _ in range(4)]) for i in range(240)]
    df = spark.createDataFrame(boxes, "id int, k int, b_xmin double, b_ymin double, b_xmax double, b_ymax double")
    left, right = df, df.select(F.col("id").alias("id2"), "k", *[F.col(f"b_{c}").alias(f"g_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])

    def iou(a, b):
        i = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        u = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - i
        return i / u if u else 0

    for t in (0.2, 0.5, 0.8):
        got = {(r.id, r.id2) for r in K.overlapping(left, right, ["k"], "b_", "g_", t).collect()}
        assert got == {(a[0], b[0]) for a, b in itertools.product(boxes, boxes) if a[1] == b[1] and iou(a, b) >= t}


def test_running_values(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, o int, v int").repartition(5)
    kinds = {"s": (F.col("v"), "sum"), "m": (F.col("v"), "max"), "sb": (F.col("v"), "sum_before"), "mb": (F.col("v"), "max_before")}
    got = {(r.o): (r.s, r.m, r.sb, r.mb) for r in D.running(df, ["g"], ["o"], kinds).collect()}
    seen = {}
    for g, o, v in data:
        old = seen.get(g, [])
        assert got[o] == (sum(old) + v, max([*old, v]), sum(old) if old else None, max(old) if old else None)
        seen[g] = [*old, v]


def test_samples_of_strata_whose_hashes_crowd(spark):
    """Keys whose hashes are all high: what the bound leaves out is looked up."""
    high = [i for i in range(200_000) if i * 2654435761 % 4294967296 > 4.2e9][:600]
    df = spark.createDataFrame([(i, "a") for i in high] + [(i, None) for i in range(300)], "key long, s string")
    got = D.stratified_sample(df, ["s"], "key", 0.1).collect()
    rank = lambda i: i * 2654435761 % 4294967296
    assert sorted(r.key for r in got if r.s == "a") == sorted(sorted(high, key=rank)[: len(high) // 10])
    assert sorted(r.key for r in got if r.s is None) == sorted(sorted(range(300), key=rank)[:30])


def test_sidecar_records(spark):
    people = [("train", "s1/a.jpg", "exact"), ("train", "x/b.jpg", "suffix"), ("train", "y/c.jpg", "one"), ("train", "z/c.jpg", "other"), ("val", "s9", "alone")]
    images = [("train", "s1", "a.jpg"), ("train", "s2", "b.jpg"), ("train", "s3", "c.jpg"), ("val", "s9", "q.jpg"), ("val", "s8", "q.jpg")]
    got = PS.resolve(spark.createDataFrame(images, "split string, scene string, image string"), spark.createDataFrame(people, "split string, key string, record string"))
    assert {(r.scene, r.record) for r in got.collect()} == {("s1", "exact"), ("s2", "suffix"), ("s9", "alone")}


def test_categories_must_agree(spark):
    a, b = (spark.createDataFrame([(1, n)], "id int, name string") for n in ("x", "y"))
    D.same_categories([a, a], ["id", "name"])
    with pytest.raises(ValueError):
        D.same_categories([a, a, b], ["id", "name"])


def test_replies_that_only_think_fail(spark):
    df = spark.createDataFrame([("<think>so</think> yes",), (None,)], "r string")
    assert [r[0] for r in df.select(T.without_think(F.col("r"), True)).collect()] == ["yes", None]
    with pytest.raises(Exception, match="thinking alone"):
        spark.createDataFrame([("<think>so</think> ",)], "r string").select(T.without_think(F.col("r"), True)).collect()


def test_question_headers_need_a_colon():
    got = E.parse_qa("Questionnaires are dull\n=====\nQuestion: is it?\n=====\nAnswer: yes")
    assert [(x["question"], x["answer"]) for x in got] == [("is it?", "yes")]


def test_rounds_of_matching_are_of_one_search(spark, sf, monkeypatch):
    plans, real = [], writers.matching_result

    def written(rounds, *more):
        plans.extend(r._jdf.queryExecution().optimizedPlan().toString() for r in rounds)
        real(rounds, *more)

    monkeypatch.setattr(writers, "matching_result", written)
    entry.queries()["matching_coverage"](spark, sf)
    assert len(plans) == 2 and all("LogicalRDD" in p and "Join" not in p and "MapInPandas" not in p for p in plans)


def test_copies_of_boxes_are_measured_once(spark):
    began = time.monotonic()
    box = lambda n, x: spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").alias(f"{n}_id"), *[F.lit(v).alias(f"{n}_{c}") for c, v in (("xmin", x), ("ymin", 0.0), ("xmax", x + 9), ("ymax", 9.0))])
    left = box("a", 0.0).unionByName(box("a", 4.0).filter("a_id < 2"))
    right = box("b", 6.0)
    assert K.overlapping(left, right, ["k"], "a_", "b_", 0.5).groupBy("a_xmin", F.round("iou", 4)).count().collect() == [(4.0, round(7 / 11, 4), 120_000)]
    assert time.monotonic() - began < 15


def test_pairs_of_copies_are_made_of_measured_and_rounded_boxes(spark):
    """All pairs of many copies, odd boxes among them; overlaps are rounded as SQL does, once for all copies of two boxes."""
    inf = float("inf")
    shapes = [("a", (0.0, 0.0, 64.0, 50.0)), ("a", (0.0, 0.0, 45.0, 37.0)), ("b", (0.0, 0.0, 64.0, 50.0)), ("a", (0.0, 0.0, inf, 9.0)), ("a", (5.0, 5.0, 5.0, 9.0)), ("a", (9.0, 9.0, 0.0, 0.0)), (None, (0.0, 0.0, 64.0, 50.0))]
    copies = (150, 70, 3, 2, 4, 4, 4)
    rows = [(k, f"{i}-{n}" if n else None, *box) for i, (k, box) in enumerate(shapes) for n in range(copies[i])]
    side = lambda p: spark.createDataFrame(rows, f"k string, {p}id string, " + ", ".join(f"{p}{c} double" for c in ("xmin", "ymin", "xmax", "ymax")))
    pairs = K.overlapping(side("p_"), side("g_"), ["k"], "p_", "g_", 0.5, digits=6)
    assert pairs.columns == ["k", *side("p_").columns[1:], *side("g_").columns[1:], "iou"]
    got = sorted((r.k, r.p_xmax, r.g_xmax, str(r.iou), r.n, r.ids) for r in pairs.groupBy("k", "p_xmax", "g_xmax", "iou").agg(F.count("*").alias("n"), F.count_distinct(F.struct("p_id", "g_id")).alias("ids")).collect())
    want = [("a", 64.0, 64.0, "1.0", 150), ("a", 45.0, 45.0, "1.0", 70), ("b", 64.0, 64.0, "1.0", 3), ("a", inf, inf, "nan", 2)]
    want = [(*w[:4], w[4] ** 2) for w in want] + [("a", a, b, "0.520312", 150 * 70) for a, b in ((64.0, 45.0), (45.0, 64.0))]
    assert got == sorted((*w, w[4]) for w in want)
    # SQL rounds 0.5203125 down, as 520312.49999999994 lies under the middle.
    assert duckdb.sql("SELECT round(1665::DOUBLE / 3200::DOUBLE, 6)").fetchall() == [(0.520312,)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "round(" not in plan


def test_coco_files_are_read_by_many_tasks(spark, tmp_path):
    n, path = 30_000, str(tmp_path / "coco.json")
    images = spark.createDataFrame([(1, None, 9, 9), (2, "b ] }\n.png", 9, 9)], "image_id long, file_name string, height int, width int")
    anns = spark.range(n).select(F.col("id").alias("ann_id"), (F.col("id") % 2 + 1).alias("image_id"), F.lit(1).alias("category_id"), *[F.col("id").cast("double").alias(c) for c in "xywh"], F.lit(1.0).alias("area"), F.lit(0).alias("iscrowd"))
    writers.coco_json(images, anns, spark.createDataFrame([(1, "car")], "category_id long, type string"), path)
    whole = json.load(open(path))
    assert [len(whole[k]) for k in ("images", "annotations", "categories")] == [2, n, 1] and [a["id"] for a in whole["annotations"]] == list(range(n))
    assert os.listdir(tmp_path) == ["coco.json"] or [x for x in os.listdir(tmp_path) if not x.endswith(".crc")] == ["coco.json"]
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        got = readers.coco(spark, path)
        assert [x.count() for x in got] == [2, n, 1] and got[1].rdd.getNumPartitions() > 1
        assert {(r.image_id, r.file_name) for r in got[0].collect()} == {(1, None), (2, "b ] }\n.png")}
        (tmp_path / "plain.json").write_text(json.dumps(whole))
        assert readers.coco(spark, str(tmp_path / "plain.json"))[1].exceptAll(got[1]).isEmpty()
        text = open(path).read()
        (tmp_path / "cut.json").write_text(text[: len(text) // 2])
        with pytest.raises(Exception):
            readers.coco(spark, str(tmp_path / "cut.json"))[1].collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
