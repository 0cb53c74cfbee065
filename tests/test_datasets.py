import json
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import video
from sparkloom.operators import annotations as A
from sparkloom.operators import datasets as D
from sparkloom.operators import enrich as E
from sparkloom.operators import gaps as G
from sparkloom.operators import pairs as P
from sparkloom.sources import readers, writers
from sparkloom.streaming import resume


def test_numbers_are_consecutive_in_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(1).alias("x")).repartition(9)
    got = sorted((r.k, r.n) for r in D.numbered(df, ["k"], "n").collect())
    assert got == [(i, i + 1) for i in range(1000)]
    assert D.numbered(df.filter("false"), ["k"], "n").count() == 0


def test_merging_policies(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("a", 2, "z")], "id string, pos int, v string")
    assert D.merge_records(df, "id", ["pos"], "keep").count() == 3
    assert {(r.id, r.v) for r in D.merge_records(df, "id", ["pos"], "skip").collect()} == {("a", "x"), ("b", "y")}
    with pytest.raises(ValueError):
        D.merge_records(df, "id", ["pos"])


def test_updates_and_steps(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "b", "k")], "id int, x string, y string")
    right = spark.createDataFrame([(2, None, "q"), (3, "c", "z")], "id int, x string, w string")
    got = {r.id: r for r in D.update_records(left, right, "id").collect()}
    assert got[2].x == "b" and got[2].w == "q" and got[3].x == "c" and got[1].y is None
    steps = spark.createDataFrame([("v", 1, "old", "only"), ("v", 2, "new", None)], "video string, step int, a string, b string")
    assert D.latest_step(steps, "video", "step", ["a", "b"]).first()[1:] == ("new", "only")


def test_threshold_search(spark):
    scored = lambda rows: spark.createDataFrame(rows, "score double, positive boolean")
    assert 0.2 <= G.optimal_threshold(scored([(0.1, False), (0.2, False), (0.8, True), (0.9, True)])).first().threshold < 0.8
    low = G.optimal_threshold(scored([(0.5, True), (0.9, False), (0.95, True)])).first()
    assert low.threshold < 0.5 and low.recall == 1
    assert G.optimal_threshold(scored([])).count() == 0


def test_weakness_and_answers(spark):
    df = spark.createDataFrame([(1, " pass ", 0.7), (2, "NO_PASS", 0.7), (3, "pass", 0.5)], "id int, label string, score double")
    got = {r.id: round(r.weakness, 6) for r in G.weakest(df, 0.5, 1).collect()}
    assert got == {1: 0.2, 2: -0.2}
    rows = [("Yes.", "no"), ("no", "It is yes"), ("nothing", "yes"), ("yes and no", "no"), ("yes", "yes")]
    gaps = G.disagreements(spark.createDataFrame(rows, "response string, gt string")).collect()
    assert sorted(r.gap for r in gaps) == ["FN", "FP"]


def test_qa_parser():
    reply = """preamble
=====
1. Multiple-Choice Question: What happens?
A. one
B. two
======
Answer: B
Reasoning: since
=====
Question: Is it?
=====
Answer: Yes
=====
Open-ended Question: Why?
========
Reasoning: because
"""
    got = E.parse_qa(reply)
    assert [(q["type"], q["question"], q["answer"], q["reasoning"], len(q["choices"])) for q in got] == [
        ("mcq", "What happens?", "B", "since", 2), ("binary", "Is it?", "Yes", "", 0), ("openended", "Why?", "", "because", 0)
    ]
    assert E.parse_qa("") == E.parse_qa(None) == []


def test_replies_are_read_loosely():
    assert E.loose_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert E.loose_json("so: {'a': [1, 2]} done") == {"a": [1, 2]}
    assert E.loose_json("none") is None
    assert E.whole_objects('[{"a": 1}, {"b": 2}, {"c"') == [{"a": 1}, {"b": 2}]
    assert E.whole_objects('{"a": 1}\n{"b": 2}') == [{"a": 1}, {"b": 2}]


def test_reconciling_boxes():
    before = [{"text": "x", "instances": [{"bbox_id": "b0", "bbox": [0, 0, 1, 1], "bbox_score": 0.5}]}]
    got = E.reconcile(before, [{"text": "x", "boxes": [[0, 0, 1, 1], [2, 2, 3, 3]]}, {"text": "y", "boxes": []}])
    assert [(i["bbox_id"], i["bbox_score"]) for i in got[0]["instances"]] == [("b0", 0.5), ("new_00000", 0.9)] and len(got) == 1


def test_enrichment_retries_and_resumes(spark):
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return ["ok"]

    assert E.with_retry(flaky, sleep=waits.append) == ["ok"] and waits == [5.0, 10.0]
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "boom")], "id int, p string")

    def factory():
        def model(prompts):
            if "boom" in prompts:
                raise OSError
            return [p.upper() for p in prompts]

        return model

    got = {r.id: r.reply for r in E.enrich(df, "p", "reply", factory, batch=1, wait=0).collect()}
    assert got == {1: "A", 2: None, 3: E.FAILED}


def test_video_columns(spark):
    df = spark.createDataFrame([(10.0, 5.0), (1.5, 1.0), (0.5, 0.0), (120.0, 119.0)], "len double, at double")
    start, end = video.highlight(F.col("at"), F.col("len"))
    rows = df.select("len", start.alias("s"), end.alias("e"), F.size(video.chunks(F.col("len"), video.chunk_seconds(F.col("len")))).alias("n"), F.size(video.frame_times(F.col("len"))).alias("f")).collect()
    assert [(r.s, r.e, r.n, r.f) for r in rows] == [(2.0, 8.0, 2, 5), (0.0, 1.5, 1, 1), (0.0, 0.5, 0, 1), (116.0, 120.0, 8, 60)]


def test_attribute_pairs_with_accessories(spark):
    attrs = lambda **a: a
    q = spark.createDataFrame([("q", ["top", "accessories"], attrs(top="red", accessories="black hat, white bag"), "red top with a black hat and a bag")], "query_id string, names array<string>, attributes map<string, string>, text string")
    images = [("i1", attrs(top="red", accessories="black hat, blue bag")), ("i2", attrs(top="red", accessories="green hat, white bag")), ("i3", attrs(top="blue", accessories="black hat, white bag")), ("i4", attrs(top="red"))]
    got = P.attribute_pairs(q, spark.createDataFrame(images, "image_id string, attributes map<string, string>")).collect()
    assert {r.image_id for r in got} == {"i1"}


def test_constraints_and_vectors(spark):
    vocab = {"a": {"red": 0, "not visible": 1}, "b": {"x": 5}}
    df = spark.createDataFrame([({"a": "Red ", "b": "x"},), ({"a": "not visible", "b": "zz"},)], "m map<string, string>")
    v = P.attribute_vector(F.col("m"), ["a", "b"], vocab)
    c = P.text_constraints(v, F.lit(1), F.array(F.array(F.lit(1)), F.array(F.lit(9))))
    assert [(r[0], r[1]) for r in df.select(v, c).collect()] == [([0, 5], [0, -1]), ([1, None], [-1, -1])]


def test_readers(spark, tmp_path):
    good = "Car 0.00 0 -1.57 614.24 181.78 727.31 284.77 1.57 1.73 4.15 1.00 1.75 8.20 -1.56"
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text(good + " 0.92\n\n" + good.replace("614.24", "x") + "\nDontCare " + good[4:] + "\n" + good + " 1 2\n")
    (tmp_path / "l" / "b.txt").write_text("")
    rows = readers.label_lines(spark, str(tmp_path / "l"))
    assert sorted(r.n_fields for r in rows.collect()) == [15, 15, 16, 17]
    assert rows.filter(readers.is_label(rows)).count() == 2
    assert readers.boxes_by_stem(rows, True).filter("score is not null").count() == 2
    coco = {"images": [{"id": 1, "file_name": "d/f.png", "height": 5, "width": 6}, {"id": 2, "filepath": "e/f.png", "file_name": "", "height": 5, "width": 6}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 9, "category_id": 3, "bbox": [1, 2, 3, 4]}, {"id": 3, "image_id": 1, "category_id": 3, "bbox": [1, 2, 3]}], "categories": [{"id": 3, "name": "car"}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    images, anns, cats = readers.coco(spark, str(tmp_path / "c.json"))
    assert [r.file_name for r in images.orderBy("image_id").collect()] == ["d/f.png", "e/f.png"] and anns.count() == 1
    assert readers.single_basenames(images).count() == 0
    assert readers.coco_boxes(images, anns, cats).first().bbox_xmax == 4
    (tmp_path / "q.jsonl").write_text('{"id": "1", "video_path": "v", "question": "q", "answer": "a"}\n\n')
    assert readers.question_answers(spark, str(tmp_path / "q.jsonl")).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"id": "1", "video_path": "v", "question": "q"}\n')
    with pytest.raises(Exception):  # noqa: B017
        readers.question_answers(spark, str(tmp_path / "bad.jsonl")).collect()
    assert readers.tolerant_records(spark, str(tmp_path / "q.jsonl"), "id string").count() == 1
    with pytest.raises(ValueError):
        readers.load(spark, "x", "unknown")


def test_writers_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("car", 1, "VALID", 4.0), ("car", 2, "INVALID", 0.0)], "type string, k int, status string, bbox_area double")
    writers.valid_invalid_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv" / "valid")).columns == ["type", "k", "status"]
    kinds = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"zz"),)], "content binary").select(writers.image_kind().alias("k")).collect()
    assert [r.k for r in kinds] == ["jpeg", None]
    src = str(tmp_path / "in")
    schema = "id int, ts timestamp, v int"
    rows = spark.sql("select 1 as id, timestamp'2024-01-01 00:00:00' as ts, 5 as v union all select 1, timestamp'2024-01-01 00:00:00', 5 union all select 2, timestamp'2024-01-01 01:00:00', 6")
    rows.coalesce(1).write.parquet(src)
    for _ in range(2):
        stream = resume.new_records(spark, src, schema, ["id"], "ts")
        resume.run_once(stream, lambda d: d.withColumn("w", F.col("v") * 2), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.w for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [10, 12]


def test_text_columns(spark):
    df = spark.createDataFrame([("The “red” car – fast/ ", "a/b/c.tar.gz", "cat: [[1, 2, 3, 4], [5, 6]]")], "a string, b string, c string")
    r = df.select(T.clean_span(F.col("a")).alias("s"), T.stem(F.col("b")).alias("st"), T.phrase_boxes(F.col("c")).alias("p"), T.has_phrase(F.lower("a"), F.lit("car")).alias("h"), T.has_phrase(F.lower("a"), F.lit("ca")).alias("n")).first()
    assert r.s == "The 'red' car — fast" and r.st == "c.tar" and r.p.phrase == "cat" and r.p.boxes == [[1.0, 2.0, 3.0, 4.0]] and r.h and not r.n
    with pytest.raises(ValueError):
        T.fill_template("{x}", y=F.lit(1))


def test_odvg_round_trip(spark):
    labels = spark.createDataFrame([("a.png", 1, "car", 1.0, 1.0, 4.0, 4.0, 10, 10), ("a.png", 2, "car", 1.0, 1.0, 4.0, 4.0, 10, 10), ("b.png", 1, "dog", -5.0, 0.0, 3.0, 30.0, 10, 10), ("b.png", 2, "dog", 11.0, 0.0, 13.0, 3.0, 10, 10)], "file_name string, pos int, type string, bbox_xmin double, bbox_ymin double, bbox_xmax double, bbox_ymax double, img_width int, img_height int")
    images, anns, cats = A.labels_to_coco(labels)
    assert [(r.ann_id, r.x, r.w, r.h) for r in anns.orderBy("ann_id").collect()] == [(1, 1.0, 3.0, 3.0), (2, 0.0, 3.0, 10.0)]
    back = A.odvg_to_coco(A.coco_to_odvg(images, anns, cats)).orderBy("ann_id").collect()
    assert [(r.ann_id, r.category_id, r.w) for r in back] == [(0, 1, 3.0), (1, 2, 3.0)]


def test_caption_pairs_of_very_many_equal_queries_and_images(spark):
    began = time.monotonic()
    has = F.create_map(F.lit("top"), F.lit("red")).alias("attributes")
    q = spark.range(40_000).select(F.col("id").alias("query_id"), F.array(F.lit("top")).alias("names"), has, F.concat(F.lit(" c"), F.col("id") % 2).alias("text"), F.lit("easy").alias("query_type"))
    i = spark.range(40_000).select(F.col("id").alias("image_id"), F.concat(F.lit("p"), F.col("id") % 2).alias("image_path"), F.lit("train").alias("split"), F.lit("d").alias("dataset"), has)
    got = P.build(q.filter("query_id > 2"), i.filter("image_id > 2"), {}).select("caption", "image_path", "pair_id").collect()
    assert sorted(tuple(r) for r in got) == [(f"c{a % 2}", f"p{b % 2}", f"{a:012d}-{b:012d}") for a in (4, 3) for b in (4, 3)]
    assert time.monotonic() - began < 30


def test_pairs_of_one_key_are_made_by_several_tasks(spark):
    has = F.create_map(F.lit("top"), F.lit("red")).alias("attributes")
    q = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit("top")).alias("names"), has, F.lit("c").alias("text"))
    got = P.attribute_pairs(q, spark.range(20).select(F.col("id").alias("image_id"), has))
    assert got.distinct().count() == got.count() == 6000
    assert got.groupBy(F.spark_partition_id()).count().count() > 2
