import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import augment as G
from sparkloom.operators import frames as S
from sparkloom.operators import person_sets as PS
from sparkloom.operators import video_qa as V


def test_task_items(spark):
    rows = [
        ("r/v1.mp4", "normal_mcq", "Multiple-Choice Question: q?\nA. x\nB. y\n=====\nAnswer: a"),
        ("r/v1.mp4", "anomaly_temporal_localization", "Open-ended Question: when?\n=====\nAnswer: Start_Time: 00:05, End_Time: 00:09"),
        ("other/v2.mp4", "normal_bcq", "Question: is it?\n=====\nAnswer: maybe"),
        ("r/v3.mp4", "normal_scene_description", "Open-ended Question: what?\n=====\nAnswer: a road\n=====\nReasoning: seen"),
        ("r/v4.mp4", "normal_mcq", "Multiple-Choice Question: no choices?\n=====\nAnswer: A"),
        ("r/v5.mp4", "normal_openended", ""),
    ]
    df = spark.createDataFrame(rows, "video string, prompt_key string, qa_output string")
    got = {(r.task, r.video_id): (r.answer, r.reasoning) for r in V.task_items(df, "r/").collect()}
    assert got == {
        ("mcq", "v1.mp4"): ("A", ""), ("mcq_openended", "v1.mp4"): ("A. x", ""), ("temporal_localization", "v1.mp4"): ('{"start":"00:05","end":"00:09"}', ""),
        ("scene_description", "v3.mp4"): ("a road", "seen"),
    }
    assert tuple(V.parse_stats(df).first()) == (6, 5, 0, 1)


def test_video_steps(spark):
    videos = spark.createDataFrame([("a", 12.0), ("b", 0.4)], "video string, video_length double")
    assert [(r.chunk_index, r.timestamp_start, r.timestamp_end) for r in V.with_chunks(videos).orderBy("chunk_index").collect()] == [(0, 0.0, 5.0), (1, 5.0, 10.0), (2, 10.0, 12.0)]
    first, second = spark.createDataFrame([("a", "old", "x")], "video string, caption string, dense string"), spark.createDataFrame([("a", "new"), ("b", "only")], "video string, caption string")
    got = {r.video: (r.caption, r.dense) for r in V.merged_steps([first, second], ["caption", "dense"]).collect()}
    assert got == {"a": ("new", "x"), "b": ("only", None)}
    marked = V.highlight_from_reply(spark.createDataFrame([("a", 12.0, "at 9.5 s"), ("b", 5.0, "none")], "video string, video_length double, reply string")).collect()
    assert (marked[0].highlight_start, marked[0].highlight_end, marked[1].highlight_start) == (6.5, 12.0, None)
    entries = spark.createDataFrame([("a", "p1", "k"), ("b", "p2", "k")], "video string, prompt string, prompt_key string")
    done = V.ask(entries.filter("video = 'a'"), "prompt", lambda: lambda ps: [p + "!" for p in ps])
    assert {r.video for r in V.ask(entries, "prompt", lambda: lambda ps: [p + "!" for p in ps], done).collect()} == {"a", "b"}


VOCAB = {a: {"red": 0, "Not visible": 1, "none": 2, "bare foot": 3, "barefoot": 4} for a in PS.ATTRIBUTES}


def person(spark, **more):
    attributes = {a: "Red" for a in PS.ATTRIBUTES if a != "shoe color"} | {"shoe type": "Barefoot"} | more
    queries = {level: [f"{level} {i}" for i in range(3)] for level in PS.LEVELS}
    rows = [("train", "s_aug2", "a.jpg", attributes, queries), ("val", "s", "a.jpg", attributes, queries)]
    return spark.createDataFrame(rows, "split string, scene string, image string, attributes map<string, string>, queries map<string, array<string>>")


def test_person_pairs(spark):
    vocab = PS.vocabulary(VOCAB)
    rows = PS.pairs(person(spark, **{"viewpoint": "not visible"}), vocab).collect()
    assert len(rows) == 9 + 3 and sorted(r.idx for r in rows) == list(range(12))
    easy = next(r for r in rows if r.query_type == "easy" and r.split == "train")
    assert easy.image_attr_values == [0, 0, 0, 0, 2, 4, 1] and easy.text_attr_values == [0, 0, 0, 0, -1, -1, -1]
    assert easy.person_id == "s" and easy.is_augmented
    hard = next(r for r in rows if r.query_type == "hard")
    assert hard.text_attr_values == [0, 0, 0, 0, 2, 4, -1]
    with pytest.raises(Exception, match="outside the vocabulary"):
        PS.pairs(person(spark, **{"bottom type": "zzz"}), vocab).collect()
    with pytest.raises(ValueError):
        PS.pairs(person(spark), vocab, "some")
    for bad in ({"red": 0, "RED ": 1}, {"red": True}):
        with pytest.raises(ValueError):
            PS.vocabulary(VOCAB | {"viewpoint": bad})


def test_sidecars_are_resolved_by_three_rules(spark):
    images = spark.createDataFrame([("t", "s1", "a.jpg"), ("u", "s2", "b.jpg"), ("w", "s3", "c.jpg"), ("w", "s3", "d.jpg")], "split string, scene string, image string")
    people = [("t", "s1/a.jpg", "exact"), ("t", "x/a.jpg", "other"), ("u", "s2", "scene"), ("w", "z/c.jpg", "suffix"), ("w", "y/d.jpg", "1"), ("w", "q/d.jpg", "2")]
    got = {(r.split, r.image): r.record for r in PS.resolve(images, spark.createDataFrame(people, "split string, key string, record string")).collect()}
    assert got == {("t", "a.jpg"): "exact", ("u", "b.jpg"): "scene", ("w", "c.jpg"): "suffix"}


def test_manifests(spark):
    a = PS.manifest(spark.createDataFrame([("p", bytearray(b"x"))], "path string, content binary"))
    assert a.first().bytes == 1 and PS.same_manifest(a, a) and not PS.same_manifest(a, a.withColumn("path", F.lit("q")))


def test_shards_have_equal_lengths_and_lose_nothing(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    rows = G.padded_shards(df, "pos", 10, 2, 3).collect()
    assert len(rows) == 12 and {r.pos for r in rows} == set(range(10))
    assert sorted(r.shard for r in rows) == sorted([0, 1, 2] * 4)


def test_scenes(spark):
    df = spark.createDataFrame([("s", "o", 0, 1.0), ("s", "o", 1, 1.5), ("s", "o", 3, 9.0)], "scene string, obj string, frame int, x double")
    assert [r.v_x for r in S.velocity(df, ["scene", "obj"], "frame", ["x"], 30.0).orderBy("frame").collect()] == [0.0, 15.0, 0.0]
    one = spark.createDataFrame([({"a": [0.0, 0.0, 2.0, 2.0], "b": [0.0, 0.0, 0.0, 0.0]}, {"a": [0.0, 0.0, 1.0, 2.0]})], "f map<string, array<double>>, s map<string, array<double>>")
    assert one.select(S.visibility(F.col("f"), F.col("s"))).first()[0] == {"a": 0.5, "b": 0.0}
    few = spark.createDataFrame([(0.0, 0.0, 2.0), (10.0, 0.0, 4.0)], "x double, y double, w double")
    assert sorted(round(r.log_w, 4) for r in S.anchors(few, 5, ["x", "y"], ["w"]).collect()) == [0.6931, 1.3863]


def test_token_limits():
    assert [T.token_limit(x, m) for x, m in ((128, ""), (10**30, "CLIP-large"), (0, "SigLIP"), (None, "x"))] == [128, 77, 64, 64]


def test_names_captions_and_missing_texts(spark):
    from sparkloom.operators import datasets as D
    from sparkloom.operators import pairs as P

    rows = [("val", "b/x.png", "c2", 2), ("train", "a/y", "c1", 1), ("val", "b/z.jpeg", "c1", 3), ("val", "b/w", "", 4)]
    df = spark.createDataFrame(rows, "split string, image_path string, caption string, id int")
    assert {r.id: r.name for r in P.output_names(df, ["id"]).collect()} == {1: "train_00000000.jpg", 2: "val_00000000.png", 3: "val_00000001.jpeg", 4: "val_00000002.jpg"}
    assert [r.caption for r in P.caption_classes(df).collect()] == ["", "c1", "c2"]
    assert [(r.split, r.cnt, r.ids) for r in P.lacking_text(df, ["split"], "caption").collect()] == [("val", 1, [4])]
    types = spark.createDataFrame([("Car",), ("VAN",), ("dog",)], "type string")
    assert [r.type for r in D.group_classes(types, {"vehicle": ["car", "van"]}).collect()] == ["vehicle", "vehicle", "dog"]
    assert D.split_folders({"train", "eval", "x"}) == {"train": "train", "test": "eval"}
    for bad in ({"val"}, {"train", "eval", "test"}):
        with pytest.raises(ValueError):
            D.split_folders(bad)
