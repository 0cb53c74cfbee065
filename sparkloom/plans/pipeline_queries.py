"""Queries of composed pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import boxes
from sparkloom.operators import augment as G
from sparkloom.operators import box_quality as Q
from sparkloom.operators import frames as S
from sparkloom.operators import person_sets as PS
from sparkloom.operators import video_qa as V
from sparkloom.operators.datasets import numbered

from .registry import query
from .tables import BOXES, GT, boxes_gt, table


@query(
    "validate_and_correct",
    BOXES
    + """, fixed AS (SELECT *, least(a, c) AS x1, least(b, d) AS y1, greatest(a, c) AS x2, greatest(b, d) AS y2 FROM (SELECT row_id, type, greatest(bbox_xmin, 0) AS a, greatest(bbox_ymin, 0) AS b,
    greatest(least(bbox_xmax, img_width), 0) AS c, greatest(least(bbox_ymax, img_height), 0) AS d FROM st WHERE status = 'INVALID'))
    SELECT type, count(*) AS corrected, count(*) FILTER (x2 > x1 AND y2 > y1 AND x1 <= 640 AND y1 <= 480) AS mended FROM fixed GROUP BY type""",
)
def _(spark, sf):
    bad = Q.classify(boxes_gt(spark, sf)).filter("status = 'INVALID'").select("row_id", "type", *Q.COORDS, "img_width", "img_height", "truncated", "occluded")
    fixed = Q.classify(Q.correct_labels(bad))
    good = F.col("status") != "INVALID"
    return fixed.groupBy("type").agg(F.count("*").alias("corrected"), F.count_if(good).alias("mended"))


@query(
    "padded_shards",
    "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part), t AS (SELECT *, CAST(ceil(n / 96.0::DOUBLE) * 96 AS BIGINT) AS total FROM p) SELECT p_partkey, CAST(slot AS INTEGER) AS slot, CAST(floor(slot / (total / 8)) AS BIGINT) AS shard FROM t, generate_series(0, 30000) g(slot) WHERE slot < total AND (slot = pos OR (pos = n - 1 AND slot >= n))",
)
def _(spark, sf):
    part = numbered(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], "pos", 0)
    return G.padded_shards(part, "pos", part.count(), 12, 8).select("p_partkey", "slot", "shard")


_M15 = boxes.affine((640, 480), 15, out_size=(320, 240))


def _moved(i: int) -> str:
    return ", ".join(f"bbox_{x} * ({_M15[i][0]!r}::DOUBLE) + bbox_{y} * ({_M15[i][1]!r}::DOUBLE) + ({_M15[i][2]!r}::DOUBLE)" for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")))


@query(
    "augmented_boxes",
    f"""WITH {GT}, m AS (SELECT row_id, least(greatest(least({_moved(0)}), 0), 320) AS a, least(greatest(least({_moved(1)}), 0), 240) AS b, least(greatest(greatest({_moved(0)}), 0), 320) AS c,
    least(greatest(greatest({_moved(1)}), 0), 240) AS d FROM boxes_gt) SELECT row_id, round(a, 4) AS bbox_xmin, round(b, 4) AS bbox_ymin, round(c, 4) AS bbox_xmax, round(d, 4) AS bbox_ymax FROM m WHERE c > a AND d > b""",
)
def _(spark, sf):
    return G.augment_boxes(boxes_gt(spark, sf), _M15, 320, 240).select("row_id", *[F.round(c, 4).alias(c) for c in Q.COORDS])


@query(
    "flipped_boxes",
    f"""WITH {GT}, f AS (SELECT *, CAST('0x' || substr(md5('42:' || image_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.5 AS flip FROM boxes_gt)
    SELECT row_id, CASE WHEN flip THEN img_width - bbox_xmax ELSE bbox_xmin END AS bbox_xmin, bbox_ymin, CASE WHEN flip THEN img_width - bbox_xmin ELSE bbox_xmax END AS bbox_xmax, bbox_ymax FROM f""",
)
def _(spark, sf):
    return G.random_flips(boxes_gt(spark, sf), "image_id").select("row_id", *Q.COORDS)


_REPLIES = {
    "normal_mcq": "Multiple-Choice Question: what?\nA. one\nB. two\n=====\nAnswer: B\nReasoning: since",
    "normal_bcq": "Question: is it?\n=====\nAnswer: Yes, it is",
    "anomaly_temporal_localization": "Open-ended Question: when?\n=====\nAnswer: Start_Time: 00:01, End_Time: 00:07.5",
    "anomaly_event_summary": "1. Question: sum up\n=====\nQuestionnaires are no question\n=====\nAnswer: all is well\n=====\nReasoning: seen",
    "anomaly_other": "Question: why?\n=====\nAnswer: so",
}


@query(
    "video_qa_tasks",
    """SELECT task, 'v' || item_id AS video_id, question, answer, reasoning FROM benchmark JOIN (VALUES
    (0, 'mcq', E'what?\\nA. one\\nB. two\\nAnswer with a single letter.', 'B', 'since'),
    (0, 'mcq_openended', E'what?\\nA. one\\nB. two\\nAnswer with the correct option letter followed by a brief explanation.', 'B. two', 'since'),
    (1, 'bcq', E'is it?\\nAnswer with Yes or No.', 'Yes', ''), (1, 'bcq_openended', E'is it?\\nAnswer with Yes or No followed by a brief explanation.', 'Yes, it is', ''),
    (2, 'temporal_localization', E'when?\\nAnswer with the start and end timestamps in the format {"start": "MM:SS", "end": "MM:SS"}.', '{"start":"00:01","end":"00:07.5"}', ''),
    (3, 'video_summarization', 'sum up', 'all is well', 'seen'), (4, 'open_qa', 'why?', 'so', '')) t(k, task, question, answer, reasoning) ON item_id % 5 = k""",
)
def _(spark, sf):
    keys, texts = (F.array(*[F.lit(x) for x in xs]) for xs in (_REPLIES, _REPLIES.values()))
    k = (F.col("item_id") % 5).cast("int")
    replies = table(spark, sf, "benchmark").select(F.concat(F.lit("root/v"), "item_id").alias("video"), F.get(keys, k).alias("prompt_key"), F.get(texts, k).alias("qa_output"))
    return V.task_items(replies, "root").select("task", "video_id", "question", "answer", "reasoning")


@query("video_prompt_keys", "SELECT conv_id AS video, (CASE WHEN conv_id % 2 = 0 THEN 'anomaly' ELSE 'normal' END) || '_' || t AS prompt_key FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('mcq'), ('bcq')) v(t)")
def _(spark, sf):
    entries = table(spark, sf, "conversations").select(F.col("conv_id").alias("video")).distinct().withColumn("mode", F.when(F.col("video") % 2 == 0, "anomaly").otherwise("auto"))
    return V.prompt_keys(entries, ["mcq", "bcq"]).select("video", "prompt_key")


@query("person_caption_pairs", """WITH p AS (SELECT p_partkey, 'scene' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS scene, p_size % 2 AS s FROM part), l AS (SELECT * FROM (VALUES (0, 'easy'), (1, 'medium'), (2, 'hard')) v(k, query_type)), q AS (SELECT * FROM generate_series(0, 2) g(i))
    SELECT row_number() OVER (ORDER BY scene, k, i) - 1 AS idx, scene, query_type, i AS query_index, query_type || ' ' || i AS caption FROM p, l, q""")
def _(spark, sf):
    vocab = PS.vocabulary({a: {"red": 0, "blue": 1, "not visible": 2, "none": 3, "barefoot": 4} for a in PS.ATTRIBUTES})
    color = F.when(F.col("p_size") % 2 == 0, "Red").otherwise("blue")
    attributes = F.create_map(*[x for a in PS.ATTRIBUTES for x in (F.lit(a), color)])
    queries = F.create_map(*[x for level in PS.LEVELS for x in (F.lit(level), F.array(*[F.lit(f" {level} {i} ") for i in range(3)]))])
    scene = F.concat(F.lit("scene"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    images = table(spark, sf, "part").select(F.lit("train").alias("split"), scene.alias("scene"), F.lit("a.jpg").alias("image"), attributes.alias("attributes"), queries.alias("queries"))
    return PS.pairs(images, vocab).select("idx", "scene", "query_type", F.col("query_index").cast("bigint").alias("query_index"), "caption")


@query(
    "scene_boxes",
    "SELECT event_id, round(value - 1, 6) AS x, round(-(user_id % 7) * 0.5::DOUBLE, 6) AS heading FROM events WHERE user_id % 3 <> 1",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    zero, one = F.lit(0.0), F.lit(1.0)
    place, size, turn = F.array(F.col("value"), zero, zero), F.array(one, one, one), F.array(zero, zero, (F.col("user_id") % 7) * 0.5)
    vis = F.create_map(F.element_at(F.array(F.lit("cam0"), F.lit("cam1"), F.lit("cam2")), (F.col("user_id") % 3 + 1).cast("int")), one)
    rows = e.select("event_id", vis.alias("visibility"), S.gt_box(place, size, turn, F.array(one, zero, zero)).alias("box"))
    rows = S.seen_by_group(rows, ["cam0", "cam2"])
    return rows.select("event_id", F.round(F.col("box")[0], 6).alias("x"), F.round(F.col("box")[6], 6).alias("heading"))
