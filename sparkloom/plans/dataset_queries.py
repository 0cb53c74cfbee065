"""Queries of merging, slicing, sampling, conversion, pairs and scenes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions import video
from sparkloom.operators import annotations as A
from sparkloom.operators import datasets as D
from sparkloom.operators import frames as S
from sparkloom.operators import pairs as P

from .registry import query
from .tables import GT, boxes_gt, table


@query("merge_first_wins", "SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY text")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return D.merge_records(docs, "text", ["doc_id"], "skip").select("doc_id", F.md5("text").alias("h"))


@query("merge_keep", "SELECT doc_id, lang FROM documents")
def _(spark, sf):
    return D.merge_records(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", ["doc_id"], "keep")


@query("merge_error", "SELECT doc_id, n_chars FROM documents")
def _(spark, sf):
    return D.merge_records(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", ["doc_id"], "error")


@query("merge_renumber_ids", "SELECT row_number() OVER (ORDER BY src, id) AS new_id, src, id FROM (SELECT CAST(0 AS BIGINT) AS src, c_custkey AS id FROM customer UNION ALL SELECT 1, s_suppkey FROM supplier)")
def _(spark, sf):
    parts = [table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))]
    return D.merge_renumbered(parts, "id", "new_id")


@query(
    "merge_grouped_regions",
    """SELECT l_orderkey % 1000 AS k, string_agg(l_partkey, ',' ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS regions, count(*) AS n FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey") % 1000)
    got = D.merge_grouped(rows, "k", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], F.col("l_partkey").cast("string"))
    return got.select("k", F.array_join("regions", ",").alias("regions"), F.size("regions").cast("bigint").alias("n"))


@query("record_update_merge", "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang) AS lang, source, CAST(toxic AS BIGINT) AS toxic FROM documents FULL OUTER JOIN labels USING (doc_id)")
def _(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", "lang", "source")
    right = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"), F.col("toxic").cast("bigint").alias("toxic"))
    return D.update_records(left, right, "doc_id")


@query("step_merge_latest", """SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS asked, max_by(text, turn) FILTER (role = 'assistant') AS answered FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("asked"), F.when(F.col("role") == "assistant", F.col("text")).alias("answered"))
    return D.latest_step(rows, "conv_id", "turn", ["asked", "answered"])


@query("slice_first_n", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(100)


@query("slice_regex", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^(?:https?://m\\.|http://blog\\.)')")
def _(spark, sf):
    return D.slice_regex(table(spark, sf, "pages").select("page_id", "url"), "url", [r"https?://m\.", r"http://blog\."])


_SLICE = f"WITH {GT}, a AS (SELECT row_id AS ann_id, image_id, type AS category FROM boxes_gt WHERE type IN ('A', 'R') AND type <> 'R'), i AS (SELECT image_id, row_number() OVER (ORDER BY image_id) AS new_image_id FROM (SELECT DISTINCT image_id FROM a)) "


def _sliced(spark, sf):
    boxes = boxes_gt(spark, sf)
    anns = boxes.select(F.col("row_id").alias("ann_id"), "image_id", F.col("type").alias("category"))
    return D.slice_categories(boxes.select("image_id").distinct(), anns, ["A", "R"], ["R"])


@query("slice_category_images", _SLICE + "SELECT image_id, new_image_id FROM i")
def _(spark, sf):
    return _sliced(spark, sf)[0]


@query("slice_category_remap", _SLICE + "SELECT ann_id, image_id, category, new_image_id, row_number() OVER (ORDER BY new_image_id, ann_id) AS new_ann_id FROM a JOIN i USING (image_id)")
def _(spark, sf):
    return _sliced(spark, sf)[1]


_RANK = "(doc_id * 2654435761) % 4294967296"


@query("slice_random_fraction", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_RANK}, doc_id) AS k, count(*) OVER () AS n FROM documents) WHERE k <= floor(0.25 * n)")
def _(spark, sf):
    return D.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.25)[0]


@query("slice_random_remainder", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_RANK}, doc_id) AS k, count(*) OVER () AS n FROM documents) WHERE k > floor(0.25 * n)")
def _(spark, sf):
    return D.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.25)[1]


@query("slice_random_k", f"SELECT doc_id, CAST(floor((k - 1) / ceil(n / 7.0::DOUBLE)) AS BIGINT) AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY {_RANK}, doc_id) AS k, count(*) OVER () AS n FROM documents)")
def _(spark, sf):
    return D.random_parts(table(spark, sf, "documents").select("doc_id"), "doc_id", 7)


@query("stratified_sample", f"SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {_RANK}, doc_id) AS k, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) WHERE k <= greatest(1, floor(n * 0.1))")
def _(spark, sf):
    return D.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 0.1)


@query("contiguous_categories", "SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS new_id FROM (SELECT DISTINCT p_size FROM part WHERE p_partkey % 3 = 0)")
def _(spark, sf):
    part = table(spark, sf, "part")
    return D.contiguous(part, "p_size", part.filter("p_partkey % 3 = 0"))


@query("appearance_ids", "SELECT user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS new_id FROM (SELECT user_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id)")
def _(spark, sf):
    return D.appearance_ids(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "new_id")


@query("resume_antijoin", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return D.pending(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("modulo_parts", "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) % 5 AS part FROM part")
def _(spark, sf):
    return D.modulo_parts(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], 5)


@query("record_ids", "SELECT item_id, 'expr_' || lpad(CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR), 5, '0') AS record_id FROM benchmark")
def _(spark, sf):
    return D.record_ids(table(spark, sf, "benchmark").select("item_id"), ["item_id"])


@query("region_union_except", "SELECT n_name AS name FROM nation WHERE n_regionkey IN (0, 1, 2) EXCEPT SELECT n_name FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    return nation.filter("n_regionkey in (0, 1, 2)").select(F.col("n_name").alias("name")).exceptAll(nation.filter("n_nationkey % 2 = 0").select("n_name"))


def _labels(spark, sf):
    return boxes_gt(spark, sf).select(F.concat(F.lit("img_"), "image_id").alias("file_name"), F.col("row_id").alias("pos"), "type", "bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax", "img_width", "img_height")


_COCO = f"""WITH {GT}, l AS (SELECT 'img_' || image_id AS file_name, row_id AS pos, * FROM boxes_gt),
    i AS (SELECT file_name, row_number() OVER (ORDER BY file_name) AS image_id FROM (SELECT DISTINCT file_name FROM l)),
    o AS (SELECT file_name, type, bbox_xmin, bbox_ymin, bbox_xmax, bbox_ymax, min(pos) AS pos FROM l GROUP BY ALL),
    c AS (SELECT type, row_number() OVER (ORDER BY type) AS category_id FROM (SELECT DISTINCT type FROM l)),
    b AS (SELECT image_id, pos, category_id, type, file_name, least(greatest(bbox_xmin, 0), 640) AS x, least(greatest(bbox_ymin, 0), 480) AS y, least(greatest(bbox_xmax, 0), 640) AS x2, least(greatest(bbox_ymax, 0), 480) AS y2 FROM o JOIN i USING (file_name) JOIN c USING (type)),
    a AS (SELECT row_number() OVER (ORDER BY image_id, pos) AS ann_id, * FROM b WHERE x2 > x AND y2 > y) """


@query("labels_to_coco", _COCO + "SELECT ann_id, image_id, category_id, x, y, x2 - x AS w, y2 - y AS h, (x2 - x) * (y2 - y) AS area, 0 AS iscrowd FROM a")
def _(spark, sf):
    return A.labels_to_coco(_labels(spark, sf))[1]


@query("coco_to_labels", _COCO + "SELECT file_name, ann_id, format('{} 0.00 0 0.00 {:.2f} {:.2f} {:.2f} {:.2f} 0.00 0.00 0.00 0.00 0.00 0.00 0.00', type, x, y, x2, y2) AS line FROM a")
def _(spark, sf):
    return A.coco_to_labels(*A.labels_to_coco(_labels(spark, sf)))


@query("coco_odvg_coco", _COCO + "SELECT ann_id - 1 AS ann_id, image_id, category_id, round(x, 2) AS x, round(y, 2) AS y, round(x2 - x, 2) AS w, round(y2 - y, 2) AS h FROM (SELECT row_number() OVER (ORDER BY image_id, ann_id) AS ann_id, * EXCLUDE (ann_id) FROM a)")
def _(spark, sf):
    return A.odvg_to_coco(A.coco_to_odvg(*A.labels_to_coco(_labels(spark, sf))))


@query("conversation_to_dialog", "SELECT conv_id, turn AS turn, role AS who, text AS value FROM conversations")
def _(spark, sf):
    rows = A.dialog_rows(table(spark, sf, "conversations")).select("conv_id", F.explode("conversations").alias("c"))
    return rows.select("conv_id", F.col("c.turn").alias("turn"), F.col("c.from").alias("who"), F.col("c.value").alias("value"))


@query("qa_to_dialog", "SELECT item_id AS id, 'v' || item_id || '.mp4' AS video, text AS asked, 'A' || item_id AS answered FROM benchmark")
def _(spark, sf):
    qa = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("v"), "item_id", F.lit(".mp4")).alias("video_path"), F.col("text").alias("question"), F.concat(F.lit("A"), "item_id").alias("answer"))
    return A.qa_to_dialog(qa).select("id", "video", F.col("conversations")[0]["value"].alias("asked"), F.col("conversations")[1]["value"].alias("answered"))


@query("class_map", "SELECT row_id, CASE type WHEN 'A' THEN 'accepted' ELSE 'returned' END AS type FROM boxes_gt WHERE type IN ('A', 'R')".join([f"WITH {GT} ", ""]))
def _(spark, sf):
    mapping = spark.createDataFrame([("A", "accepted"), ("R", "returned")], "raw string, canonical string")
    return A.apply_class_map(boxes_gt(spark, sf).select("row_id", "type"), mapping)


@query(
    "path_lookup",
    """WITH t AS (SELECT url, page_id FROM pages), k AS (SELECT page_id AS q, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'x/' || regexp_extract(url, '[^/]*$') ELSE 'y/' || regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') || '.txt' END AS url FROM pages),
    full_ AS (SELECT url AS k0, min(page_id) AS v0 FROM t GROUP BY url HAVING count(*) = 1), base AS (SELECT regexp_extract(url, '[^/]*$') AS k1, min(page_id) AS v1 FROM t GROUP BY 1 HAVING count(*) = 1),
    stem AS (SELECT regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS k2, min(page_id) AS v2 FROM t GROUP BY 1 HAVING count(*) = 1)
    SELECT q, coalesce(v0, v1, v2) AS page_id FROM k LEFT JOIN full_ ON k.url = k0 LEFT JOIN base ON regexp_extract(k.url, '[^/]*$') = k1 LEFT JOIN stem ON regexp_replace(regexp_extract(k.url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') = k2""",
)
def _(spark, sf):
    pages = table(spark, sf, "pages").select("url", "page_id")
    base = F.regexp_extract("url", r"[^/]*$", 0)
    asked = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("x/"), base)).otherwise(F.concat(F.lit("y/"), F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.lit(".txt")))
    return A.lookup(pages.select(F.col("page_id").alias("q"), asked.alias("url")), pages, "url", "page_id").select("q", "page_id")


def _attribute_pairs(spark, sf):
    part = table(spark, sf, "part")
    attributes = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    names = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("size"), F.lit("brand"))).otherwise(F.array(F.lit("brand"), F.lit("type")))
    queries = part.select(F.col("p_partkey").alias("query_id"), names.alias("names"), attributes.alias("attributes"), F.col("p_name").alias("text"))
    return P.attribute_pairs(queries, part.select(F.col("p_partkey").alias("image_id"), attributes.alias("attributes")))


@query("attribute_match_pairs", "SELECT q.p_partkey AS query_id, i.p_partkey AS image_id FROM part q JOIN part i ON q.p_brand = i.p_brand AND CASE WHEN q.p_partkey % 2 = 0 THEN q.p_size = i.p_size ELSE q.p_type = i.p_type END")
def _(spark, sf):
    return _attribute_pairs(spark, sf)


@query("pair_dedup_first", "SELECT min(doc_id) AS pair_id FROM documents GROUP BY lang, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g')")
def _(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"), F.lit("train").alias("split"), F.concat("lang", "source").alias("image_path"), F.col("text").alias("caption"), F.lit("d").alias("dataset"), F.lit("easy").alias("query_type"))
    return P.finish(rows).select("pair_id")


@query("text_constraint_vector", "SELECT p_partkey, i - 1 AS pos, CASE WHEN i > CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END OR v[i] = 0 THEN -1 ELSE v[i] END AS x FROM (SELECT p_partkey, p_size, [p_partkey % 3, p_partkey % 5, p_partkey % 7, p_partkey % 11] AS v FROM part), generate_series(1, 4) g(i)")
def _(spark, sf):
    key = F.col("p_partkey")
    vector = F.array(*[key % n for n in (3, 5, 7, 11)])
    none = F.array(*[F.array(F.lit(0).cast("bigint")) for _ in range(4)])
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(P.text_constraints(vector, F.col("p_size") % 3 + 2, none)).alias("pos", "x"))
    return rows.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "x")


@query(
    "velocity_lag",
    """SELECT event_id, round(CASE WHEN f - lag(f) OVER w = 1 THEN (value - lag(value) OVER w) * 30.0::DOUBLE ELSE 0 END, 6) AS v_value FROM (
    SELECT event_id, user_id, value, n + n // 10 AS f FROM (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))
    WINDOW w AS (PARTITION BY user_id ORDER BY f)""",
)
def _(spark, sf):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").select("event_id", "user_id", "value", (n + F.floor(n / 10)).alias("frame"))
    return S.velocity(rows, ["user_id"], "frame", ["value"], 30.0).select("event_id", F.round("v_value", 6).alias("v_value"))


@query("track_counts", "SELECT event_type, count(DISTINCT user_id) AS tracks FROM events GROUP BY event_type")
def _(spark, sf):
    return S.track_counts(table(spark, sf, "events"), "event_type", "user_id")[0]


@query("visibility_ratio", "SELECT event_id, CASE WHEN value > 50 AND user_id % 9 > 0 THEN (value - 50) / (user_id % 9 * 100.0::DOUBLE) ELSE 0 END AS ratio FROM events")
def _(spark, sf):
    full = F.create_map(F.lit("cam"), F.array(F.lit(0.0), F.lit(0.0), (F.col("user_id") % 9).cast("double"), F.lit(100.0)))
    seen = F.when(F.col("value") > 50, F.create_map(F.lit("cam"), F.array(F.lit(0.0), F.lit(0.0), F.col("value") - 50, F.lit(1.0)))).otherwise(F.create_map().cast("map<string, array<double>>"))
    return table(spark, sf, "events").select("event_id", F.coalesce(S.visibility(full, seen)["cam"], F.lit(0.0)).alias("ratio"))


@query("kmeans_anchors")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], *[(1 + F.abs(F.col("embedding")[i + 3].cast("double"))).alias(c) for i, c in enumerate("whl")])
    return S.anchors(rows, 8, list("xyz"), list("whl"))


_CHUNKS = "WITH d AS (SELECT doc_id, n_chars / 20.0::DOUBLE AS len FROM documents), s AS (SELECT doc_id, len, CASE WHEN len / 5 <= 10 THEN 5 WHEN len / 10 <= 10 THEN 10 WHEN len / 15 <= 10 THEN 15 WHEN len / 20 <= 10 THEN 20 ELSE 30 END AS size FROM d) "


def _lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 20.0).alias("len"))


@query("chunk_duration", _CHUNKS + "SELECT doc_id, CAST(size AS INTEGER) AS size FROM s")
def _(spark, sf):
    return _lengths(spark, sf).select("doc_id", video.chunk_seconds(F.col("len")).alias("size"))


@query("chunk_windows", _CHUNKS + 'SELECT doc_id, CAST(i AS INTEGER) AS "index", CAST(i * size AS DOUBLE) AS "start", CAST(least(len, (i + 1) * size) AS DOUBLE) AS "end" FROM s, generate_series(0, 100000) g(i) WHERE i * size + 1 <= len')
def _(spark, sf):
    rows = _lengths(spark, sf).withColumn("size", video.chunk_seconds(F.col("len")))
    return rows.select("doc_id", F.explode(video.chunks(F.col("len"), F.col("size"))).alias("c")).select("doc_id", "c.*")


@query("frame_samples", "WITH d AS (SELECT doc_id, n_chars / 20.0::DOUBLE AS len FROM documents), n AS (SELECT *, greatest(1, least(CAST(floor(len * 0.5) AS BIGINT), 60)) AS n FROM d) SELECT doc_id, i - 1 AS pos, round(i * len / (n + 1), 6) AS t FROM n, generate_series(1, 60) g(i) WHERE i <= n")
def _(spark, sf):
    rows = _lengths(spark, sf).select("doc_id", F.posexplode(video.frame_times(F.col("len"))).alias("pos", "t"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("t", 6).alias("t"))


@query("highlight_window", """WITH d AS (SELECT doc_id, n_chars / 20.0::DOUBLE AS len, doc_id % 90 * 1.0::DOUBLE AS t0 FROM documents), w AS (SELECT *, greatest(0, t0 - 3) AS s, least(len, t0 + 3) AS e FROM d)
    SELECT doc_id, round(CASE WHEN e - s < 2 THEN greatest(0, e - 2) ELSE s END, 6) AS "start", round(e, 6) AS "end" FROM w""")
def _(spark, sf):
    start, end = video.highlight((F.col("doc_id") % 90).cast("double"), F.col("len"))
    return _lengths(spark, sf).select("doc_id", F.round(start, 6).alias("start"), F.round(end, 6).alias("end"))


@query("tumbling_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS cnt, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    got = table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("cnt"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "cnt", "total")
