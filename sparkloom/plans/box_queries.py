"""Queries of box validation, correction and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import boxes
from sparkloom.operators import box_quality as Q
from sparkloom.operators import detection as D

from .registry import query
from .tables import BOXES, GT, PRED, boxes_gt, boxes_pred, table


def _status(spark, sf):
    return Q.classify(boxes_gt(spark, sf))


@query("box_validation_flags", BOXES + "SELECT row_id, oob AS out_of_box_coordinates, zero AS zero_area_bounding_box, inv AS inverted_coordinates, bbox_area, status FROM st")
def _(spark, sf):
    return _status(spark, sf).select("row_id", "out_of_box_coordinates", "zero_area_bounding_box", "inverted_coordinates", "bbox_area", "status")


@query(
    "box_validation_summary",
    BOXES
    + """SELECT total, invalid, oob, inverted, round(100.0::DOUBLE * invalid / total, 4) AS invalid_pct, round(100.0::DOUBLE * oob / total, 4) AS oob_pct,
    round(100.0::DOUBLE * inverted / total, 4) AS inverted_pct, round(100.0::DOUBLE * invalid / total, 4) > 5 AS warns
    FROM (SELECT count(*) AS total, count(*) FILTER (status = 'INVALID') AS invalid, count(*) FILTER (oob) AS oob, count(*) FILTER (invpos) AS inverted FROM st)""",
)
def _(spark, sf):
    return Q.summary(_status(spark, sf))


@query("coordinate_status", BOXES + "SELECT count(*) FILTER (status <> 'INVALID') AS valid, count(*) FILTER (invpos) AS inverted, count(*) FILTER (oob) AS out_of_bound FROM st")
def _(spark, sf):
    return Q.coordinate_status(_status(spark, sf))


_FIXED = "SELECT row_id, least(a, c) AS bbox_xmin, least(b, d) AS bbox_ymin, greatest(a, c) AS bbox_xmax, greatest(b, d) AS bbox_ymax FROM ("


@query(
    "box_correction_label",
    BOXES + _FIXED + "SELECT row_id, greatest(bbox_xmin, 0) AS a, greatest(bbox_ymin, 0) AS b, greatest(least(bbox_xmax, img_width), 0) AS c, greatest(least(bbox_ymax, img_height), 0) AS d FROM st)",
)
def _(spark, sf):
    return Q.correct_labels(boxes_gt(spark, sf)).select("row_id", *Q.COORDS)


@query(
    "box_correction_xywh",
    BOXES
    + """SELECT row_id, x, y, least(x2, 640) - x AS w, least(y2, 480) - y AS h FROM (
    SELECT row_id, least(a, c) AS x, least(b, d) AS y, greatest(a, c) AS x2, greatest(b, d) AS y2 FROM (
    SELECT row_id, greatest(bbox_xmin, 0) AS a, greatest(bbox_ymin, 0) AS b, greatest(bbox_xmax, 0) AS c, greatest(bbox_ymax, 0) AS d FROM st))""",
)
def _(spark, sf):
    return Q.correct_xywh(boxes_gt(spark, sf)).select("row_id", "x", "y", "w", "h")


def _pct(by: str, digits: int) -> str:
    return BOXES + f"SELECT {by}, count(*) AS cnt, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), {digits}) AS pct FROM st GROUP BY {by}"


@query("class_counts_pct", _pct("type", 2))
def _(spark, sf):
    return Q.counts(_status(spark, sf), ["type"], 2)


@query(
    "class_counts_describe",
    BOXES + """SELECT count(*) AS cnt, round(avg(c), 4) AS mean, round(stddev_samp(c), 4) AS std, round(min(c)::DOUBLE, 4) AS min, round(quantile_cont(c, 0.25), 4) AS p25,
    round(quantile_cont(c, 0.5), 4) AS p50, round(quantile_cont(c, 0.75), 4) AS p75, round(max(c)::DOUBLE, 4) AS max FROM (SELECT count(*)::DOUBLE AS c FROM st GROUP BY type)""",
)
def _(spark, sf):
    return Q.describe(Q.counts(_status(spark, sf), ["type"]), "cnt")


@query("class_balance", _pct("type", 4))
def _(spark, sf):
    return Q.counts(_status(spark, sf), ["type"], 4)


@query("occlusion_hist", BOXES + """SELECT occluded, CASE occluded WHEN 0 THEN 'Fully visible' WHEN 1 THEN 'Partly occluded' WHEN 2 THEN 'Largely occluded' WHEN 3 THEN 'Unknown'
    ELSE 'Unknown occlusion value' END AS level, count(*) AS cnt, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 3) AS pct FROM st GROUP BY occluded""")
def _(spark, sf):
    return Q.counts(_status(spark, sf), ["occluded"], 3).withColumn("level", Q.occlusion_text(F.col("occluded")))


@query("class_occlusion", BOXES + "SELECT type, occluded, count(*) AS cnt, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM st GROUP BY type, occluded")
def _(spark, sf):
    return Q.class_occlusion(_status(spark, sf))


@query(
    "truncation_hist",
    BOXES + "SELECT level, count(*) AS cnt, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 3) AS pct FROM (SELECT CAST(round(truncated, 1) * 100 AS BIGINT) AS level FROM st) GROUP BY level",
)
def _(spark, sf):
    return Q.truncation(_status(spark, sf))


_DESCRIBE = """count(*) AS cnt, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS p25,
    round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max"""


@query("area_describe_by_class", BOXES + f"SELECT type, {_DESCRIBE} FROM (SELECT type, bbox_area AS v FROM st WHERE status <> 'INVALID') GROUP BY type")
def _(spark, sf):
    return Q.describe(Q.valid(_status(spark, sf)), "bbox_area", ["type"])


@query("area_describe", BOXES + f"SELECT {_DESCRIBE} FROM (SELECT bbox_area AS v FROM st WHERE status <> 'INVALID')")
def _(spark, sf):
    return Q.describe(Q.valid(_status(spark, sf)), "bbox_area")


@query("valid_vs_invalid_outer", BOXES + "SELECT type, count(*) FILTER (status <> 'INVALID') AS valid, count(*) FILTER (status = 'INVALID') AS invalid FROM st GROUP BY type")
def _(spark, sf):
    return Q.valid_invalid(_status(spark, sf))


@query("inverted_top100", BOXES + "SELECT type, count(*) AS cnt FROM st WHERE invpos GROUP BY type ORDER BY cnt, type LIMIT 100")
def _(spark, sf):
    return Q.top_classes(_status(spark, sf), Q.inverted_positive())


@query("oob_top100", BOXES + "SELECT type, count(*) AS cnt FROM st WHERE oob GROUP BY type ORDER BY cnt, type LIMIT 100")
def _(spark, sf):
    return Q.top_classes(_status(spark, sf), F.col("out_of_box_coordinates"))


_SIZES = "(SELECT p_size * 10 AS width, p_size % 7 * 100 AS height FROM part)"


@query(
    "image_size_dist",
    f"""SELECT kind, value, cnt, round(100.0::DOUBLE * cnt / sum(cnt) OVER (PARTITION BY kind), 3) AS pct FROM (
    SELECT kind, value, count(*) AS cnt FROM (SELECT 'width' AS kind, CAST(width AS VARCHAR) AS value FROM {_SIZES} UNION ALL SELECT 'height', CAST(height AS VARCHAR) FROM {_SIZES}
    UNION ALL SELECT 'size', concat_ws('x', width, height) FROM {_SIZES}) GROUP BY kind, value)""",
)
def _(spark, sf):
    return Q.image_sizes(table(spark, sf, "part").select((F.col("p_size") * 10).alias("width"), (F.col("p_size") % 7 * 100).alias("height")))


@query("image_describe", f"SELECT {_DESCRIBE} FROM (SELECT CAST(p_size * 10 AS DOUBLE) AS v FROM part)")
def _(spark, sf):
    return Q.describe(table(spark, sf, "part").select((F.col("p_size") * 10).alias("width")), "width")


@query(
    "box_transforms",
    f"""WITH {GT}, c AS (SELECT row_id, least(greatest(bbox_xmin, 0), 640) AS x1, least(greatest(bbox_ymin, 0), 480) AS y1, least(greatest(bbox_xmax, 0), 640) AS x2,
    least(greatest(bbox_ymax, 0), 480) AS y2, bbox_xmin AS a, bbox_ymin AS b, bbox_xmax AS c, bbox_ymax AS d FROM boxes_gt)
    SELECT row_id, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 END AS clip_x1, CASE WHEN x2 > x1 AND y2 > y1 THEN y2 END AS clip_y2,
    CAST(greatest(trunc(a), 0) AS INTEGER) AS clamp_x1, CAST(least(trunc(d), 480) AS INTEGER) AS clamp_y2, c - a AS w, d - b AS h,
    CAST(least(greatest(trunc(a * 640 / 1000), 0), 640) AS INTEGER) AS scale_x1,
    '[' || concat_ws(', ', CAST(trunc(a * 1000 / 640) AS INTEGER), CAST(trunc(b * 1000 / 480) AS INTEGER), CAST(trunc(c * 1000 / 640) AS INTEGER), CAST(trunc(d * 1000 / 480) AS INTEGER)) || ']' AS thousandths
    FROM c""",
)
def _(spark, sf):
    b, w, h = boxes.box(), F.col("img_width"), F.col("img_height")
    clip, clamp, xywh, scale = boxes.clip_or_null(b, w, h), boxes.clamp_int(b, w, h), boxes.xyxy_to_xywh(b), boxes.scale_thousand(b, w, h)
    return boxes_gt(spark, sf).select(
        "row_id", clip[0].alias("clip_x1"), clip[3].alias("clip_y2"), clamp[0].alias("clamp_x1"), clamp[3].alias("clamp_y2"), xywh[2].alias("w"), xywh[3].alias("h"),
        scale[0].alias("scale_x1"), boxes.thousandths_text(b, w, h).alias("thousandths"),
    )


_M = boxes.affine((640, 480), 30, (True, False), (0.1, 0.0), (5, -7), (320, 240))


def _corner(i: int) -> str:
    return ", ".join(f"bbox_{x} * ({_M[i][0]!r}::DOUBLE) + bbox_{y} * ({_M[i][1]!r}::DOUBLE) + ({_M[i][2]!r}::DOUBLE)" for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")))


@query(
    "affine_boxes",
    f"""WITH {GT} SELECT row_id, round(least(greatest(least({_corner(0)}), 0), 320), 4) AS x1, round(least(greatest(least({_corner(1)}), 0), 240), 4) AS y1,
    round(least(greatest(greatest({_corner(0)}), 0), 320), 4) AS x2, round(least(greatest(greatest({_corner(1)}), 0), 240), 4) AS y2 FROM boxes_gt""",
)
def _(spark, sf):
    new = boxes.transform(boxes.box(), _M, 320, 240)
    return boxes_gt(spark, sf).select("row_id", *[F.round(c, 4).alias(n) for c, n in zip(new, ("x1", "y1", "x2", "y2"))])


_IOU = """CASE WHEN u <> 0 THEN i / u ELSE 0 END FROM (SELECT *, ap + ag - i AS u FROM (SELECT p.image_id, p.type, p.row_id AS pred_id, g.row_id AS gt_id,
    greatest(least(p.bbox_xmax, g.bbox_xmax) - greatest(p.bbox_xmin, g.bbox_xmin), 0) * greatest(least(p.bbox_ymax, g.bbox_ymax) - greatest(p.bbox_ymin, g.bbox_ymin), 0) AS i,
    (p.bbox_xmax - p.bbox_xmin) * (p.bbox_ymax - p.bbox_ymin) AS ap, (g.bbox_xmax - g.bbox_xmin) * (g.bbox_ymax - g.bbox_ymin) AS ag
    FROM boxes_pred p JOIN boxes_gt g USING (image_id, type)))"""


def _sides(spark, sf):
    """All boxes, as both sides of a match."""
    names = {"bbox_xmin": "x1", "bbox_ymin": "y1", "bbox_xmax": "x2", "bbox_ymax": "y2"}
    return [f(spark, sf).withColumnsRenamed(names).select("image_id", "type", "row_id", *names.values(), *more) for f, more in ((boxes_gt, []), (boxes_pred, ["score"]))]


@query("iou_pairs", f"WITH {GT}, {PRED} SELECT image_id, pred_id, gt_id, round(iou, 6) AS iou FROM (SELECT image_id, pred_id, gt_id, {_IOU.replace('END FROM', 'END AS iou FROM', 1)}) WHERE iou >= 0.5")
def _(spark, sf):
    g, p = boxes_gt(spark, sf), boxes_pred(spark, sf)
    g, p = (df.select("image_id", "type", F.col("row_id").alias(f"{n}_id"), *[F.col(c).alias(f"{n}_{c}") for c in Q.COORDS]) for df, n in ((g, "gt"), (p, "pred")))
    return D.overlapping(p, g, ["image_id", "type"], "pred_bbox_", "gt_bbox_", 0.5, digits=6).select("image_id", "pred_id", "gt_id", "iou")


def _iou_sql(p: str, g: str) -> str:
    own = lambda v: f"({v}.x2 - {v}.x1) * ({v}.y2 - {v}.y1)"
    i = f"greatest(least({p}.x2, {g}.x2) - greatest({p}.x1, {g}.x1), 0) * greatest(least({p}.y2, {g}.y2) - greatest({p}.y1, {g}.y1), 0)"
    return f"coalesce({i} / nullif({own(p)} + {own(g)} - {i}, 0), 0)"


_BOX = "x1 := bbox_xmin, y1 := bbox_ymin, x2 := bbox_xmax, y2 := bbox_ymax"


def _match_sql(conf: float) -> str:
    """Greedy matching, a step of the recursion for each prediction of an image and class; ends in a table `pairs`."""
    return f"""WITH RECURSIVE {GT}, {PRED},
    gl AS (SELECT image_id, type, list(struct_pack(id := row_id, {_BOX}) ORDER BY row_id) AS gs FROM boxes_gt GROUP BY ALL),
    pl AS (SELECT image_id, type, list(struct_pack(id := row_id, s := score, {_BOX}) ORDER BY score DESC, row_id) AS ps FROM boxes_pred
      WHERE score >= {conf} AND (bbox_xmax - bbox_xmin) * (bbox_ymax - bbox_ymin) >= 0 AND image_id IN (SELECT image_id FROM boxes_gt) GROUP BY ALL),
    bl AS (SELECT image_id, type, coalesce(gs, []) AS gs, coalesce(ps, []) AS ps FROM gl FULL JOIN pl USING (image_id, type)),
    run AS (SELECT image_id, type, 0 AS k, list_transform(gs, lambda x: true) AS free, 0 AS t FROM bl
      UNION ALL
      SELECT image_id, type, k, CASE WHEN t = 1 THEN list_transform(free, lambda f, i: f AND i <> spot) ELSE free END, t FROM (
        SELECT *, CASE WHEN len(gs) = 0 OR best < 0.5 THEN 0 WHEN (gs[spot].x2 - gs[spot].x1) * (gs[spot].y2 - gs[spot].y1) < 0 THEN -1 ELSE 1 END AS t FROM (
          SELECT *, list_max(ov) AS best, list_position(ov, list_max(ov)) AS spot FROM (
            SELECT *, list_transform(gs, lambda q, i: CASE WHEN free[i] THEN {_iou_sql("p", "q")} ELSE 0 END) AS ov FROM (
              SELECT r.image_id, r.type, r.k + 1 AS k, r.free, b.gs, b.ps[r.k + 1] AS p FROM run r JOIN bl b USING (image_id, type) WHERE r.k < len(b.ps)))))),
    pairs AS (SELECT image_id, type, t, CAST(ps[k].s AS DOUBLE) AS score, ps[k].id AS pos FROM run JOIN bl USING (image_id, type) WHERE k > 0 AND t >= 0
      UNION ALL SELECT image_id, type, 1, 0.0, g.id FROM (SELECT image_id, type, unnest(gs) AS g, unnest(free) AS f FROM run JOIN bl USING (image_id, type) WHERE k = len(ps)) WHERE f AND (g.x2 - g.x1) * (g.y2 - g.y1) >= 0
      UNION ALL SELECT image_id, type, NULL, NULL, NULL FROM (SELECT DISTINCT image_id FROM boxes_gt), (SELECT DISTINCT type FROM boxes_gt) WHERE (image_id, type) NOT IN (SELECT image_id, type FROM bl))"""


@query("detection_match", _match_sql(0.0) + " SELECT image_id, type, t, score, pos FROM pairs")
def _(spark, sf):
    return D.match(*_sides(spark, sf))


@query(
    "detection_kpi",
    _match_sql(0.1)
    + """, run2 AS (SELECT type, row_number() OVER w AS n, sum(CASE WHEN t = 1 AND score >= 0.1 THEN 1 ELSE 0 END) OVER w AS tp, sum(CASE WHEN t = 0 AND score >= 0.1 THEN 1 ELSE 0 END) OVER w AS fp, sum(t) OVER (PARTITION BY type) AS npos
      FROM pairs WHERE t IS NOT NULL WINDOW w AS (PARTITION BY type ORDER BY score DESC, image_id, pos ROWS UNBOUNDED PRECEDING)),
    curve AS (SELECT type, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p, CASE WHEN npos > 0 THEN CAST(tp AS DOUBLE) / CAST(npos AS DOUBLE) ELSE 0 END AS r FROM run2),
    ap AS (SELECT type, sum(best) / 11 AS ap FROM (SELECT type, i, coalesce(max(CASE WHEN p >= i / 10.0::DOUBLE THEN r END), 0) AS best FROM curve, generate_series(0, 10) s(i) GROUP BY type, i) GROUP BY type),
    c AS (SELECT type, count(*) FILTER (t = 1 AND score >= 0.1) AS tp, count(*) FILTER (t = 0 AND score >= 0.1) AS fp, count(*) FILTER (t = 1 AND score < 0.1) AS fn, count(*) FILTER (t IS NULL) AS tn FROM pairs GROUP BY type)
    SELECT type, tp, fp, fn, tn, round(tp / (tp + fp + 1e-7), 6) AS pr, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn + 1e-7) ELSE 0 END, 6) AS re, round((tp + tn) / (tp + fp + tn + fn + 1e-7), 6) AS acc, round(coalesce(ap, 0), 6) AS ap FROM c LEFT JOIN ap USING (type)""",
)
def _(spark, sf):
    return D.evaluate(*_sides(spark, sf), conf=0.1).withColumns({c: F.round(c, 6) for c in ("pr", "re", "acc", "ap")})


@query(
    "nms_by_class",
    f"""WITH RECURSIVE {PRED}, pl AS (SELECT image_id, type, list(struct_pack(id := row_id, s := score, {_BOX}) ORDER BY score DESC, row_id) AS ps FROM boxes_pred GROUP BY ALL),
    run AS (SELECT image_id, type, 1 AS k, [ps[1]] AS kept FROM pl
      UNION ALL
      SELECT image_id, type, k, CASE WHEN list_bool_or(list_transform(kept, lambda q: {_iou_sql("p", "q")} > 0.5)) THEN kept ELSE list_append(kept, p) END FROM (
        SELECT r.image_id, r.type, r.k + 1 AS k, r.kept, b.ps[r.k + 1] AS p FROM run r JOIN pl b USING (image_id, type) WHERE r.k < len(b.ps)))
    SELECT image_id, type, x.id AS row_id, CAST(x.s AS DOUBLE) AS score FROM (SELECT image_id, type, unnest(kept) AS x FROM run JOIN pl USING (image_id, type) WHERE k = len(ps))""",
)
def _(spark, sf):
    return D.suppress(_sides(spark, sf)[1])


@query(
    "weak_images",
    _match_sql(0.0)
    + """, c AS (SELECT image_id, type, count(*) FILTER (t = 1 AND score >= 0.1) AS tp, count(*) FILTER (t = 0 AND score >= 0.1) AS fp, count(*) FILTER (t = 1 AND score < 0.1) AS fn FROM pairs WHERE t IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall FROM c)
    SELECT image_id, type, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM r WHERE recall < 0.3""",
)
def _(spark, sf):
    return D.weak_images(D.image_counts(*_sides(spark, sf), sure=0.1), recall=0.3).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


#: A curve from flags that both engines can make: every line item is a pair, true where its status is open.
_PAIRS = "pairs AS (SELECT l_returnflag AS type, l_orderkey % 500 AS image_id, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS t, round(l_tax * 10, 2) AS score, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS pos FROM lineitem)"


def _pairs(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag as type", "l_orderkey % 500 as image_id", "cast(l_linestatus = 'O' as int) as t", "round(l_tax * 10, 2) as score",
        "concat_ws('-', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string)) as pos",
    )
    return rows


_CURVE = f"""WITH {_PAIRS}, run AS (SELECT type, row_number() OVER w AS n, sum(CASE WHEN t = 1 AND score >= 0.1 THEN 1 ELSE 0 END) OVER w AS tp,
    sum(CASE WHEN t = 0 AND score >= 0.1 THEN 1 ELSE 0 END) OVER w AS fp, sum(t) OVER (PARTITION BY type) AS npos FROM pairs
    WINDOW w AS (PARTITION BY type ORDER BY score DESC, image_id, pos ROWS UNBOUNDED PRECEDING)),
    curve AS (SELECT type, CAST(n AS BIGINT) AS n, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p, CASE WHEN npos > 0 THEN CAST(tp AS DOUBLE) / CAST(npos AS DOUBLE) ELSE 0 END AS r FROM run) """


@query("pr_curve", _CURVE + "SELECT type, n, p AS precision, r AS recall FROM curve")
def _(spark, sf):
    return D.curve(_pairs(spark, sf), 0.1)


@query("ap_sample", _CURVE + "SELECT type, round(sum(best) / 11, 6) AS ap FROM (SELECT type, i, coalesce(max(CASE WHEN r >= i / 10.0::DOUBLE THEN p END), 0) AS best FROM curve, generate_series(0, 10) s(i) GROUP BY type, i) GROUP BY type")
def _(spark, sf):
    return D.average_precision(D.curve(_pairs(spark, sf), 0.1)).withColumn("ap", F.round("ap", 6))


@query(
    "ap_integrate",
    _CURVE + """, steps AS (SELECT type, r, max(p) AS p FROM curve GROUP BY type, r), env AS (SELECT type, r, max(p) OVER (PARTITION BY type ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS p,
    coalesce(lag(r) OVER (PARTITION BY type ORDER BY r), 0) AS b FROM steps) SELECT type, round(sum((r - b) * p), 6) AS ap FROM env GROUP BY type""",
)
def _(spark, sf):
    return D.average_precision(D.curve(_pairs(spark, sf), 0.1), "integrate").withColumn("ap", F.round("ap", 6))


@query("detection_metrics", f"WITH {_PAIRS}, c AS (SELECT type, count(*) FILTER (t = 1 AND score >= 0.1) AS tp, count(*) FILTER (t = 0 AND score >= 0.1) AS fp, count(*) FILTER (t = 1 AND score < 0.1) AS fn, CAST(0 AS BIGINT) AS tn FROM pairs GROUP BY type) SELECT type, tp, fp, fn, tn, round(tp / (tp + fp + 1e-7), 6) AS pr, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn + 1e-7) ELSE 0 END, 6) AS re, round((tp + tn) / (tp + fp + tn + fn + 1e-7), 6) AS acc FROM c")
def _(spark, sf):
    return D.metrics(_pairs(spark, sf), 0.1).withColumns({c: F.round(c, 6) for c in ("pr", "re", "acc")})
