"""Conversions among annotation formats, as tables: label lines, COCO, ODVG, LLaVA."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import boxes, text
from sparkloom.operators.datasets import numbered


def apply_class_map(df: DataFrame, mapping: DataFrame, column: str = "type") -> DataFrame:
    """Raw classes to canonical ones by (raw, canonical); classes without an entry go. The map is one row a class."""
    return df.join(mapping.select(F.col("raw").alias(column), "canonical"), column).drop(column).withColumnRenamed("canonical", column)


def labels_to_coco(labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Label rows (file_name, pos, type, bbox_*, img_width, img_height) to images, annotations and categories.

    Exact duplicate boxes of a file count once; boxes are clipped to the image, empty ones go; ids run from 1 in order of
    file and position, categories by name.
    """
    key = ["file_name", "type", "bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax"]
    once = labels.groupBy(*key).agg(F.min("pos").alias("pos"), F.first("img_width").alias("img_width"), F.first("img_height").alias("img_height"))
    images = numbered(labels.groupBy("file_name").agg(F.max("img_width").alias("width"), F.max("img_height").alias("height")), ["file_name"], "image_id")
    categories = numbered(labels.select("type").distinct(), ["type"], "category_id")
    x1, y1, x2, y2 = boxes.clip_or_null(boxes.box(), F.col("img_width"), F.col("img_height"))
    anns = once.select("file_name", "pos", "type", x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")).filter("x is not null")
    anns = anns.join(images.select("file_name", "image_id"), "file_name").join(categories, "type")
    anns = numbered(anns, ["image_id", "pos"], "ann_id").withColumn("area", F.col("w") * F.col("h")).withColumn("iscrowd", F.lit(0))
    return images, anns.select("ann_id", "image_id", "category_id", "x", "y", "w", "h", "area", "iscrowd"), categories


def coco_to_labels(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(file_name, ann_id, line) with the lines of label files."""
    rows = annotations.join(images.select("image_id", "file_name"), "image_id").join(categories, "category_id")
    b = boxes.xywh_to_xyxy(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return rows.select("file_name", "ann_id", text.label_line(F.col("type"), b).alias("line"))


def coco_to_odvg(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One detection record per image with annotations: boxes with two digits, labels from 0 by category."""
    names = numbered(categories.join(annotations.select("category_id").distinct(), "category_id", "left_semi"), ["category_id"], "label", 0)
    x1, y1, x2, y2 = boxes.xywh_to_xyxy(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 2)
    rows = annotations.join(names.select("category_id", "label", F.col("type").alias("category")), "category_id")
    one = F.struct("ann_id", F.array(x1, y1, x2, y2).alias("bbox"), F.col("label"), F.col("category"))
    grouped = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("instances"))
    return images.join(grouped, "image_id").select("image_id", "file_name", "height", "width", F.struct(F.transform("instances", lambda s: s.dropFields("ann_id")).alias("instances")).alias("detection"))


def coco_to_grounding(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One grounding record per image with annotations: its caption cleaned, and each box with the words it stands for.

    images: image_id, file_name, height, width, caption; annotations: ann_id, image_id, x, y, w, h, tokens_positive
    (array of [begin, end) places in the cleaned caption).
    """
    one = F.struct("ann_id", F.array(*boxes.xywh_to_xyxy(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 2)).alias("bbox"), F.col("tokens_positive").alias("spans"))
    grouped = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("_r"))
    caption = text.clean_span(F.col("caption"))
    regions = F.transform("_r", lambda r: F.struct(r["bbox"].alias("bbox"), text.joined_spans(caption, r["spans"]).alias("phrase")))
    return images.join(grouped, "image_id").select("image_id", "file_name", "height", "width", F.struct(caption.alias("caption"), regions.alias("regions")).alias("grounding"))


def boxes_from_masks(df: DataFrame, mask: str = "segmentation") -> DataFrame:
    """df with x, y, w, h as the extent of its polygons (arrays of x and y in turn); rows without a polygon keep their box."""
    flat = F.flatten(mask)
    part = lambda k: F.filter(flat, lambda v, i: i % 2 == k)
    x1, x2, y1, y2 = F.array_min(part(0)), F.array_max(part(0)), F.array_min(part(1)), F.array_max(part(1))
    known = F.coalesce(F.size(flat) >= 2, F.lit(False))
    new = {"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1}
    return df.withColumns({k: F.when(known, v).otherwise(F.col(k)) for k, v in new.items()})


def odvg_to_coco(records: DataFrame) -> DataFrame:
    """Annotations of detection records; boxes with x1 > x2 or y1 > y2 go; ids run from 0."""
    rows = records.select("image_id", F.posexplode("detection.instances").alias("pos", "i"))
    b = [F.get("i.bbox", k) for k in range(4)]
    rows = rows.filter((b[0] <= b[2]) & (b[1] <= b[3]))
    x, y, w, h = boxes.xyxy_to_xywh(tuple(b), 2)
    rows = rows.select("image_id", "pos", (F.col("i.label") + 1).alias("category_id"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    return numbered(rows, ["image_id", "pos"], "ann_id", 0).drop("pos")


def qa_to_dialog(qa: DataFrame) -> DataFrame:
    """(id, video, conversations) of question and answer rows (id, video_path, question, answer)."""
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    return qa.select("id", F.col("video_path").alias("video"), F.array(turn("human", "question"), turn("gpt", "answer")).alias("conversations"))


def dialog_rows(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as one row per conversation, its turns in order."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value")))).alias("conversations"))


def lookup(df: DataFrame, table: DataFrame, path: str, value: str) -> DataFrame:
    """df with `value` of table (path, value): by full path, else by file name where it is one file's, else by stem."""
    out = df
    for i, key in enumerate((lambda c: c, text.basename, text.stem)):
        keyed = table.select(key(F.col(path)).alias("_key"), F.col(value).alias("_value"))
        # A name that several files share points to none; full paths are taken to be unique.
        single = keyed.groupBy("_key").agg(F.min("_value").alias(f"_v{i}"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
        out = out.withColumn("_key", key(F.col(path))).join(single, "_key", "left").drop("_key")
    return out.withColumn(value, F.coalesce("_v0", "_v1", "_v2")).drop("_v0", "_v1", "_v2")
