"""Augmented datasets: boxes under random affine maps, new image sizes, shards of equal length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import boxes


def augment_boxes(df: DataFrame, matrix: list[list[float]], out_w: float, out_h: float) -> DataFrame:
    """Label rows with their boxes under a map, images of the new size; boxes that vanish go."""
    x1, y1, x2, y2 = boxes.transform(boxes.box(), matrix, out_w, out_h)
    new = df.withColumns({"bbox_xmin": x1, "bbox_ymin": y1, "bbox_xmax": x2, "bbox_ymax": y2, "img_width": F.lit(out_w), "img_height": F.lit(out_h)})
    return new.filter((F.col("bbox_xmax") > F.col("bbox_xmin")) & (F.col("bbox_ymax") > F.col("bbox_ymin")))


def random_flips(df: DataFrame, key: str, chance: float = 0.5, seed: int = 42) -> DataFrame:
    """Boxes of images mirrored at random by image, the same for a seed."""
    flip = boxes.pick([0.0, 1.0], F.col(key), seed) < chance
    x1, x2 = F.col("img_width") - F.col("bbox_xmax"), F.col("img_width") - F.col("bbox_xmin")
    return df.withColumns({"bbox_xmin": F.when(flip, x1).otherwise(F.col("bbox_xmin")), "bbox_xmax": F.when(flip, x2).otherwise(F.col("bbox_xmax"))})


def padded_shards(df: DataFrame, position: str, rows: int, batch: int, shards: int) -> DataFrame:
    """df (numbered from 0 by position, rows in number) dealt to shards of equal length; the last row fills up the rest.

    Without the fillers (dropped by key) the rows are those of df again.
    """
    step = batch * shards
    total = -(-rows // step) * step
    last = F.when(F.col(position) == rows - 1, F.sequence(F.lit(rows - 1), F.lit(total - 1))).otherwise(F.array(F.col(position).cast("int")))
    filled = df.withColumn("_slot", F.explode(last)) if rows else df.withColumn("_slot", F.lit(0))
    return filled.withColumn("shard", F.floor(F.col("_slot") / (total // shards if total else 1)).cast("bigint")).withColumnRenamed("_slot", "slot")
