"""Tables that queries read: the driver's Parquet tables, and boxes derived from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_X = "cast(floor(l_extendedprice) as bigint) % 640 - 20"
_Y = "l_partkey % 480 - 10"
_COLUMNS = {
    "image_id": "l_orderkey % 500",
    "type": "l_returnflag",
    "row_id": "concat_ws('-', cast(l_orderkey as {text}), cast(l_partkey as {text}), cast(l_suppkey as {text}), cast(l_linenumber as {text}))",
    "bbox_xmin": f"cast({_X} as double)",
    "bbox_ymin": f"cast({_Y} as double)",
    "bbox_xmax": f"cast({_X} + cast(floor(l_quantity) as bigint) * 4 - 8 as double)",
    "bbox_ymax": f"cast({_Y} + (l_suppkey % 50) * 6 as double)",
    "img_width": "cast(640 as bigint)",
    "img_height": "cast(480 as bigint)",
    "occluded": "cast(l_linenumber - 1 as bigint)",
    "truncated": "cast((l_discount + 0.0) * 10 as double)",
}


def boxes_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each line item; negative, empty, inverted and outlying ones among them."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e.format(text='string')} as {n}" for n, e in _COLUMNS.items()])


def boxes_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: the open line items' boxes, moved by some pixels, with scores that often tie."""
    shift = "(l_linenumber % 3) * 2"
    exprs = {n: e.format(text="string") for n, e in _COLUMNS.items() if n in ("image_id", "type", "row_id")}
    exprs |= {n: f"{_COLUMNS[n]} + {shift}" for n in ("bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax")} | {"score": "round(l_tax * 10, 2)"}
    return table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").selectExpr(*[f"{e} as {n}" for n, e in exprs.items()])


GT = "boxes_gt AS (SELECT " + ", ".join(f"{e.format(text='varchar')} AS {n}" for n, e in _COLUMNS.items()) + " FROM lineitem)"
PRED = (
    "boxes_pred AS (SELECT "
    + ", ".join(f"{_COLUMNS[n].format(text='varchar')} AS {n}" for n in ("image_id", "type", "row_id"))
    + ", "
    + ", ".join(f"{_COLUMNS[n]} + (l_linenumber % 3) * 2 AS {n}" for n in ("bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax"))
    + ", round(l_tax * 10, 2) AS score FROM lineitem WHERE l_linestatus = 'O')"
)
#: The validation of boxes, over boxes_gt.
FLAGS = """flags AS (SELECT *, bbox_xmin < 0 OR bbox_ymin < 0 OR bbox_xmax < 0 OR bbox_ymax < 0 OR bbox_xmin > img_width OR bbox_xmax > img_width
    OR bbox_ymin > img_height OR bbox_ymax > img_height AS oob, bbox_xmin = bbox_xmax OR bbox_ymin = bbox_ymax AS zero,
    bbox_xmax < bbox_xmin OR bbox_ymax < bbox_ymin AS inv, (bbox_xmax - bbox_xmin) * (bbox_ymax - bbox_ymin) AS bbox_area FROM boxes_gt)"""
STATUS = """st AS (SELECT *, CASE WHEN oob OR zero OR inv THEN 'INVALID' WHEN truncated NOT BETWEEN 0 AND 1 OR occluded NOT IN (0, 1, 2, 3) THEN 'GOOD_TO_CORRECT'
    ELSE 'VALID' END AS status, bbox_xmin > 0 AND bbox_ymin > 0 AND bbox_xmax > 0 AND bbox_ymax > 0 AND (bbox_xmax < bbox_xmin OR bbox_ymax < bbox_ymin) AS invpos FROM flags)"""
BOXES = f"WITH {GT}, {FLAGS}, {STATUS} "
