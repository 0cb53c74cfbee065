"""Box validation, correction and distribution statistics over annotation tables.

Boxes are columns type, bbox_xmin, bbox_ymin, bbox_xmax, bbox_ymax, with img_width and img_height where known. All are
row-wise expressions or aggregations that combine on the map side; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions.boxes import area, box

COORDS = ("bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax")


def reasons(df: DataFrame) -> DataFrame:
    """df with out_of_box_coordinates, zero_area_bounding_box, inverted_coordinates (several may hold) and bbox_area.

    The image's bounds count only where both its dimensions are known and not zero.
    """
    x1, y1, x2, y2 = box()
    outside = (x1 < 0) | (y1 < 0) | (x2 < 0) | (y2 < 0)
    if {"img_width", "img_height"} <= set(df.columns):
        w, h = F.col("img_width"), F.col("img_height")
        known = F.coalesce((w != 0) & (h != 0), F.lit(False))
        outside = outside | (known & ((x1 > w) | (x2 > w) | (y1 > h) | (y2 > h)))
    return df.withColumns(
        {
            "out_of_box_coordinates": outside,
            "zero_area_bounding_box": (x2 == x1) | (y2 == y1),
            "inverted_coordinates": (x2 < x1) | (y2 < y1),
            "bbox_area": area(box()),
        }
    )


def classify(df: DataFrame) -> DataFrame:
    """reasons() with status: NOT_PARSED, INVALID, GOOD_TO_CORRECT or VALID. Box reasons come before correctable fields."""
    df = reasons(df)
    parsed = F.lit(True)
    for c in (*COORDS, "truncated", "occluded"):
        if c in df.columns:
            parsed = parsed & F.col(c).isNotNull()
    bad = F.col("out_of_box_coordinates") | F.col("zero_area_bounding_box") | F.col("inverted_coordinates")
    odd = F.lit(False)
    if "truncated" in df.columns:
        odd = odd | ~F.col("truncated").between(0, 1)
    if "occluded" in df.columns:
        odd = odd | ~F.col("occluded").isin(0, 1, 2, 3)
    return df.withColumn("status", F.when(~parsed, "NOT_PARSED").when(bad, "INVALID").when(odd, "GOOD_TO_CORRECT").otherwise("VALID"))


def valid(df: DataFrame) -> DataFrame:
    """Rows of classify() that pass; correctable ones as they are."""
    return df.filter(F.col("status").isin("VALID", "GOOD_TO_CORRECT"))


def correct_labels(df: DataFrame) -> DataFrame:
    """Far corners into the image (where known), negatives to 0, then inverted corners swapped."""
    x1, y1, x2, y2 = box()
    if {"img_width", "img_height"} <= set(df.columns):
        inside = lambda v, top: F.when((F.col("img_width") != 0) & (F.col("img_height") != 0) & (v > F.col(top)), F.col(top).cast("double")).otherwise(v)
        x2, y2 = inside(x2, "img_width"), inside(y2, "img_height")
    x1, y1, x2, y2 = (F.when(v < 0, F.lit(0.0)).otherwise(v) for v in (x1, y1, x2, y2))
    new = (F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))
    return df.withColumns(dict(zip(COORDS, new)))


def correct_xywh(df: DataFrame) -> DataFrame:
    """Negatives to 0, swap, then far corners alone into the image; x, y, width, height (which may then be negative)."""
    x1, y1, x2, y2 = (F.when(v < 0, F.lit(0.0)).otherwise(v) for v in box())
    x1, x2, y1, y2 = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    x2 = F.when(x2 > F.col("img_width"), F.col("img_width").cast("double")).otherwise(x2)
    y2 = F.when(y2 > F.col("img_height"), F.col("img_height").cast("double")).otherwise(y2)
    return df.withColumns({"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1})


def counts(df: DataFrame, by: list[str], digits: int | None = None, share: str = "pct", scale: float = 100.0) -> DataFrame:
    """Rows per value of `by`, with their share of all rows."""
    grouped = df.groupBy(*by).agg(F.count("*").alias("cnt"))
    part = F.col("cnt") * scale / F.sum("cnt").over(W.partitionBy())
    return grouped.withColumn(share, part if digits is None else F.round(part, digits))


def describe(df: DataFrame, column: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """count, mean, std (of a sample), min, p25, p50, p75, max (interpolated) of a column, by group or over all."""
    c = F.col(column).cast("double")
    q = lambda p: F.percentile(c, p)
    figures = {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "p25": q(0.25), "p50": q(0.5), "p75": q(0.75), "max": F.max(c)}
    return df.groupBy(*(by or [])).agg(F.count(c).alias("cnt"), *[F.round(v, digits).alias(k) for k, v in figures.items()])


def truncation(df: DataFrame) -> DataFrame:
    """Truncation in tenths: level in per cent, count, share."""
    return counts(df.filter("truncated is not null").select((F.round("truncated", 1) * 100).cast("bigint").alias("level")), ["level"], 3)


def class_occlusion(df: DataFrame) -> DataFrame:
    """Rows per class and occlusion among those with a truncation, with their share of all."""
    return counts(df.filter("truncated is not null"), ["type", "occluded"], 6, "share", 1.0)


def occlusion_text(c: Column) -> Column:
    """The names of occlusion levels."""
    return F.when(c == 0, "Fully visible").when(c == 1, "Partly occluded").when(c == 2, "Largely occluded").when(c == 3, "Unknown").otherwise("Unknown occlusion value")


def valid_invalid(df: DataFrame) -> DataFrame:
    """Valid and invalid rows of classify() per class; a class with none of one kind has 0."""
    good = valid(df).groupBy("type").agg(F.count("*").alias("valid"))
    bad = df.filter("status = 'INVALID'").groupBy("type").agg(F.count("*").alias("invalid"))
    return good.join(bad, "type", "full_outer").na.fill(0, ["valid", "invalid"])


def inverted_positive() -> Column:
    """Inverted with all four coordinates above 0: such a box can be mended by a swap."""
    x1, y1, x2, y2 = box()
    return (x1 > 0) & (y1 > 0) & (x2 > 0) & (y2 > 0) & ((x2 < x1) | (y2 < y1))


def coordinate_status(df: DataFrame) -> DataFrame:
    """One row: valid, inverted and out-of-bound rows. The last two may overlap and don't cover all invalid ones."""
    return df.agg(
        F.count_if(F.col("status").isin("VALID", "GOOD_TO_CORRECT")).alias("valid"),
        F.count_if(inverted_positive()).alias("inverted"),
        F.count_if("out_of_box_coordinates").alias("out_of_bound"),
    )


def summary(df: DataFrame, warn: float = 5.0) -> DataFrame:
    """One row: totals, per cent of invalid, out-of-bound and inverted rows (null without rows), and whether to warn."""
    pct = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.col("total")), 4)
    got = df.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "INVALID").alias("invalid"), F.count_if("out_of_box_coordinates").alias("oob"), F.count_if(inverted_positive()).alias("inverted"))
    return got.select("*", pct("invalid").alias("invalid_pct"), pct("oob").alias("oob_pct"), pct("inverted").alias("inverted_pct")).withColumn(
        "warns", F.coalesce(F.col("invalid_pct") > warn, F.lit(False))
    )


def top_classes(df: DataFrame, condition: Column, most: int | None = 100) -> DataFrame:
    """Classes by rows that meet the condition, ascending; the first hundred unless all are wanted."""
    got = df.filter(condition).groupBy("type").agg(F.count("*").alias("cnt")).orderBy("cnt", "type")
    return got if most is None else got.limit(most)


def image_sizes(images: DataFrame) -> DataFrame:
    """Counts and shares of image widths, heights and sizes, as (kind, value, cnt, pct)."""
    parts = [images.select(F.lit("width").alias("kind"), F.col("width").cast("string").alias("value")), images.select(F.lit("height").alias("kind"), F.col("height").cast("string").alias("value"))]
    parts.append(images.select(F.lit("size").alias("kind"), F.concat_ws("x", "width", "height").alias("value")))
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("kind", "value").agg(F.count("*").alias("cnt"))
    return every.withColumn("pct", F.round(100.0 * F.col("cnt") / F.sum("cnt").over(W.partitionBy("kind")), 3))


def analyze(df: DataFrame) -> dict[str, DataFrame]:
    """All tables of an analysis of boxes, by name, of one classified table; nothing is computed until one is read."""
    rows = classify(df)
    good = valid(rows)
    out = {
        "summary": summary(rows), "coordinates": coordinate_status(rows), "valid_invalid": valid_invalid(rows), "classes": counts(good, ["type"], 2),
        "class_describe": describe(counts(good, ["type"]), "cnt"), "area": describe(good, "bbox_area"), "area_by_class": describe(good, "bbox_area", ["type"]),
        "inverted": top_classes(rows, inverted_positive()), "out_of_bounds": top_classes(rows, F.col("out_of_box_coordinates")),
    }
    if "occluded" in df.columns:
        out |= {"occlusion": counts(good, ["occluded"], 3).withColumn("level", occlusion_text(F.col("occluded"))), "class_occlusion": class_occlusion(good)}
    if "truncated" in df.columns:
        out["truncation"] = truncation(good)
    return out
