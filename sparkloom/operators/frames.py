"""Objects in three-dimensional scenes: boxes, velocities, visibility, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def gt_box(location: Column, size: Column, rotation: Column, origin: Column | None = None) -> Column:
    """[x, y, z, three sizes, minus the rotation about z], from a group's origin if given."""
    at = location if origin is None else F.zip_with(location, origin, lambda a, b: a - b)
    return F.concat(at, size, F.array(-F.element_at(rotation, 3)))


def velocity(df: DataFrame, by: list[str], frame: str, position: list[str], fps: float) -> DataFrame:
    """df with v_<p> for every position column: change since the frame before times fps, 0 where that frame is missing."""
    w = W.partitionBy(*by).orderBy(frame)
    near = F.coalesce(F.col(frame) - F.lag(frame).over(w) == 1, F.lit(False))
    return df.withColumns({f"v_{p}": F.when(near, (F.col(p) - F.lag(p).over(w)) * fps).otherwise(0.0) for p in position})


def visibility(full: Column, seen: Column) -> Column:
    """Per camera, visible area over full area of [x1, y1, x2, y2] boxes; 0 where either is missing or empty."""
    area = lambda b: (F.get(b, 2) - F.get(b, 0)) * (F.get(b, 3) - F.get(b, 1))
    return F.map_zip_with(full, seen, lambda k, f, s: F.coalesce(F.try_divide(area(s), area(f)), F.lit(0.0)))


def seen_by_group(df: DataFrame, cameras: list[str], vis: str = "visibility") -> DataFrame:
    """Rows that a camera of the group sees; rows without any camera entry stay."""
    wanted = F.array(*[F.lit(c) for c in cameras])
    return df.filter((F.size(vis) == 0) | F.arrays_overlap(F.map_keys(F.map_filter(vis, lambda k, v: v > 0)), wanted))


def track_counts(df: DataFrame, cls: str, obj: str) -> tuple[DataFrame, DataFrame]:
    """Tracks per class, and per object the frames after its first."""
    return df.groupBy(cls).agg(F.count_distinct(obj).alias("tracks")), df.groupBy(obj).agg((F.count("*") - 1).alias("later_frames"))


def anchors(df: DataFrame, k: int, columns: list[str], dims: list[str], seed: int = 0) -> DataFrame:
    """Cluster centres of positions, with the logarithm of the members' mean sizes: min(k, distinct points) rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=columns, outputCol="_p").transform(df.na.drop(subset=columns))
    n = min(k, points.select(*columns).distinct().limit(k).count())
    if n < 2:
        return points.groupBy(F.lit(0).alias("anchor")).agg(*[F.avg(c).alias(c) for c in columns], *[F.log(F.avg(d)).alias(f"log_{d}") for d in dims])
    made = KMeans(k=n, seed=seed, featuresCol="_p", predictionCol="anchor").fit(points).transform(points)
    return made.groupBy("anchor").agg(*[F.avg(c).alias(c) for c in columns], *[F.log(F.avg(d)).alias(f"log_{d}") for d in dims])
