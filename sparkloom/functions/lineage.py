"""Cutting lineage where a result must not be computed again, on a cluster whose executors may be lost."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder (spark.checkpoint.dir; a temporary one only where unset)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path; an error on a cluster that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-"))
    return sc.getCheckpointDir()


def small(df: DataFrame, limit: int = 20_000) -> DataFrame:
    """df, marked for broadcast if it is counted at limit rows or fewer; else as it is, for Spark to choose a join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
