"""Gap analysis: threshold search, weakest samples per label, yes/no disagreements."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions.lineage import cut
from sparkloom.functions.text import label_key, yes_no
from sparkloom.operators.datasets import running

POSITIVE = "NO_PASS"


def threshold_table(scored: DataFrame) -> DataFrame:
    """(threshold, tp, fp, pos) for every distinct score: positives and others with a greater score, and all positives.

    scored: score, positive. One aggregation by score, and running sums over distinct scores in range partitions.
    """
    by = scored.groupBy("score").agg(F.sum(F.col("positive").cast("bigint")).alias("p"), F.sum((~F.col("positive")).cast("bigint")).alias("n"))
    by = cut(by)
    total = by.agg(F.sum("p")).first()[0]
    rows = running(by, [], [F.desc("score")], {"tp": (F.col("p"), "sum_before"), "fp": (F.col("n"), "sum_before")})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.select(F.col("score").alias("threshold"), zero("tp"), zero("fp"), F.lit(total).cast("bigint").alias("pos"))


def optimal_threshold(scored: DataFrame, min_recall: float = 1.0) -> DataFrame:
    """The threshold with the greatest (f1, precision, threshold) among those of enough recall; no row if there is none.

    A sample is predicted positive if its score is greater. A threshold just under the least score is a candidate too.
    """
    table = threshold_table(scored)
    low = scored.agg(F.min("score").alias("m"), F.sum(F.col("positive").cast("bigint")).alias("tp"), F.count_if(~F.col("positive")).alias("fp")).first()
    if low["m"] is not None:
        first = [(float(np.nextafter(low["m"], -np.inf)), low["tp"], low["fp"], low["tp"])]
        table = table.unionAll(scored.sparkSession.createDataFrame(first, table.schema))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    table = table.withColumn("precision", zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", zero(F.try_divide(F.col("tp"), F.col("pos"))))
    table = table.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    return table.filter(F.col("recall") >= min_recall - 1e-12).orderBy(F.desc("f1"), F.desc("precision"), F.desc("threshold")).limit(1)


def weakness(label: Column, score: Column, threshold: float) -> Column:
    """How far a score lies on the wrong side: above for PASS, below for all else."""
    return F.when(label_key(label) == "PASS", score - threshold).otherwise(F.lit(threshold) - score)


def with_weakness(df: DataFrame, threshold: float) -> DataFrame:
    """df with its labels trimmed and upper-cased, and weakness."""
    return df.withColumn("label", label_key(F.col("label"))).withColumn("weakness", weakness(F.col("label"), F.col("score"), threshold))


def weakest(df: DataFrame, threshold: float, k: int = 50, order: str = "id") -> DataFrame:
    """The k weakest rows of each label (trimmed, upper-cased), with weakness; ties by `order`."""
    rows = with_weakness(df, threshold)
    w = W.partitionBy("label").orderBy(F.desc("weakness"), order)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def lighting_paths(gaps: DataFrame, lightings: list[str], extension: str = ".png", root: str = "") -> DataFrame:
    """A row for each lighting of a weak sample: filepath is input_path/object_lighting.extension under root."""
    path = F.concat(F.lit(root), F.col("input_path"), F.lit("/"), F.col("object_name"), F.lit("_"), F.col("_l"), F.lit(extension))
    return gaps.withColumn("_l", F.explode(F.array(*[F.lit(x) for x in lightings]))).withColumn("filepath", path).drop("_l")


def breakdown(gaps: DataFrame) -> DataFrame:
    """Per label: count, share of all in per cent, and how many lie on the wrong side."""
    got = gaps.groupBy("label").agg(F.count("*").alias("cnt"), F.count_if(F.col("weakness") > 0).alias("misclassified"))
    return got.withColumn("pct", F.round(100.0 * F.col("cnt") / F.sum("cnt").over(W.partitionBy()), 2))


def disagreements(df: DataFrame, response: str = "response", truth: str = "gt") -> DataFrame:
    """Rows whose answers differ, with gap FP (yes for no) or FN (no for yes). Answers that aren't plain are left out."""
    r, t = yes_no(F.col(response)), yes_no(F.col(truth))
    gap = F.when((r == "yes") & (t == "no"), "FP").when((r == "no") & (t == "yes"), "FN")
    return df.withColumn("gap", gap).filter("gap is not null")


def gap_totals(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count_if(F.col("gap") == "FP").alias("fp"), F.count_if(F.col("gap") == "FN").alias("fn"), F.count("*").alias("total"))
