"""Vector nearest neighbours and one-to-one greedy assignment with quotas.

k nearest: sources stream past the targets a block at a time in numpy, each task keeps its k best per target, and a
window merges them; targets are broadcast behind a check of their number, in slices beyond it. `exact_pairs` is the same
in column expressions. Assignment is a fold in target order over k candidates per target, one class at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions import vectors
from sparkloom.functions.text import label_key

#: Target vectors sent to executors at a time.
TARGET_ROWS = 20_000
#: Distances that a task holds at a time.
BLOCK = 4_000_000


def exact_pairs(targets: DataFrame, sources: DataFrame, k: int, metric: str = "euclidean", digits: int | None = None) -> DataFrame:
    """(target, rank, source, distance): k nearest sources of each target, ties by source, in column expressions alone.

    targets (target, vec) are broadcast; more than TARGET_ROWS of them go by nearest(), a slice at a time. digits rounds
    distances before they are ranked.
    """
    if targets.limit(TARGET_ROWS + 1).count() > TARGET_ROWS:
        return nearest(targets, sources, k, metric, digits)
    d = vectors.distance(F.col("tv"), F.col("sv"), metric)
    d = d if digits is None else F.round(d, digits)
    pairs = sources.select("source", F.col("vec").alias("sv")).join(F.broadcast(targets.select("target", F.col("vec").alias("tv"))))
    pairs = pairs.select("target", "source", d.alias("distance"))
    w = W.partitionBy("target").orderBy("distance", "source")
    return pairs.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("target", "rank", "source", "distance")


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """(targets, sources) distances in double precision."""
    if metric == "manhattan":
        return np.stack([np.abs(b - x).sum(axis=1) for x in a]) if len(a) else np.zeros((0, len(b)))
    if metric == "cosine":
        scale = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
        return 1 - np.divide(a @ b.T, scale, out=np.zeros((len(a), len(b))), where=scale > 0)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _again(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (a[at], b[to]), a bounded number at a time; euclidean ones by differences."""
    out = np.empty(len(at))
    for i in range(0, len(at), 50_000):
        x, y = a[at[i : i + 50_000]], b[to[i : i + 50_000]]
        if metric == "cosine":
            scale = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
            out[i : i + 50_000] = 1 - np.divide((x * y).sum(axis=1), scale, out=np.zeros(len(x)), where=scale > 0)
        else:
            out[i : i + 50_000] = np.abs(x - y).sum(axis=1) if metric == "manhattan" else np.sqrt(((x - y) ** 2).sum(axis=1))
    return out


def _blocks(frames, n: int):
    for pdf in frames:
        for i in range(0, len(pdf), max(1, n)):
            yield pdf.iloc[i : i + max(1, n)]


def nearest(targets: DataFrame, sources: DataFrame, k: int, metric: str = "euclidean", digits: int | None = None) -> DataFrame:
    """As exact_pairs, by blocks in numpy. k is limited by the number of sources itself.

    With digits, what comes near the k best is measured again by differences, so that copies tie as in exact_pairs.
    """
    if metric not in vectors.METRICS:
        raise ValueError(f"metric must be one of {vectors.METRICS}, not {metric!r}")
    sc, kind = targets.sparkSession.sparkContext, sources.schema["source"].dataType.simpleString()
    total = targets.count()
    slices, out = max(1, math.ceil(total / TARGET_ROWS)), None
    for i in range(slices):
        some = targets if slices == 1 else targets.filter(F.pmod(F.xxhash64("target"), F.lit(slices)) == i)
        local = some.select("target", "vec").collect()
        names = [r[0] for r in local]
        shared = sc.broadcast((names, np.array([r[1] for r in local], dtype=np.float64)))

        def best(frames, shared=shared):
            names, matrix = shared.value
            held, worst = None, np.full(len(names), np.inf)
            for pdf in _blocks(frames, BLOCK // max(1, len(names))):
                if not names:
                    continue
                vecs = np.stack(pdf["vec"]).astype(np.float64)
                d = _distances(matrix, vecs, metric)
                edge = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else d.max(axis=1)
                # All that tie with the last are kept, for ties go by source.
                at, to = np.nonzero(d <= (np.minimum(edge, worst) + (0.0 if digits is None else 1e-6))[:, None])
                near = d[at, to] if digits is None else np.round(_again(matrix, vecs, at, to, metric), digits)
                part = pd.DataFrame({"t": at, "source": pdf["source"].to_numpy()[to], "distance": near})
                held = part if held is None else pd.concat([held, part], ignore_index=True)
                held = held.sort_values(["t", "distance", "source"]).groupby("t").head(k)
                full = held.groupby("t")["distance"].agg(["size", "max"])
                full = full[full["size"] == k]
                worst[full.index] = full["max"]
            if held is not None:
                yield pd.DataFrame({"target": [names[t] for t in held["t"]], "source": held["source"], "distance": held["distance"]})

        schema = f"target {targets.schema['target'].dataType.simpleString()}, source {kind}, distance double"
        part = sources.select("source", "vec").mapInPandas(best, schema)
        out = part if out is None else out.unionAll(part)
    w = W.partitionBy("target").orderBy("distance", "source")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("target", "rank", "source", "distance")


def mine(pairs: DataFrame, labels: tuple[DataFrame, DataFrame] | None = None, threshold: float = -1.0) -> DataFrame:
    """Sources that survive label agreement and the distance threshold, each once with its least distance.

    labels: (target, label) and (source, label), compared trimmed and upper-cased. A distance equal to the threshold is
    kept; a negative threshold keeps all.
    """
    if labels is not None:
        t, s = (x.select(x.columns[0], label_key(F.col("label").cast("string")).alias(n)) for x, n in zip(labels, ("_tl", "_sl")))
        pairs = pairs.join(t, "target").join(s, "source").filter(F.col("_tl") == F.col("_sl"))
    if threshold >= 0:
        pairs = pairs.filter(F.col("distance") <= threshold)
    return pairs.groupBy("source").agg(F.min("distance").alias("distance"))


def mined(targets: DataFrame, sources: DataFrame, k: int, metric: str = "euclidean", threshold: float = -1.0, by_label: bool = False, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Mining in one call: the sources that mine() keeps of the k nearest, and one row of counters.

    Counters: targets, pairs, label_kept, distance_kept (of those), candidates, unique, duplicates.
    """
    pairs = nearest(targets, sources, k, metric, digits)
    flags = pairs.withColumn("_same", F.lit(True))
    if by_label:
        t, s = (x.select(x.columns[0], label_key(F.col("label").cast("string")).alias(n)) for x, n in ((targets.select("target", "label"), "_tl"), (sources.select("source", "label"), "_sl")))
        flags = pairs.join(t, "target").join(s, "source").withColumn("_same", F.coalesce(F.col("_tl") == F.col("_sl"), F.lit(False)))
    near = F.lit(True) if threshold < 0 else F.col("distance") <= threshold
    kept = F.col("_same") & near
    counters = flags.agg(
        F.count_distinct("target").alias("targets"), F.count("*").alias("pairs"), F.count_if("_same").alias("label_kept"), F.count_if(kept).alias("distance_kept"),
        F.count_if(kept).alias("candidates"), F.count_distinct(F.when(kept, F.col("source"))).alias("unique"),
    ).withColumn("duplicates", F.col("candidates") - F.col("unique"))
    return flags.filter(kept).groupBy("source").agg(F.min("distance").alias("distance")), counters


def coverage(found: DataFrame, classes: DataFrame, desired: int) -> DataFrame:
    """One row: sources matched, of how many desired, per cent, and how many classes of sources they come from."""
    n = found.join(classes, "source", "left").agg(F.count_distinct("source").alias("matched"), F.count_distinct("type").alias("classes"))
    return n.select("matched", F.lit(desired).cast("bigint").alias("desired"), F.round(100.0 * F.col("matched") / desired, 4).alias("pct"), "classes")


def exclude(sources: DataFrame, gone: DataFrame, path: str = "path") -> DataFrame:
    """sources without rows whose path, or whose last path part, is among gone's."""
    base = lambda c: F.regexp_extract(c, r"[^/]*$", 0)
    names = gone.select(base(F.col(path)).alias("_n")).distinct()
    paths = gone.select(F.col(path).alias("_p")).distinct()
    return sources.join(paths, F.col(path) == F.col("_p"), "left_anti").join(names, base(F.col(path)) == F.col("_n"), "left_anti")


def quotas(ratios: DataFrame, total: int) -> DataFrame:
    """Largest remainder: (name, ratio) to (name, quota). Ratios are taken as parts of their sum; leftovers go by
    (remainder, name), both descending."""
    share = ratios.withColumn("_x", F.coalesce(F.try_divide(F.col("ratio") * total, F.sum("ratio").over(W.partitionBy())), F.lit(0.0)))
    share = share.withColumn("_f", F.floor("_x").cast("bigint")).withColumn("_r", F.round(F.col("_x") - F.col("_f"), 12))
    rank = F.row_number().over(W.partitionBy().orderBy(F.desc("_r"), F.desc("name")))
    left = F.lit(total) - F.sum("_f").over(W.partitionBy())
    return share.withColumn("_k", rank).withColumn("_left", left).select("name", (F.col("_f") + (F.col("_k") <= F.col("_left")).cast("bigint")).alias("quota"))


@dataclass
class Round:
    """Rows (target, source, distance, rank) of one pass, and the targets that got too few."""

    rows: pd.DataFrame
    retry: list


def assign_once(candidates: pd.DataFrame, order: list, topn: int) -> Round:
    """Targets in order each take their topn nearest unclaimed sources, or none: then they are to be tried again."""
    claimed, rows, retry = set(), [], []
    near = {t: g.sort_values(["distance", "source"]) for t, g in candidates.groupby("target")}
    for t in order:
        got = []
        g = near.get(t)
        if g is not None:
            for s, d in zip(g["source"], g["distance"]):
                if s not in claimed and all(s != x for x, _ in got):
                    got.append((s, d))
                    if len(got) == topn:
                        break
        if len(got) < topn:
            retry.append(t)
            continue
        claimed |= {s for s, _ in got}
        rows += [(t, s, d, i + 1) for i, (s, d) in enumerate(got)]
    return Round(pd.DataFrame(rows, columns=["target", "source", "distance", "rank"]), retry)


def assign(targets: DataFrame, sources: DataFrame, desired: int, metric: str = "euclidean", factor: int = 5, rounds: int = 8, taken: set | None = None) -> list[tuple[object, float]]:
    """Up to `desired` sources, each for one target only: (source, distance), nearest rounds first.

    Each target wants ceil(desired / targets). A round looks at factor * round * topn candidates of each open target, and
    what it found is added nearest first up to the cap; only targets that got too few go on, without what is taken.
    Candidates and targets of a class come to the driver: targets * k rows of ids and distances.
    """
    order = [r[0] for r in targets.select("target").orderBy("target").collect()]
    if not order or desired <= 0:
        return []
    topn, out, gone = max(1, math.ceil(desired / len(order))), [], set(taken or ())
    normal = lambda df: df.withColumn("vec", vectors.l2_normalize(F.col("vec")))
    spark, targets, sources = targets.sparkSession, normal(targets), normal(sources)
    kind = sources.schema["source"].dataType
    for i in range(rounds):
        left = sources
        if gone:
            left = sources.join(spark.createDataFrame([(x,) for x in gone], f"source {kind.simpleString()}"), "source", "left_anti")
        open_targets = targets if i == 0 else targets.join(spark.createDataFrame([(x,) for x in order], f"target {targets.schema['target'].dataType.simpleString()}"), "target", "left_semi")
        found = assign_once(nearest(open_targets, left, factor * (i + 1) * topn, metric).toPandas(), order, topn)
        new = found.rows.groupby("source", as_index=False)["distance"].min().sort_values(["distance", "source"])
        new = [(s, d) for s, d in zip(new["source"].tolist(), new["distance"].tolist()) if s not in gone][: desired - len(out)]
        if not new:
            break
        out += new
        gone |= {s for s, _ in new}
        order = found.retry
        if len(out) >= desired or not order:
            break
    return out


def assign_stratified(targets: DataFrame, sources: DataFrame, desired: int, rare: list[str], metric: str = "euclidean", factor: int = 5) -> list[tuple[str, object, float]]:
    """(class, source, distance) with quotas by class. targets and sources have `classes`, an array of names.

    Rare classes go first by name, each with its own pool of sources, then the rest's pool for what it lacks; last the
    targets without rare classes. No source is taken twice.
    """
    names = sorted({r.lower() for r in rare})
    low = lambda df: df.withColumn("classes", F.transform("classes", lambda c: F.lower(c)))
    targets, sources = low(targets), low(sources)
    has = lambda df, c: df.filter(F.array_contains("classes", c))
    plain = lambda df: df.filter(~F.arrays_overlap("classes", F.array(*[F.lit(n) for n in names])))
    counts = [(c, float(has(targets, c).count())) for c in names] + [("non_rare", float(plain(targets).count()))]
    quota = {r["name"]: r["quota"] for r in quotas(targets.sparkSession.createDataFrame(counts, "name string, ratio double"), desired).collect()}
    out, gone = [], set()
    for c, n in counts:
        want = quota[c]
        if not n or want <= 0:
            continue
        mine_targets = plain(targets) if c == "non_rare" else has(targets, c)
        for pool in [plain(sources)] if c == "non_rare" else [has(sources, c), plain(sources)]:
            got = assign(mine_targets, pool, want, metric, factor, taken=gone)
            out += [(c, s, d) for s, d in got]
            gone |= {s for s, _ in got}
            want -= len(got)
            if want <= 0:
                break
    return out


def distance_stats(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class and over all: count, min, max, mean, median, std (of the population), p25, p75 of nearest distances.

    pairs: (target, rank, distance); classes: (target, type). Of several rows for a target the first by rank counts.
    """
    first = pairs.groupBy("target").agg(F.min_by("distance", "rank").alias("distance")).filter("distance is not null")
    rows = first.join(classes, "target").select("type", "distance").unionAll(first.select(F.lit("overall"), "distance"))
    d, q = F.col("distance"), lambda p: F.round(F.percentile("distance", p), 6)
    return rows.groupBy("type").agg(
        F.count("*").alias("cnt"), F.round(F.min(d), 6).alias("min"), F.round(F.max(d), 6).alias("max"), F.round(F.avg(d), 6).alias("mean"),
        q(0.5).alias("median"), F.round(F.stddev_pop(d), 6).alias("std"), q(0.25).alias("p25"), q(0.75).alias("p75"),
    )


def class_presence(annotations: DataFrame, rare: list[str]) -> DataFrame:
    """One row: images with rare classes, without, and rare class hits (distinct rare classes of each image, summed)."""
    per = annotations.groupBy("image_id").agg(F.array_distinct(F.collect_list(F.lower("type"))).alias("c"))
    hits = F.size(F.array_intersect("c", F.array(*[F.lit(r.lower()) for r in rare])))
    return per.agg(F.count_if(hits > 0).alias("rare_images"), F.count_if(hits == 0).alias("common_images"), F.sum(hits).cast("bigint").alias("rare_instances"))


def class_counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("type").agg(F.count_distinct("image_id").alias("image_count"), F.count("*").alias("instance_count"))
