"""Quality rules: base counts of a text and a robust multivariate outlier test, in DataFrame functions only.

Method: each document gets a vector of transformed statistics. Per language and source, minimum-covariance-determinant
estimates of location and scatter are found by concentration steps: the mean and covariance of the h rows that are
nearest to the last estimate, again and again. There are three starts: medians and scaled median absolute deviations;
the mean and covariance of all rows; those of rows without an extreme statistic. After two steps each, the start with the
least determinant goes on until determinants stand still. Estimates of small groups are drawn towards their language's,
and those towards all, in the measure of their rows. A document whose squared Mahalanobis distance is above the cut goes.

Scale: one pass over the texts makes a narrow table of integers, which is kept in the checkpoint folder. Each step then
takes two aggregations that combine on the map side: a histogram of distances per group (of bounded size) and sums of
products. A group with a third of all rows costs no more in any one task than others do. All sums are of integers, so
the result does not hang on the order in which partitions are merged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, WORD, cut, word_array

_POS_BITS = 31  # places of words in a text, as many as an array can have; 32 bits hold a hash, and what it finds is compared in full
#: The statistics as integers: a unit is 1 / _UNIT.
_UNIT = 256
FEATURES = ["f_len", "f_sym", "f_dup", "f_rep", "f_caps", "f_mark"]
_P = len(FEATURES)


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_pct: the base rule. share: the part of a group's rows that the estimates rest on.

    prior_rows: rows that a language's estimate weighs against a group's own, and all rows' against a language's. floor:
    the least standard deviation of a statistic that is believed. trim: robust deviations at which a statistic is extreme
    in the third start. tolerance: change of a log determinant that counts as standing still. steps: concentration steps
    at most. cut: the largest distance kept, squared, in units where the share-quantile of normal rows is where it should be.
    """

    min_words: int = 50
    max_repeat_pct: int = 50
    share: float = 0.75
    prior_rows: int = 40
    floor: float = 0.25
    trim: float = 4.0
    tolerance: float = 0.02
    steps: int = 12
    cut: float = 225.0


def _union_length(pos: Column) -> Column:
    """Words covered by three-word windows that begin at the sorted places pos."""
    gaps = F.transform(pos, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(pos, k + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_caps, n_marks; a null text has no words.

    Repeated windows are found in the row: hashes with places are sorted as numbers and neighbours compared; the few
    windows that stand out are then compared as text, so a clash of hashes counts nothing.
    """
    keep = [c for c in df.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.select(*keep, F.col(text), t.alias("_t"), word_array(F.col(text)).alias("_w"))
    w, n = F.col("_w"), F.size("_w")
    low = (1 << _POS_BITS) - 1
    high = (1 << 63) - 1 - low
    df = df.select("*", F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")).alias("_i"))
    packed = F.transform("_i", lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(high)).bitwiseOR(i.cast("long")))
    df = df.select("*", F.sort_array(packed).alias("_s"))
    s = F.col("_s")
    # Equal hashes stand side by side, less than 2 ** _POS_BITS apart; the difference can't overflow, both are positive.
    close = F.filter("_i", lambda k: F.get(s, k + 1) - F.get(s, k) <= low)
    df = df.select("*", F.array_distinct(F.flatten(F.transform(close, lambda k: F.array(k, k + 1)))).alias("_k")).drop("_i")
    df = df.select("*", F.transform("_k", lambda k: F.get(s, k).bitwiseAND(F.lit(low)).cast("int")).alias("_c")).drop("_s", "_k")
    spelled = F.transform(
        F.col("_c"), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))
    )
    df = df.select("*", F.sort_array(spelled).alias("_e"))
    e = F.col("_e")
    twice = F.filter(e, lambda x, k: F.coalesce(x["t"] == F.get(e, k + 1)["t"], F.lit(False)) | ((k > 0) & F.coalesce(x["t"] == F.get(e, k - 1)["t"], F.lit(False))))
    df = df.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_p"))
    df = df.select("*", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)).alias("_l"))
    return df.select(
        *keep,
        text,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _union_length(F.col("_p")).alias("n_repeat_words"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("n_caps"),
        F.regexp_count("_t", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.size("_l").cast("long").alias("_n_lines"),
    )


def _features() -> list[Column]:
    """The statistics after their transforms, whole numbers of 1 / _UNIT. Ratios go through log1p, which draws tails in."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    c = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("_n_lines"), F.lit(1)).cast("double")
    raw = [
        4 * F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(20 * F.col("n_symbols") / n),
        2 * F.col("n_dup_lines") / lines,
        4 * F.col("n_repeat_words") / n,
        F.log1p(10 * F.col("n_caps") / c),
        F.log1p(20 * F.col("n_marks") / n),
    ]
    return [F.round(x * _UNIT).cast("long").alias(name) for x, name in zip(raw, FEATURES, strict=True)]


def _name(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))


#: Buckets of distances, so many to a doubling, and of statistics, so many units each, in the search for medians.
_FINE = 32
_COARSE = 16


def _median(values: DataFrame, v: str) -> DataFrame:
    """Lower median of v by (_g, _k), from values (_g, _k, v, _c: how often)."""
    w = W.partitionBy("_g", "_k")
    ranked = values.select("*", F.sum("_c").over(w.orderBy(v).rangeBetween(W.unboundedPreceding, 0)).alias("_at"), F.sum("_c").over(w).alias("_all"))
    return ranked.filter(2 * F.col("_at") >= F.col("_all")).groupBy("_g", "_k").agg(F.min(v).alias("_mid"))


def _scales(fit: DataFrame) -> DataFrame:
    """Per group: _mid0.. and _dev0.., medians and median absolute deviations in buckets of _COARSE units."""
    long = fit.select("_g", F.posexplode(F.array(*[F.floor((F.col(f) + _COARSE // 2) / _COARSE).cast("long") for f in FEATURES])).alias("_k", "_v"))
    counts = cut(long.groupBy("_g", "_k", "_v").agg(F.count("*").alias("_c")))
    mid = _median(counts, "_v")
    off = counts.join(mid, ["_g", "_k"]).select("_g", "_k", F.abs(F.col("_v") - F.col("_mid")).alias("_v"), "_c")
    both = mid.join(_median(off.groupBy("_g", "_k", "_v").agg(F.sum("_c").alias("_c")), "_v").withColumnRenamed("_mid", "_dev"), ["_g", "_k"])
    return both.groupBy("_g").agg(*[F.max(F.when(F.col("_k") == k, F.col(x) * _COARSE)).alias(f"{x}{k}") for k in range(_P) for x in ("_mid", "_dev")])


def _sums(rows: DataFrame) -> DataFrame:
    """Counts, sums and sums of products of the statistics, by group and start."""
    return rows.groupBy("_lang", "_g", "_s").agg(
        F.count("*").alias("n"),
        *[F.expr(f"sum({FEATURES[i]}) as a{i}") for i in range(_P)],
        *[F.expr(f"sum({FEATURES[i]} * {FEATURES[j]}) as q{i}{j}") for i, j in _TRIANGLE],
    )


_TRIANGLE = [(i, j) for i in range(_P) for j in range(i + 1)]
_SUMS = ["n", *[f"a{i}" for i in range(_P)], *[f"q{i}{j}" for i, j in _TRIANGLE]]


def _moments(prefix: str) -> tuple[list[str], dict[tuple[int, int], str]]:
    """Mean and covariance, as SQL, from sums whose names have the prefix."""
    n = f"{prefix}n"
    mean = [f"{prefix}a{i} / {n} / {_UNIT}" for i in range(_P)]
    return mean, {(i, j): f"({prefix}q{i}{j} / {n} / {_UNIT * _UNIT} - ({mean[i]}) * ({mean[j]}))" for i, j in _TRIANGLE}


def _estimates(sums: DataFrame, rules: Rules) -> DataFrame:
    """Per group and start, from its sums, kept in the checkpoint folder, as _factored gives them.

    Means and covariances are weighed with those of the language, which are weighed with those of all rows; the floor is
    added to the scatter's diagonal, so that it is positive.
    """
    whole = sums.groupBy("_s").agg(*[F.expr(f"sum({x}) as w_{x}") for x in _SUMS])  # a row for each of three starts
    est = sums.selectExpr("*", *[f"sum({x}) over (partition by _lang, _s) as v_{x}" for x in _SUMS]).join(F.broadcast(whole), "_s")
    mean, cov = _moments("w_")
    for own in ("v_", ""):
        weight = f"({own}n / ({own}n + {rules.prior_rows}))"
        near_mean, near_cov = _moments(own)
        mean = [f"({x} * {weight} + {y} * (1 - {weight}))" for x, y in zip(near_mean, mean)]
        cov = {k: f"({near_cov[k]} * {weight} + {cov[k]} * (1 - {weight}))" for k in _TRIANGLE}
    scatter = [f"{cov[i, j]} + {rules.floor**2 if i == j else 0.0}D" for i, j in _TRIANGLE]
    return cut(_factored(cut(est.selectExpr("_g", "_s", f"array({', '.join(mean)}) as _m", f"array({', '.join(scatter)}) as _v"))))


def _factored(est: DataFrame) -> DataFrame:
    """est (_g, _s, mean _m, lower triangle _v of the scatter by rows) with _k, the inverse of its Cholesky factor, and _det, its log determinant."""
    places = ", ".join(f"struct({i} as i, {j} as j)" for i, j in _TRIANGLE)
    at = lambda x, i, j: f"get({x}, cast({i} * ({i} + 1) / 2 as int) + {j})"
    upto = lambda keep: f"filter(sequence(0, {_P - 1}), m -> {keep})"
    left = f"aggregate({upto('m < x.j')}, {at('_v', 'x.i', 'x.j')}, (t, m) -> t - {at('l', 'x.i', 'm')} * {at('l', 'x.j', 'm')})"
    factor = f"(l, x) -> array_append(l, if(x.i = x.j, sqrt(greatest({left}, 1e-9D)), {left} / {at('l', 'x.j', 'x.j')}))"
    est = est.withColumn("_l", F.expr(f"aggregate(array({places}), cast(array() as array<double>), {factor})"))
    inner = f"aggregate({upto('m < x.i and m >= x.j')}, 0D, (t, m) -> t + {at('_l', 'x.i', 'm')} * {at('k', 'm', 'x.j')})"
    inverse = f"(k, x) -> array_append(k, if(x.i = x.j, 1 / {at('_l', 'x.i', 'x.i')}, - {inner} / {at('_l', 'x.i', 'x.i')}))"
    inverse = F.expr(f"aggregate(array({places}), cast(array() as array<double>), {inverse})")
    det = reduce(lambda a, b: a + b, [2 * F.log(F.get("_l", F.lit(i * (i + 1) // 2 + i))) for i in range(_P)])
    return est.select("_g", "_s", "_m", inverse.alias("_k"), det.alias("_det"))


def _distances(rows: DataFrame, est: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows, once for each estimate of their group, with _d, the squared Mahalanobis distance."""
    df = rows.join(F.broadcast(est) if few else est.hint("merge"), "_g", how)
    x = [f"({FEATURES[i]} / {_UNIT} - get(_m, {i}))" for i in range(_P)]
    y = ["(" + " + ".join(f"get(_k, {i * (i + 1) // 2 + j}) * {x[j]}" for j in range(i + 1)) + ")" for i in range(_P)]
    return df.withColumn("_d", F.expr(" + ".join(f"{v} * {v}" for v in y))).drop("_m", "_k", "_det")


def _edges(dist: DataFrame, by: list[str], share: float) -> DataFrame:
    """By the given columns: _h, the upper edge of the bucket of distances up to which at least the share of rows lie."""
    b = F.floor(F.log2(F.greatest(F.col("_d"), F.lit(1e-3))) * _FINE)
    counts = dist.groupBy(*by, b.alias("_b")).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by)
    ranked = counts.select("*", F.sum("_c").over(w.orderBy("_b")).alias("_at"), F.sum("_c").over(w).alias("_all"))
    return ranked.filter(F.col("_at") >= F.col("_all") * share).groupBy(*by).agg(F.pow(F.lit(2.0), (F.min("_b") + 1) / _FINE).alias("_h"))


def _concentrated(fit: DataFrame, est: DataFrame, rules: Rules, few: bool) -> DataFrame:
    """Sums of the rows that lie nearest to each estimate of their group: one concentration step."""
    near = _edges(_distances(fit, est, few), ["_g", "_s"], rules.share)
    return cut(_sums(_distances(fit, est.join(near, ["_g", "_s"]), few).filter(F.col("_d") < F.col("_h"))))


def _fitted(fit: DataFrame, rules: Rules, few: bool) -> DataFrame:
    """The estimate of each group, by concentration from three starts."""
    scales = _scales(fit)
    scale = [F.greatest(1.4826 * F.col(f"_dev{k}") / _UNIT, F.lit(rules.floor)) for k in range(_P)]
    scales = cut(scales.select("_g", *[(F.col(f"_mid{k}") / _UNIT).alias(f"m{k}") for k in range(_P)], *[scale[k].alias(f"c{k}") for k in range(_P)]))
    diagonal = F.array(*[F.pow(f"c{i}", F.lit(2)) if i == j else F.lit(0.0) for i, j in _TRIANGLE])
    diagonal = scales.select("_g", F.lit(0).alias("_s"), F.array(*[f"m{k}" for k in range(_P)]).alias("_m"), diagonal.alias("_v"))
    rows = fit.join(F.broadcast(scales) if few else scales.hint("merge"), "_g")
    far = reduce(lambda a, b: a | b, [F.abs(F.col(FEATURES[k]) / _UNIT - F.col(f"m{k}")) > rules.trim * F.col(f"c{k}") for k in range(_P)])
    starts = rows.select("_lang", "_g", *FEATURES, F.explode(F.when(far, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("_s"))
    est = cut(_factored(diagonal)).unionByName(_estimates(cut(_sums(starts)), rules))
    for _ in range(2):
        est = _estimates(_concentrated(fit, est, rules, few), rules)
    # Of starts with equal determinants the first goes on.
    best = est.groupBy("_g").agg(F.min(F.struct(F.round("_det", 9).alias("d"), F.col("_s")))["_s"].alias("_s"))
    est = cut(est.join(best, ["_g", "_s"]).withColumn("_s", F.lit(0)))
    for _ in range(rules.steps - 2):
        new = _estimates(_concentrated(fit, est, rules, few), rules)
        moved = new.join(est.select("_g", F.col("_det").alias("_was")), "_g").filter(F.abs(F.col("_det") - F.col("_was")) > rules.tolerance)
        est, still = new, moved.isEmpty()
        if still:
            break
    return est


def _expected(share: float) -> float:
    """Quantile of the squared length of a standard normal vector of _P parts (Wilson and Hilferty's approximation)."""
    return _P * (1 - 2 / (9 * _P) + NormalDist().inv_cdf(share) * (2 / (9 * _P)) ** 0.5) ** 3


def judge(df: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", source: str = "source", row: str = "doc_id") -> DataFrame:
    """One row per row of df: row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Null texts have no words and fail the base rule. Null languages and sources are groups of their own. Rows that fail
    the base rule take no part in the estimates; where all rows of a group fail it, distance is null. Repeated rows are
    judged alike and each returned. An empty table gives an empty result. Other columns of df are not read.
    """
    base = df.select(F.col(row).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang0"), F.col(source).alias("_source0"))
    base = with_counts(base, "_text")
    stats = base.select(
        "_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _name("_lang0").alias("_lang"), F.concat_ws("\x1f", _name("_lang0"), _name("_source0")).alias("_g"), *_features()
    ).withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")))
    stats = cut(stats)
    fit = stats.filter(~F.col("base_failed")).select("_lang", "_g", *FEATURES)
    few = stats.select("_g").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    est = _fitted(fit, rules, few)
    dist = cut(_distances(fit, est, few).select("_lang", "_g", "_d"))
    # The edge, too, is weighed with the language's.
    sizes = dist.groupBy("_lang", "_g").agg(F.count("*").alias("_n"))
    edges = _edges(dist, ["_g"], rules.share).join(sizes, "_g").join(_edges(dist, ["_lang"], rules.share).withColumnRenamed("_h", "_up"), "_lang")
    weight = F.col("_n") / (F.col("_n") + rules.prior_rows)
    edges = edges.select("_g", F.exp(weight * F.log("_h") + (1 - weight) * F.log("_up")).alias("_h"))
    judged = _distances(stats, cut(est.join(edges, "_g")), few, "left")
    expected = _expected(rules.share)
    judged = judged.withColumn("distance", F.round(F.col("_d") * expected / F.greatest(F.col("_h"), F.lit(expected / 4)), 6))
    return judged.select(
        F.col("_id").alias(row), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= rules.cut, F.lit(False))).alias("kept"),
    )
