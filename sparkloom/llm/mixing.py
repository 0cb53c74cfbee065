"""Mixing sources to target weights by Pareto order sampling.

Method: every source gets a target number of words by weight, at most `cap` times its own size. A document's expected
copies are in proportion to its importance, at most `cap`, scaled per source so that the expected words are its target.
Whole copies are certain; for the rest documents are ranked by random odds over inclusion odds, and taken from the least
up until the words left are filled.

Scale: one pass over the texts counts words; all else works on narrow rows in the checkpoint folder. Where the rank ends
is found per source by histograms over the rank (at most 4096 buckets per source and level), refined until the bucket
that holds the end has at most `region` documents; only those are looked at one by one. No source is sorted as a whole.
Ranks come of a row's contents, and below them of its number, so rows that are alike fall apart too. In making the
mixture a row is judged where it lies, by its rank and its source's end; only rows at that end are joined.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut, join_small

_TIE = 18  # low bits of a rank, of the row's number
_BITS = 44 + _TIE  # of the rank
_LEVELS = 16  # of importance, to a doubling
_LOOKED_UP = 400_000  # rows at the sources' ends that are broadcast, at most


@dataclass(frozen=True)
class Mix:
    """weights: dealt to the sources in order of code points, null last, again and again. cap: copies at most.

    length_power: a document's importance is its number of words to this power (0: all alike). importance: column of
    positive numbers that is taken instead. Importances are rounded to sixteenths of a doubling.
    region: documents looked at one by one where a source's sample ends. seed: of the random ranks.
    """

    weights: tuple[int, ...] = (1, 2, 3)
    cap: int = 3
    length_power: float = 0.25
    importance: str | None = None
    region: int = 4096
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD + "+")).cast("long")


def targets(sizes: DataFrame, p: Mix = Mix()) -> DataFrame:
    """sizes (_source, source_size, ...) with target. Only sums come to the driver; each round caps more sources."""
    # One row per source: the number of sources, not of documents, meets in the one task that numbers them.
    rank = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in p.weights]), (F.pmod(rank - 1, F.lit(len(p.weights))) + 1).cast("int"))
    sizes = cut(sizes.withColumn("_weight", weight))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    unit, left = 0.0, (total, sizes.agg(F.sum("_weight")).first()[0] or 0)
    while left[1] and unit != left[0] / left[1]:
        unit = left[0] / left[1]
        above = F.col("_weight") * unit > p.cap * F.col("source_size")
        capped, weights = sizes.agg(F.sum(F.when(above, p.cap * F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("_weight")))).first()
        left = (total - capped, weights)
    return sizes.withColumn("target", F.least(F.col("_weight") * F.lit(float(unit)), (p.cap * F.col("source_size")).cast("double"))).drop("_weight")


def _levels(docs: DataFrame, region: DataFrame, p: Mix) -> DataFrame:
    """Per source (_source, _shift, _lo, _rem, _n): the stretch of ranks in which its sample ends and the words left for it."""
    while (region.filter("_shift > 0").agg(F.max("_n")).first()[0] or 0) > p.region:
        bits = F.least(F.lit(12), F.col("_shift"), F.greatest(F.lit(0), F.ceil(F.log2(4 * F.col("_n") / p.region)).cast("int")))
        inside = join_small(docs, region, ["_key"]).filter(F.expr("shiftright(_rank, _shift) = _lo")).withColumn("_next", F.col("_shift") - bits)
        hist = inside.groupBy("_key", "_rem", "_next", F.expr("shiftright(_rank, _next)").alias("_b")).agg(F.sum("_part_size").alias("_words"), F.count("*").alias("_n"))
        w = W.partitionBy("_key").orderBy("_b")
        hist = hist.withColumn("_upto", F.sum("_words").over(w)).withColumn("_last", F.max("_b").over(W.partitionBy("_key")))
        ends = hist.filter((F.col("_upto") >= F.col("_rem")) | (F.col("_b") == F.col("_last")))
        ends = ends.withColumn("_first", F.row_number().over(w)).filter("_first = 1")
        found = cut(ends.select("_key", F.col("_next").alias("_shift"), F.col("_b").alias("_lo"), (F.col("_rem") - F.col("_upto") + F.col("_words")).alias("_rem"), "_n"))
        region = cut(found.unionByName(region.join(found.select("_key"), "_key", "left_anti")))
    return region


def _fill(pdf):
    """Documents of one source's last stretch by rank: each that still fits is taken, then the end is mended.

    Mending exchanges, adds or drops one or two documents among the last 64 taken and the first 64 left, as long as the
    words come nearer to what is wanted. So the sample is right in words to a few, and random but at its end.
    """
    import numpy as np

    pdf = pdf.sort_values(["_rank", "_no"], kind="stable")
    size = pdf["_part_size"].to_numpy(np.int64)
    left, taken = float(pdf["_rem"].iloc[0]) if len(pdf) else 0.0, np.zeros(len(pdf), bool)
    for i, n in enumerate(size.tolist()):
        if 0 < n <= left + 0.5:
            taken[i] = True
            left -= n
    for _ in range(16):
        # Moves: a document in (or none), a document out (or none), and two such moves at once.
        into, out = np.append(np.flatnonzero(~taken & (size > 0))[:64], -1), np.append(np.flatnonzero(taken)[-64:], -1)
        gain = (np.where(into < 0, 0, size[into])[:, None] - np.where(out < 0, 0, size[out])).ravel()
        order = np.argsort(gain, kind="stable")
        near = np.clip(np.searchsorted(gain[order], left - gain)[:, None] + np.arange(-2, 3), 0, len(gain) - 1)
        first, second = np.repeat(np.arange(len(gain)), 5), order[near].ravel()
        fi, fo, si, so = into[first // len(out)], out[first % len(out)], into[second // len(out)], out[second % len(out)]
        apart = ((fi != si) | (fi < 0)) & ((fo != so) | (fo < 0))
        off = np.where(apart, np.abs(left - gain[first] - gain[second]), np.inf)
        k = int(off.argmin())
        if off[k] >= abs(left) - 1e-9:
            break
        for i in (fi[k], si[k]):
            taken[i] = taken[i] or i >= 0
        for i in (fo[k], so[k]):
            taken[i] = taken[i] and i < 0
        left -= gain[first[k]] + gain[second[k]]
    pdf["_extra"] = taken.astype(np.int64)
    return pdf


def _scales(levels: DataFrame, sizes: DataFrame, p: Mix) -> DataFrame:
    """Per source (_key, _scale): expected copies are _scale times importance, at most cap, and make the target in words.

    levels (_key, _level, _words): few rows a source. The most important levels reach the cap; the rest share what is left.
    """
    levels = join_small(levels, sizes.select("_key", "target"), ["_key"]).withColumn("_imp", F.pow(F.lit(2.0), F.col("_level") / _LEVELS))
    w = W.partitionBy("_key").orderBy(F.col("_level").desc())
    capped = F.coalesce(F.sum("_words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("_words") * F.col("_imp")).over(w.rowsBetween(0, W.unboundedFollowing))
    levels = levels.withColumn("_try", F.when(mass > 0, (F.col("target") - p.cap * capped) / mass))
    fits = F.col("_try") * F.col("_imp") <= p.cap * (1 + 1e-12)
    return levels.filter(fits).groupBy("_key").agg(F.max(F.struct("_level", "_try"))["_try"].alias("_scale"))


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def _counted(df: DataFrame, p: Mix, text: str, source: str, row: str) -> DataFrame:
    """df with _row, _key, _size, _level and _u, a random number in (0, 1) of the row's id, text and source."""
    size = word_count(F.col(text))
    wanted = F.greatest(F.coalesce(F.col(p.importance).cast("double"), F.lit(0.0)), F.lit(1e-6)) if p.importance else F.pow(F.greatest(size, F.lit(1)).cast("double"), F.lit(p.length_power))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), F.col(row), F.xxhash64(text), _key(source)), 11) + 0.5) / float(1 << 53)
    return df.withColumns({"_row": F.col(row), "_key": _key(source), "_size": size, "_level": F.round(F.log2(wanted) * _LEVELS).cast("int"), "_u": u})


def _ranked(df: DataFrame, p: Mix) -> DataFrame:
    """df (_counted, with _scale) with _whole, _part_size and _top, the part of the rank that comes of the row's contents."""
    expected = F.least(F.lit(float(p.cap)), F.coalesce(F.col("_scale") * F.pow(F.lit(2.0), F.col("_level") / _LEVELS), F.lit(0.0)))
    df = df.withColumn("_exp", expected)
    df = df.withColumn("_exp", F.when(F.abs(F.col("_exp") - F.round("_exp")) < 1e-9, F.round("_exp")).otherwise(F.col("_exp")))
    df = df.withColumn("_whole", F.floor("_exp").cast("long")).withColumn("_part", F.col("_exp") - F.col("_whole"))
    odds = F.log(F.col("_u") / (1 - F.col("_u"))) - F.log(F.greatest(F.col("_part"), F.lit(1e-12)) / (1 - F.least(F.col("_part"), F.lit(1 - 1e-12))))
    top = F.floor((F.greatest(F.lit(-127.0), F.least(F.lit(127.0), odds)) + 128) * float(1 << (_BITS - _TIE - 8))).cast("long")
    return df.withColumn("_top", top).withColumn("_part_size", F.when(F.col("_part") > 0, F.col("_size")).otherwise(F.lit(0).cast("long")))


def _plan(df: DataFrame, p: Mix, text: str, source: str, row: str, carry: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows, narrow and ranked; per source its scale; per source the stretch where its sample ends."""
    docs = _counted(df, p, text, source, row).select("_row", "_key", "_size", "_level", "_u", F.col(source).alias("_source"), *carry)
    docs = cut(docs.withColumn("_no", F.monotonically_increasing_id()))
    sizes = docs.groupBy("_source", "_key").agg(F.sum("_size").alias("source_size"))
    sizes = cut(targets(sizes, p).drop("_source"))
    levels = cut(docs.groupBy("_key", "_level").agg(F.sum("_size").alias("_words")))
    scales = cut(sizes.join(_scales(levels, sizes, p), "_key", "left"))
    docs = _ranked(join_small(docs, scales, ["_key"]), p)
    rank = F.shiftleft("_top", _TIE).bitwiseOR(F.pmod(F.xxhash64("_no"), F.lit(1 << _TIE)))
    docs = cut(docs.select("_row", "_key", "_no", "_size", "source_size", "target", "_whole", "_part_size", rank.alias("_rank"), *carry))
    region = docs.groupBy("_key").agg((F.max("target") - F.sum(F.col("_whole") * F.col("_size"))).alias("_rem"), F.count("*").alias("_n"))
    region = cut(region.select("_key", F.lit(_BITS).alias("_shift"), F.lit(0).cast("long").alias("_lo"), "_rem", "_n"))
    return docs, scales, _levels(docs, region, p)


def _near(docs: DataFrame, region: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with _extra: those whose ranks lie before or beyond their source's last stretch, and those in it."""
    docs = join_small(docs, region, ["_key"]).withColumn("_at", F.expr("shiftright(_rank, _shift)"))
    far = docs.filter("_at <> _lo").withColumn("_extra", F.when(F.expr("_at < _lo and _part_size > 0"), 1).otherwise(0).cast("long"))
    return far, docs.filter("_at = _lo").groupBy("_key").applyInPandas(_fill, far.schema)


def sample(df: DataFrame, p: Mix = Mix(), text: str = "text", source: str = "source", row: str = "doc_id") -> DataFrame:
    """One row per row of df: row, size, source_size, target, copies, taken (copies times size).

    Null texts have size 0; a null source is a source of its own, the last. Documents without words get no copies beyond
    their whole ones. Null row ids are ids like others. Ranks come of the seed, the row id, its text and its source, so
    reruns agree; repeated rows, alike in all these, are taken as separate documents, in the order they are read. An
    empty table gives an empty result.
    """
    docs, _, region = _plan(df, p, text, source, row, [])
    far, near = _near(docs, region)
    copies = F.col("_whole") + F.col("_extra")
    return far.unionByName(near).select(F.col("_row").alias(row), F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def repeat(df: DataFrame, p: Mix = Mix(), text: str = "text", source: str = "source", row: str = "doc_id") -> DataFrame:
    """The mixture itself: rows of df as often as sample takes them, numbered by `copy` from 0, less than cap.

    Rows before or beyond the last stretch of their source are judged where they lie. Rows in it are found again by 128
    bits of hashes of all columns; rows that are alike in all give their copies together, numbered over again from cap on. A column `copy` of df gives way.
    """
    hashes = {"_h1": F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns]), "_h2": F.xxhash64(F.lit(1), *df.columns, *[F.col(c).isNull() for c in df.columns])}
    whole = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_all"), *[v.alias(k) for k, v in hashes.items()], F.col(text).alias("_text"), F.col(source).alias("_source0"), F.col(row).alias("_row0"),
                      *([F.col(p.importance).alias("_wanted")] if p.importance else []))
    q = replace(p, importance="_wanted") if p.importance else p
    docs, scales, region = _plan(whole, q, "_text", "_source0", "_row0", list(hashes))
    _, near = _near(docs, region)
    taken = cut(near.groupBy(*hashes).agg(F.sum(F.col("_whole") + F.col("_extra")).alias("_own"), F.count("*").alias("_alike")))
    rows = join_small(_counted(whole, q, "_text", "_source0", "_row0"), scales, ["_key"])
    rows = join_small(_ranked(rows, q).select("_all", *hashes, "_key", "_whole", "_part_size", "_top"), region, ["_key"])
    # Of the rank the low bits are missing here: what they would decide goes with the rows of the last stretch.
    rows = rows.withColumn("_at", F.expr(f"shiftright(_top, greatest(_shift - {_TIE}, 0))")).withColumn("_to", F.expr(f"shiftright(_lo, greatest({_TIE} - _shift, 0))"))
    rows = rows.withColumn("_far", F.when(F.expr("_at <> _to"), F.col("_whole") + F.when(F.expr("_at < _to and _part_size > 0"), 1).otherwise(0)))
    low = region.filter(F.col("_shift") < _TIE)
    if not low.isEmpty():  # ends that low bits decide: rows of equal contents may lie on both sides of one
        tied = join_small(docs, low, ["_key"], "inner").withColumn("_at", F.expr("shiftright(_rank, _shift)"))
        tied = tied.filter(F.expr(f"_at <> _lo and shiftright(_rank, {_TIE}) = shiftright(_lo, {_TIE} - _shift)"))
        own = F.col("_whole") + F.when(F.expr("_at < _lo and _part_size > 0"), 1).otherwise(0)
        more = tied.groupBy(*hashes).agg(F.sum(own).alias("_own"), F.count("*").alias("_alike"))
        taken = cut(taken.unionByName(more).groupBy(*hashes).agg(F.sum("_own").alias("_own"), F.sum("_alike").alias("_alike")))
    if taken.limit(_LOOKED_UP + 1).count() <= _LOOKED_UP:  # rows of four numbers: then texts are read once and stay where they are
        rows = rows.join(F.broadcast(taken), list(hashes), "left")
        out = rows.select("_all", *hashes, "_far", F.when(F.col("_far").isNull(), F.col("_alike")).alias("_alike"), F.coalesce("_far", "_own").alias("_own"))
    else:
        near = rows.filter("_far is null").select("_all", *hashes, "_far").join(taken.hint("merge"), list(hashes))
        out = rows.filter("_far is not null").select("_all", *hashes, "_far", F.lit(None).cast("long").alias("_alike"), F.col("_far").alias("_own")).unionByName(near)
    if not taken.filter("_alike > 1").isEmpty():
        many = F.coalesce(F.col("_alike") > 1, F.lit(False))
        out = out.filter(~many).unionByName(out.filter(many).dropDuplicates(list(hashes)))
    out = out.filter("_own > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_own").cast("int") - 1)))
    return out.select(*[F.col("_all")[c].alias(c) for c in df.columns if c != "copy"], (F.col("copy") % p.cap).alias("copy"))
