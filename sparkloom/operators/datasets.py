"""Merging, slicing, renumbering and sampling of datasets.

Order matters in these operators, so inputs carry explicit positions; "first" always means least position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions.lineage import cut, small


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by `order` of each key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") == 1).drop("_k")


def merge_records(df: DataFrame, key: str, order: list[str], on_duplicate: str = "error") -> DataFrame:
    """Records of several inputs in order. Equal keys: error (raises), skip (the first wins) or keep (all stay)."""
    if on_duplicate == "keep":
        return df
    if on_duplicate == "skip":
        return first_wins(df, [key], order)
    if on_duplicate != "error":
        raise ValueError(f"on_duplicate must be error, skip or keep, not {on_duplicate!r}")
    twice = df.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {sorted(str(r[0]) for r in twice)}")
    return df


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """df with consecutive numbers by `order`, without sorting all rows in one task.

    Rows are range-partitioned and numbered within partitions; partition sizes, a row each, give the offsets. Equal keys
    of `order` may be numbered either way, so they should be unique. Range bounds come from samples, so the placed rows
    are kept in the checkpoint folder: rows and offsets must be of one placing.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    # The id that Spark gives holds the partition in its upper bits and the row's place in the 33 lower ones.
    local = placed.withColumn("_id", F.monotonically_increasing_id())
    local = cut(local).withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    ends = local.groupBy("_part").agg(F.max("_in").alias("_size"))
    offsets = ends.withColumn("_off", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # Partitions are as many as spark.sql.shuffle.partitions: a broadcast of fixed size.
    out = local.join(F.broadcast(offsets.select("_part", "_off")), "_part")
    return out.withColumn(name, (F.col("_off") + F.col("_in") + (start - 1)).cast("bigint")).drop("_id", "_part", "_in", "_off")


def running(df: DataFrame, by: list[str], order: list, columns: dict[str, tuple[Column, str]]) -> DataFrame:
    """df with running sums or greatest values by `order` within `by`, without sorting a group in one task.

    columns: name to (expression, kind); kind is sum or max, or sum_before or max_before, which leave the row itself out.
    Rows are range-partitioned; each partition runs for itself, and one row for each group in a partition carries on what
    lies before. Rows that are equal in `order` stand in either order, so they should be unique.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    make = {"sum": F.sum, "max": F.max}
    keyed = df.withColumns({f"_v_{k}": c for k, (c, _) in columns.items()})
    keys = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    placed = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    local = cut(placed).withColumn("_part", F.shiftright("_id", 33))
    w = W.partitionBy("_part", *by).orderBy("_id")
    within = {f"_l_{k}": make[kind.split("_")[0]](f"_v_{k}").over(w.rowsBetween(W.unboundedPreceding, -1 if kind.endswith("_before") else 0)) for k, (_, kind) in columns.items()}
    ends = local.groupBy("_part", *by).agg(*[make[kind.split("_")[0]](f"_v_{k}").alias(f"_e_{k}") for k, (_, kind) in columns.items()])
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in by], *[make[kind.split("_")[0]](f"_e_{k}").over(before).alias(f"_b_{k}") for k, (_, kind) in columns.items()])
    same = [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]]
    out = local.withColumns(within).join(small(ends), same, "left")
    both = {k: (F.coalesce(F.col(f"_b_{k}") + F.col(f"_l_{k}"), F.col(f"_b_{k}"), F.col(f"_l_{k}")) if kind.startswith("sum") else F.greatest(f"_b_{k}", f"_l_{k}")).alias(k) for k, (_, kind) in columns.items()}
    return out.select(*[c for c in df.columns if c not in both], *both.values())


def merge_renumbered(parts: list[DataFrame], old: str, new: str) -> DataFrame:
    """Tables one after the other, with new ids from 1 in the order of (input, old id), and `src`, the input's number."""
    both = reduce(DataFrame.unionByName, [p.withColumn("src", F.lit(i).cast("bigint")) for i, p in enumerate(parts)])
    return numbered(both, ["src", old], new)


def same_categories(parts: list[DataFrame], columns: list[str]) -> None:
    """ValueError unless all tables of categories are equal."""
    for i, p in enumerate(parts[1:], 2):
        a, b = parts[0].select(*columns), p.select(*columns)
        if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
            raise ValueError(f"input {i} has other categories than the first")


def merge_grouped(df: DataFrame, key: str, order: list[str], region: Column) -> DataFrame:
    """Per key, the regions of all inputs as one array, in order. Within an input the last record of a key counts."""
    rows = df.withColumn("_r", region)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_r"))), lambda s: s["_r"]).alias("regions"))


def update_records(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Records of both sides; a field that right has (not null) replaces left's."""
    fields = [c for c in dict.fromkeys(left.columns + right.columns) if c != key]
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != key])
    joined = left.join(r, key, "full_outer")
    value = lambda c: F.coalesce(*([F.col(f"_r_{c}")] if c in right.columns else []), *([F.col(c)] if c in left.columns else []))
    return joined.select(key, *[value(c).alias(c) for c in fields])


def latest_step(df: DataFrame, key: str, step: str, values: list[str]) -> DataFrame:
    """Per key, for each value the one of the latest step that has it."""
    return df.groupBy(key).agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(step))).alias(v) for v in values])


def slice_regex(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose column matches any pattern from its begin."""
    return df.filter(F.col(column).rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"))


def slice_categories(images: DataFrame, annotations: DataFrame, included: list[str], excluded: list[str]) -> tuple[DataFrame, DataFrame]:
    """Images with an annotation of a wanted category, and those annotations, both renumbered from 1.

    Wanted: included (all if empty) without excluded. images: image_id; annotations: ann_id, image_id, category.
    """
    wanted = ~F.col("category").isin(excluded) if excluded else F.lit(True)
    if included:
        wanted = wanted & F.col("category").isin(included)
    anns = annotations.filter(wanted)
    kept = numbered(images.join(anns.select("image_id").distinct(), "image_id", "left_semi"), ["image_id"], "new_image_id")
    anns = anns.join(kept.select("image_id", "new_image_id"), "image_id")
    return kept, numbered(anns, ["new_image_id", "ann_id"], "new_ann_id")


def hash_rank(key: Column) -> Column:
    """A spread-out number for an integer key, the same in any SQL engine."""
    return F.pmod(key * F.lit(2654435761).cast("bigint"), F.lit(4294967296).cast("bigint"))


def random_split(df: DataFrame, key: str, fraction: float) -> tuple[DataFrame, DataFrame]:
    """floor(fraction * n) rows chosen by hash_rank(key), and the others."""
    ranked = numbered(df.withColumn("_h", hash_rank(F.col(key))), ["_h", key], "_rn")
    n = int(fraction * df.count())
    return ranked.filter(F.col("_rn") <= n).drop("_rn", "_h"), ranked.filter(F.col("_rn") > n).drop("_rn", "_h")


def random_parts(df: DataFrame, key: str, k: int) -> DataFrame:
    """df with part, 0 to k - 1: rows in order of hash_rank, ceil(n / k) to a part."""
    size = max(1, -(-df.count() // k))
    ranked = numbered(df.withColumn("_h", hash_rank(F.col(key))), ["_h", key], "_rn")
    return ranked.withColumn("part", F.floor((F.col("_rn") - 1) / size).cast("bigint")).drop("_rn", "_h")


def stratified_sample(df: DataFrame, strata: list[str], key: str, fraction: float) -> DataFrame:
    """max(1, floor(n * fraction)) rows of each stratum by hash_rank; all for a fraction of 1 and more.

    Strata are counted first; then only rows whose hash is low enough to be taken are ranked.
    """
    if fraction <= 0:
        raise ValueError("fraction must be above 0")
    if fraction >= 1:
        return df
    counted = df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in strata]).agg(F.count("*").alias("_n"))
    counted = counted.withColumn("_want", F.greatest(F.lit(1), F.floor(F.col("_n") * fraction)))
    # Hashes are spread evenly, so what a stratum takes lies under this bound, but for chances that are looked up below.
    bound = F.least(F.lit(1.0), (F.col("_want") + 8 * F.sqrt("_want") + 24) / F.col("_n")) * float(1 << 32)
    counted = cut(counted.withColumn("_bound", bound))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in strata]
    rows = df.join(small(counted), same)
    near = rows.filter(hash_rank(F.col(key)) < F.col("_bound"))
    got = near.groupBy(*[F.col(f"_g_{c}").alias(f"_s_{c}") for c in strata]).agg(F.count("*").alias("_got"))
    equal = [F.col(f"_g_{c}").eqNullSafe(F.col(f"_s_{c}")) for c in strata]
    lacking = counted.join(got, equal, "left").filter(F.coalesce(F.col("_got"), F.lit(0)) < F.col("_want"))
    lacking = cut(lacking.select(*counted.columns))
    if not lacking.isEmpty():
        named = lacking.select(*[F.col(f"_g_{c}").alias(f"_s_{c}") for c in strata])
        near = near.join(small(named), equal, "left_anti").unionByName(df.join(small(lacking), same))
    w = W.partitionBy(*strata).orderBy(hash_rank(F.col(key)), key)
    return near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.col("_want")).select(*df.columns)


def contiguous(df: DataFrame, category: str, present: DataFrame | None = None) -> DataFrame:
    """(category, new_id): the categories in use, numbered from 0 in their order."""
    used = (present if present is not None else df).select(category).distinct()
    return numbered(used, [category], "new_id", 0)


def appearance_ids(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, new_id): keys numbered from 0 by their first row."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return numbered(first, ["_first"], "new_id", 0).drop("_first")


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without an output yet: what a resumed run has to do."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def modulo_parts(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return numbered(df, order, "_rn", 0).withColumn("part", F.pmod("_rn", F.lit(n)).cast("bigint")).drop("_rn")


def repeated(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.limit(0).withColumn("copy", F.lit(0))


def record_ids(df: DataFrame, order: list[str], prefix: str = "expr", digits: int = 5) -> DataFrame:
    """df with ids such as expr_00000, by order."""
    return numbered(df, order, "_rn", 0).withColumn("record_id", F.format_string(f"{prefix}_%0{digits}d", F.col("_rn"))).drop("_rn")


def group_classes(df: DataFrame, groups: dict[str, list[str]], column: str = "type") -> DataFrame:
    """df with child classes (in any case) named as their parent; other classes stay."""
    low, out = F.lower(F.col(column)), None
    for parent, children in groups.items():
        hit = low.isin([c.lower() for c in children])
        out = F.when(hit, parent) if out is None else out.when(hit, parent)
    return df if out is None else df.withColumn(column, out.otherwise(F.col(column)))


def split_folders(names: set[str]) -> dict[str, str]:
    """Folders of a split data set by the split they make: train is needed, val may be there, and one of eval and test."""
    if "train" not in names:
        raise ValueError("a split data set needs a train folder")
    if {"eval", "test"} <= names:
        raise ValueError("a split data set has eval or test, not both")
    return {("test" if n == "eval" else n): n for n in ("train", "val", "eval", "test") if n in names}


def with_metadata(rows: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """rows with the metadata of their key, nulls where there is none; a key that metadata has twice doubles the row."""
    return rows.join(metadata, key, "left")


def selected(pairs: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows of pairs whose key a sample has, each once, whatever the sample repeats."""
    return pairs.join(sample.select(key).distinct(), key, "left_semi")


def entry_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("entries"))


def no_longer_than(df: DataFrame, length: str, most: float) -> DataFrame:
    """Rows of at most that length, and those of which none is known."""
    return df.filter(F.col(length).isNull() | (F.col(length) <= most))


def listed_images(df: DataFrame, path: str, labels: str | None, skip_empty: bool = True) -> DataFrame:
    """Rows whose path ends as an image's name does; with skip_empty, those without labels (an array) go."""
    rows = df.filter(F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin("jpg", "jpeg", "png"))
    return rows.filter(F.size(labels) > 0) if labels and skip_empty else rows
