"""Image and caption pairs for search by attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions import text
from sparkloom.functions.lineage import small
from sparkloom.operators.datasets import first_wins, numbered, stratified_sample

SKIPPED = ("missing", "not visible")


#: Different sets of attribute names that queries may ask for; an image is indexed under each.
NAME_SETS = 5_000
#: Tasks that share the queries of one set of names and values.
SPREAD = 8


def signature(attributes: Column, names: Column) -> Column:
    """Sorted names with their values ('' where there is none), as one text key."""
    return F.to_json(F.transform(F.array_sort(names), lambda n: F.struct(n.alias("n"), F.coalesce(F.try_element_at(attributes, n), F.lit("")).alias("v"))))


def _asked(queries: DataFrame) -> DataFrame:
    """queries with _names and _sig, the names and values that images must have, and _need, the accessories."""
    keys = F.filter("names", lambda n: n != "accessories")
    q = queries.withColumn("_names", F.array_sort(keys)).withColumn("_sig", signature(F.col("attributes"), F.col("_names")))
    own = F.filter(F.split(F.coalesce(F.try_element_at("attributes", F.lit("accessories")), F.lit("")), r"\s*,\s*"), lambda a: a != "")
    last = lambda a: F.element_at(F.split(a, " "), -1)
    low = F.lower("text")
    need = F.filter(own, lambda a: low.contains(F.lower(a)) | low.contains(F.lower(last(a))))
    need = F.transform(need, lambda a: F.when(low.contains(F.lower(a)), a).otherwise(last(a)))
    return q.withColumn("_need", F.when(F.array_contains("names", "accessories"), need).otherwise(F.array().cast("array<string>")))


def _indexed(images: DataFrame, asked: DataFrame) -> DataFrame:
    """images with _has, their accessories, and _sig for each set of names that is asked for."""
    sets = [r[0] for r in asked.select("_names").distinct().limit(NAME_SETS + 1).collect()]
    if len(sets) > NAME_SETS:
        raise ValueError(f"queries ask for more than {NAME_SETS} different sets of attributes")
    every = F.array(*[F.array(*[F.lit(n) for n in names]).cast("array<string>") for names in sets]).cast("array<array<string>>")
    index = images.withColumn("_has", F.coalesce(F.try_element_at("attributes", F.lit("accessories")), F.lit("")))
    return index.withColumn("_names", F.explode(every)).withColumn("_sig", signature(F.col("attributes"), F.col("_names")))


_WORN = "forall(_need, a -> contains(lower(_has), lower(a)))"


def attribute_pairs(queries: DataFrame, images: DataFrame) -> DataFrame:
    """(query_id, image_id) of all images whose attributes answer a query.

    queries: query_id, names (array), attributes (map), text; images: image_id, attributes (map). Only the sets of names
    that occur in queries are indexed. Where names have `accessories`, the other names are the key, and each of the
    query's own accessories (`colour item`) that its text names, in full or by item, must be among the image's.
    """
    q = _asked(queries)
    index = _indexed(images, q).select("image_id", "_sig", "_has")
    q = q.select("query_id", "_sig", "_need")
    # Most pairs need no look at accessories; the others are told by what is needed and had, not pair by pair.
    # The few and narrow rows of a key make very many pairs: queries of a key are dealt to SPREAD tasks, which Spark leaves apart.
    n = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), SPREAD)
    deal = lambda df, part: df.withColumn("_part", part).repartition(n, "_sig", "_part")
    plain = deal(q.filter("size(_need) = 0").select("query_id", "_sig"), F.pmod(F.xxhash64("query_id"), F.lit(SPREAD)).cast("int"))
    plain = plain.join(deal(index.select("image_id", "_sig"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["_sig", "_part"])
    asks = q.filter("size(_need) > 0")
    worn = asks.select("_sig", "_need").distinct().join(index.select("_sig", "_has").distinct(), "_sig").filter(_WORN)
    rest = asks.join(worn, ["_sig", "_need"]).join(index, ["_sig", "_has"])
    return plain.select("query_id", "image_id").unionAll(rest.select("query_id", "image_id"))


def admitted(df: DataFrame, rules: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Rows whose dataset a split admits; rules: split to ('except' or 'only', datasets). Other splits admit all."""
    ok = F.lit(True)
    for split, (mode, names) in rules.items():
        listed = F.col("dataset").isin(names)
        ok = F.when(F.col("split") == split, listed if mode == "only" else ~listed).otherwise(ok)
    return df.filter(ok).filter(~F.col("dataset").endswith("_Aug") | F.col("query_type").isin("easy", "medium", "hard"))


def finish(pairs: DataFrame, val_fraction: float = 0.1, key: str = "pair_id") -> DataFrame:
    """Captions trimmed, empty ones dropped, first of equal (split, image, caption) kept, `val` sampled by strata."""
    pairs = pairs.withColumn("caption", text.strip(F.col("caption"))).filter("caption <> ''")
    pairs = first_wins(pairs, ["split", "image_path", "caption"], [key])
    val = stratified_sample(pairs.filter("split = 'val'"), ["dataset", "query_type"], key, val_fraction)
    return pairs.filter("split <> 'val'").unionByName(val)


def attribute_vector(attributes: Column, names: list[str], vocab: dict[str, dict[str, int]]) -> Column:
    """Ids of an entry's attribute values by vocabulary; null where a value isn't in it."""
    maps = {n: F.create_map(*[x for k, v in vocab[n].items() for x in (F.lit(k), F.lit(v))]) for n in names}
    return F.array(*[F.try_element_at(maps[n], text.token_key(F.try_element_at(attributes, F.lit(n)))) for n in names])


def text_constraints(vector: Column, width: Column, unconstrained: Column) -> Column:
    """vector with -1 from `width` on and for ids that stand for no constraint (an array of arrays, by place)."""
    return F.transform(vector, lambda x, i: F.when((i >= width) | F.array_contains(F.get(unconstrained, i), x), F.lit(-1)).otherwise(x))


def lacking_text(entries: DataFrame, by: list[str], text_column: str, shown: int = 5) -> DataFrame:
    """Per group, how many entries have no text of their own, and the first few of their ids."""
    none = entries.filter(F.coalesce(F.trim(text_column) == "", F.lit(True)))
    counts = none.groupBy(*by).agg(F.count("*").alias("cnt"))
    few = none.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy("id"))).filter(F.col("_k") <= shown)
    return counts.join(few.groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("ids")), by)


def output_names(pairs: DataFrame, order: list[str], extension: str = ".jpg") -> DataFrame:
    """pairs with idx from 0 within their split, by order, and name `<split>_<idx of eight digits><extension>`.

    The extension is the image's own where it has one.
    """
    rows = numbered(pairs, ["split", *order], "_n", 0)
    first = rows.groupBy("split").agg(F.min("_n").alias("_first"))
    rows = rows.join(small(first), "split").withColumn("idx", F.col("_n") - F.col("_first"))
    own = F.regexp_extract("image_path", r"(\.[A-Za-z0-9]+)$", 1)
    return rows.withColumn("name", F.concat("split", F.lit("_"), F.format_string("%08d", "idx"), F.when(own == "", extension).otherwise(own))).drop("_n", "_first")


def caption_classes(pairs: DataFrame) -> DataFrame:
    """Distinct captions of evaluation splits, sorted: the names of retrieval classes."""
    return pairs.filter(F.col("split").isin("val", "test")).select("split", "caption").distinct().orderBy("split", "caption")


def build(queries: DataFrame, images: DataFrame, rules: dict[str, tuple[str, list[str]]], val_fraction: float = 0.1) -> DataFrame:
    """Caption pairs in one call: images that answer a query, admitted by split, trimmed, first of equal ones, val sampled.

    queries: query_id, names, attributes, text, query_type; images: image_id, image_path, split, dataset, attributes. The
    result has pair_id (`query-image`), split, image_path, caption, dataset, query_type.
    """
    # Queries of equal texts and needs are answered by the same images, and images of one path by their attributes; a pair
    # of the least ids of both is the first of all that are equal, so that only those need to meet.
    padded = lambda c: F.min(F.lpad(F.col(c).cast("string"), 12, "0"))
    q = _asked(queries.withColumn("caption", text.strip(F.col("text"))).filter("query_id is not null and caption <> ''"))
    index = _indexed(images.filter("image_id is not null"), q).groupBy("_sig", "_has", "split", "image_path", "dataset").agg(padded("image_id").alias("_image"))
    q = q.groupBy("_sig", "_need", "query_type", "caption").agg(padded("query_id").alias("_query"))
    rows = q.join(index, "_sig").filter(F.expr(f"size(_need) = 0 or {_WORN}"))
    key = F.concat_ws("-", "_query", "_image").alias("pair_id")
    return finish(admitted(rows.select(key, "split", "image_path", "caption", "dataset", "query_type"), rules), val_fraction)
