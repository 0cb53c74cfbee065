"""Generated person images with attribute and query sidecars, as caption pairs with attribute vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators.datasets import numbered
from sparkloom.operators.pairs import SKIPPED, attribute_vector, text_constraints

#: Attributes in the order of their vectors, and how many of them each level of query constrains.
ATTRIBUTES = ["top outer color", "top outer type", "bottom color", "bottom type", "shoe color", "shoe type", "viewpoint"]
LEVELS = {"easy": 4, "medium": 6, "hard": 7}


def vocabulary(value_to_id: dict[str, dict[str, int]]) -> dict[str, dict[str, int]]:
    """The vocabulary with its values normalised; ValueError for what isn't an integer or clashes once normalised."""
    out: dict[str, dict[str, int]] = {}
    for a in ATTRIBUTES:
        if not isinstance(value_to_id.get(a), dict):
            raise ValueError(f"the vocabulary has no {a!r}")
        out[a] = {}
        for value, number in value_to_id[a].items():
            key = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in value.lower()).split())
            if isinstance(number, bool) or not isinstance(number, int):
                raise ValueError(f"{a!r}: {value!r} has no integer")
            if key in out[a]:
                raise ValueError(f"{a!r}: {value!r} comes twice")
            out[a][key] = number
    return out


def resolve(images: DataFrame, people: DataFrame) -> DataFrame:
    """images (split, scene, image) with the record of their sidecar (split, key, record): by `scene/image`, else by scene
    where the sidecar has one record only, else by the one key that ends with the image's name. Others fail."""
    sidecar = people.select("split", "key", "record").join(people.groupBy("split").agg(F.count("*").alias("_records")), "split")
    asked = images.select(F.col("split"), F.struct(*images.columns).alias("_image"))
    image, scene = F.col("_image.image"), F.col("_image.scene")

    def named(rank, ours, theirs, ok=None):
        """Images and records whose names are equal, by an equi-join."""
        hit = asked.withColumn("_name", ours).join((sidecar if ok is None else sidecar.filter(ok)).withColumn("_name", theirs), ["split", "_name"])
        return hit.select("_image", "key", "record", F.lit(rank).alias("_rank"))

    suffix = named(3, text.basename(image), text.basename(F.col("key"))).filter(F.col("key").endswith(F.concat(F.lit("/"), image)) | (F.col("key") == image))
    hit = named(1, F.concat_ws("/", scene, image), F.col("key")).unionAll(named(2, scene, F.col("key"), "_records = 1")).unionAll(suffix)
    # A record that an earlier rule names too isn't counted among the suffixes, as each key counts by its first rule.
    hit = hit.groupBy("_image", "key").agg(F.min_by("record", "_rank").alias("record"), F.min("_rank").alias("_rank"))
    best = hit.groupBy("_image").agg(F.min("_rank").alias("_r"), F.min_by("record", "_rank").alias("record"), F.count_if(F.col("_rank") == 3).alias("_suffixes"))
    return best.filter((F.col("_r") < 3) | (F.col("_suffixes") == 1)).select("_image.*", "record")


def pairs(images: DataFrame, vocab: dict[str, dict[str, int]], policy: str = "all", first_only_splits: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Pairs of images (split, scene, image, attributes map, queries map of arrays) and their captions.

    policy: all levels, or one. Evaluation splits take the first caption of a level. Barefoot without a shoe colour has
    `none`. A value outside the vocabulary fails, as does a level without just three captions.
    """
    if policy not in ("all", *LEVELS):
        raise ValueError(f"policy must be all or one of {list(LEVELS)}")
    bare = F.lower(F.trim(F.coalesce(F.try_element_at("attributes", F.lit("shoe type")), F.lit("")))) == "barefoot"
    attributes = F.when(bare & ~F.map_contains_key("attributes", "shoe color"), F.map_concat("attributes", F.create_map(F.lit("shoe color"), F.lit("none")))).otherwise(F.col("attributes"))
    vector = attribute_vector(attributes, ATTRIBUTES, vocab)
    rows = images.withColumn("image_attr_values", vector)
    whole = F.forall("image_attr_values", lambda x: x.isNotNull())
    rows = rows.withColumn("image_attr_values", F.when(whole, F.col("image_attr_values")).otherwise(F.raise_error(F.concat(F.lit("attributes outside the vocabulary: "), "scene", F.lit("/"), "image")).cast("array<int>")))
    none = F.array(*[F.array(*[F.lit(vocab[a][v]) for v in SKIPPED if v in vocab[a]]).cast("array<int>") for a in ATTRIBUTES])
    parts = []
    for i, (level, width) in enumerate(LEVELS.items()):
        if policy in ("all", level):
            captions = F.try_element_at("queries", F.lit(level))
            three = F.when(F.size(captions) == 3, captions).otherwise(F.raise_error(F.concat(F.lit(f"not three {level} captions: "), "scene")).cast("array<string>"))
            part = rows.select("*", F.posexplode(three).alias("query_index", "caption")).withColumn("query_type", F.lit(level)).withColumn("_level", F.lit(i))
            parts.append(part.withColumn("text_attr_values", text_constraints(F.col("image_attr_values"), F.lit(width), none)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.filter(~F.col("split").isin(*first_only_splits) | (F.col("query_index") == 0)).withColumn("caption", text.strip(F.col("caption")))
    out = numbered(out, ["split", "scene", "image", "_level", "query_index"], "idx", 0)
    return out.select("idx", "split", "scene", "image", "query_type", "query_index", "caption", text.without_augment_suffix(F.col("scene")).alias("person_id"), text.is_augmented(F.col("scene")).alias("is_augmented"), "image_attr_values", "text_attr_values")


def manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of files (path, content): equal manifests mean that a result can be used again."""
    return files.select("path", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def same_manifest(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
