"""Readers of annotation, record and table files. Every reader has an explicit schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import basename, stem, strip

#: The fields of a label line, in order; predictions add the last.
LABEL_FIELDS = [
    "type", "truncated", "occluded", "alpha", "bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax", "dim_height", "dim_width", "dim_length",
    "loc_x", "loc_y", "loc_z", "rotation_y", "conf_score",
]
_COCO = """images array<struct<id: bigint, file_name: string, filepath: string, file_path: string, height: int, width: int>>,
    annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, bbox: array<double>, area: double, iscrowd: int, score: double>>,
    categories array<struct<id: bigint, name: string>>"""
_ODVG = """image_id bigint, file_name string, height int, width int,
    detection struct<instances: array<struct<bbox: array<double>, label: int, category: string>>>,
    grounding struct<caption: string, regions: array<struct<bbox: array<double>, phrase: string>>>"""
_QA = "id string, video_path string, question string, answer string"
_LLAVA = "id string, video string, conversations array<struct<`from`: string, value: string>>"
_GAP = "label string, siamese_score double, input_path string, object_name string"
_ANSWERS = "video_id string, response string, gt string, question string"


def label_lines(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Label files: one row a line with its file, place, fields (null where not a number) and n_fields; blank lines go."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "value")
    parts = F.split(F.trim("value"), " ")
    field = lambda i: F.get("_p", i)
    typed = [field(0).alias("type")] + [field(i).try_cast("int" if n == "occluded" else "double").alias(n) for i, n in enumerate(LABEL_FIELDS) if i]
    rows = lines.filter(F.trim("value") != "").withColumn("_p", parts)
    return rows.select("file", stem(F.col("file")).alias("stem"), "pos", F.size("_p").alias("n_fields"), *typed, F.split(F.trim("value"), r"\s+").alias("tokens"))


def is_label(df: DataFrame) -> Column:
    """Whether a row of label_lines has 15 or 16 fields that parse."""
    ok = F.col("n_fields").isin(15, 16)
    for n in LABEL_FIELDS[1:15]:
        ok = ok & F.col(n).isNotNull()
    return ok & ((F.col("n_fields") == 15) | F.col("conf_score").isNotNull())


def boxes_by_stem(lines: DataFrame, with_scores: bool = False) -> DataFrame:
    """(stem, type, x, y, w, h, [score]) of lines with nine tokens, parted by any white space, and a whole box; `dontcare` in
    any case goes; a score (the sixteenth token) that is no number is null. No line at all raises."""
    if lines.isEmpty():
        raise ValueError("no label lines")
    rows = lines.filter((F.size("tokens") >= 9) & (F.lower(F.get("tokens", 0)) != "dontcare"))
    x1, y1, x2, y2 = (F.get("tokens", F.lit(i)).try_cast("double") for i in range(4, 8))
    score = [F.get("tokens", F.lit(15)).try_cast("double").alias("score")] if with_scores else []
    rows = rows.select("stem", F.get("tokens", 0).alias("type"), x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"), *score)
    return rows.dropna(subset=["x", "y", "w", "h"])


def corner_labels(lines: DataFrame) -> DataFrame:
    """(stem, pos, type, box) of lines with eight tokens: corners cut to whole numbers."""
    box = F.array(*[F.get("tokens", F.lit(i)).try_cast("double").cast("int") for i in range(4, 8)])
    return lines.filter(F.size("tokens") >= 8).select("stem", "pos", F.get("tokens", 0).alias("type"), box.alias("box")).filter("not exists(box, x -> x is null)")


def line_errors(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(line, reason) of JSON lines of a file that don't parse or lack a field, by line number; blank lines count as lines only."""
    from sparkloom.operators.datasets import numbered

    lines = numbered(spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()), ["_at"], "line")
    parsed = F.from_json("value", ", ".join(f"`{c}` string" for c in required) + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.filter(F.trim("value") != "").select("line", parsed.alias("r"))
    lacking = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"r.`{c}`").isNull(), c) for c in required])), ", ")
    reason = F.when(F.col("r._bad").isNotNull(), "not JSON").when(lacking != "", F.concat(F.lit("lacks "), lacking))
    return rows.select("line", reason.alias("reason")).filter("reason is not null")


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images (image_path) and label rows joined by stem; label rows alone where there are no images."""
    if images.isEmpty():
        return labels.withColumn("image_path", F.lit(None).cast("string"))
    return labels.join(images.select(stem(F.col("image_path")).alias("stem"), "image_path"), "stem")


#: Lines around the lists of a COCO file that has a line for each row; the first tells this layout.
COCO_HEADS = ('{"layout":"a line for each row","images":[', '],"annotations":[', '],"categories":[')
COCO_END = "]}"


def _coco_lists(spark: SparkSession, path: str) -> list[DataFrame]:
    """Rows of images (i), annotations (a) and categories (c) of COCO files.

    A single file that `writers.coco_json` laid out is read by lines, its parts by many tasks; others as one value a file.
    """
    lines, names = spark.read.text(path), ("images", "annotations", "categories")
    head = lines.first() if len(lines.inputFiles()) == 1 else None
    if head is None or head[0] != COCO_HEADS[0]:
        raw = spark.read.schema(_COCO).option("multiLine", "true").option("mode", "FAILFAST").json(path)
        return [raw.select(F.explode(n).alias(n[0])) for n in names]
    if lines.filter(F.col("value") == COCO_END).isEmpty():
        raise ValueError(f"{path} ends before its lists do")
    schema, out = spark.createDataFrame([], _COCO).schema, []
    row, blanks = ~F.col("value").isin(*COCO_HEADS, COCO_END), F.length(F.regexp_extract("value", r"^,?( *)", 1))
    for i, n in enumerate(names):
        # The condition stands inside too, as Spark may move what is made of a row before a filter.
        own = row & (blanks == i)
        one = F.from_json(F.when(own, F.ltrim(F.col("value"), F.lit(", "))), schema[n].dataType.elementType, {"mode": "FAILFAST"})
        out.append(lines.filter(own).select(one.alias(n[0])))
    return out


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of COCO files. Annotations of unknown images or categories, or without four
    box numbers, go; the path is the first of file_name, filepath, file_path that isn't empty. Bad JSON fails."""
    i, a, c = _coco_lists(spark, path)
    path_of = F.coalesce(*[F.nullif(F.col(f"i.{c}"), F.lit("")) for c in ("file_name", "filepath", "file_path")])
    images = i.select(F.col("i.id").alias("image_id"), path_of.alias("file_name"), "i.height", "i.width")
    categories = c.select(F.col("c.id").alias("category_id"), F.col("c.name").alias("type"))
    anns = a.filter(F.size("a.bbox") == 4).select(F.col("a.id").alias("ann_id"), "a.image_id", "a.category_id", *[F.col("a.bbox")[i].alias(n) for i, n in enumerate("xywh")], "a.area", "a.iscrowd", "a.score")
    return images, anns.join(images.select("image_id"), "image_id", "left_semi").join(categories.select("category_id"), "category_id", "left_semi"), categories


def coco_boxes(images: DataFrame, annotations: DataFrame, categories: DataFrame, with_scores: bool = False) -> DataFrame:
    """Corner boxes with class, image name and size; areas from width and height."""
    rows = annotations.join(images, "image_id").join(categories, "category_id")
    score = [F.col("score").alias("conf_score")] if with_scores else []
    return rows.select("type", F.col("x").alias("bbox_xmin"), F.col("y").alias("bbox_ymin"), (F.col("x") + F.col("w")).alias("bbox_xmax"), (F.col("y") + F.col("h")).alias("bbox_ymax"), F.col("file_name").alias("image_name"), F.col("width").alias("img_width"), F.col("height").alias("img_height"), (F.col("w") * F.col("h")).alias("bbox_area"), *score)


def single_basenames(images: DataFrame) -> DataFrame:
    """(base, file_name) for file names that are one file's only."""
    named = images.select(basename(F.col("file_name")).alias("base"), "file_name").distinct()
    return named.groupBy("base").agg(F.min("file_name").alias("file_name"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")


def odvg(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ODVG).json(path)


def tolerant_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def question_answers(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of questions and answers; a line that doesn't parse or lacks a field fails the read."""
    rows = spark.read.schema(_QA).option("mode", "FAILFAST").json(path)
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a record has no {c}")).cast("string")).alias(c)
    return rows.select(*[need(c) for c in rows.columns])


def llava(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of several files in order, with src and pos."""
    parts = [spark.read.schema(_LLAVA).option("multiLine", "true").json(p).withColumn("src", F.lit(i)).withColumn("pos", F.monotonically_increasing_id()) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inference_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_GAP).option("header", "true").csv(path)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of predictions; response and gt must be there."""
    rows = spark.read.schema(_ANSWERS).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a record has no {c}")).cast("string")).alias(c)
    return rows.select("video_id", need("response"), need("gt"), "question")


def embeddings(spark: SparkSession, path: str, vector: str = "embedding", others: str = "") -> DataFrame:
    """A Parquet file or folder of (filepath, vector, ...). Columns other than these are named in a DDL string."""
    return spark.read.schema(f"filepath string, `{vector}` array<float>" + (f", {others}" if others else "")).parquet(path)


def videos(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of videos under a folder, whatever its depth."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{mp4,avi,mov,mkv,MP4,AVI,MOV,MKV}").load(folder)
    return found.select("path", "length")


def videos_from_records(spark: SparkSession, path: str, keep: str | None = None) -> DataFrame:
    """Video paths of JSON lines (`video_path`, else `video`), of records whose field `keep` is true if one is named."""
    schema = "video_path string, video string" + (f", `{keep}` boolean" if keep else "")
    rows = tolerant_records(spark, path, schema)
    rows = rows.filter(F.coalesce(F.col(keep), F.lit(False))) if keep else rows
    return rows.select(F.coalesce(F.nullif("video_path", F.lit("")), "video").alias("video")).filter("video is not null")


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """(raw, canonical) of a flat YAML mapping, a line for each class (`raw: canonical`); comments and blank lines go."""
    plain = F.regexp_replace("value", r"(^|\s)#.*$", "")
    bare = lambda c: F.regexp_replace(strip(c), "^[\"']|[\"']$", "")
    rows = spark.read.text(path).select(bare(F.regexp_extract(plain, r"^([^:]*):", 1)).alias("raw"), bare(F.regexp_extract(plain, r"^[^:]*:(.*)$", 1)).alias("canonical"))
    return rows.filter("raw <> '' and canonical <> ''")


def discovered_classes(rows: DataFrame, column: str = "type") -> DataFrame:
    """The map of a data set without one: every class to itself."""
    return rows.select(F.col(column).alias("raw"), F.col(column).alias("canonical")).distinct()


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "labels": label_lines, "coco": lambda spark, path: coco_boxes(*coco(spark, path)), "llava": llava, "odvg": odvg, "qa": question_answers, "inference": inference_csv, "answers": answers, "embeddings": embeddings,
}


def load(spark: SparkSession, path: str, declared: str) -> DataFrame:
    """The table of a declared format; formats are never guessed from names."""
    if declared not in READERS:
        raise ValueError(f"format must be one of {sorted(READERS)}, not {declared!r}")
    return READERS[declared](spark, path)
