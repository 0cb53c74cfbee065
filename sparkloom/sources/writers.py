"""Writers. All go through Spark's commit protocol, so a lost executor leaves no half-written result."""

from __future__ import annotations

import contextlib
import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import files
from sparkloom.sources.readers import COCO_END, COCO_HEADS, LABEL_FIELDS


def valid_invalid_csv(df: DataFrame, folder: str) -> None:
    """Rows of a classified table, in valid/ and invalid/, without their area."""
    plain = df.drop("bbox_area")
    ok = F.col("status").isin("VALID", "GOOD_TO_CORRECT")
    plain.filter(ok).write.mode("overwrite").option("header", "true").csv(f"{folder}/valid")
    plain.filter(~ok).write.mode("overwrite").option("header", "true").csv(f"{folder}/invalid")


def label_files(df: DataFrame, folder: str) -> DataFrame:
    """A label file for each stem, its lines in order of pos; two digits for numbers, zeros for fields that df lacks. Returns the manifest."""
    number = lambda n: F.format_string("%.2f", F.col(n).cast("double")) if n in df.columns else F.lit("0.00")
    whole = F.col("occluded").cast("int").cast("string") if "occluded" in df.columns else F.lit("0")
    line = [F.col("type")] + [whole if n == "occluded" else number(n) for n in LABEL_FIELDS[1:15]]
    if "conf_score" in df.columns:
        line.append(F.format_string("%.2f", "conf_score"))
    rows = df.select("stem", F.struct("pos", F.concat_ws(" ", *line).alias("line")).alias("l"))
    lines = F.transform(F.array_sort(F.collect_list("l")), lambda x: F.concat(x["line"], F.lit("\n")))  # one image's labels
    return files.texts(rows.groupBy("stem").agg(F.array_join(lines, "").alias("content")).select(F.concat("stem", F.lit(".txt")).alias("path"), "content"), folder)


def coco_json(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """One COCO object in one file, a line for each row, in order of ids, so that `readers.coco` can read parts of the file.

    Tasks write the lines to a folder beside it; the driver puts their bytes together and holds none but the present ones.
    """
    box = annotations.select(F.col("ann_id").alias("id"), "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), "area", "iscrowd")
    parts = [
        images.select(F.col("image_id").alias("id"), "file_name", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width")),
        box,
        categories.select(F.col("category_id").alias("id"), F.col("type").alias("name")),
    ]
    folder = f"{path}.rows-{uuid.uuid4().hex}"

    def pieces():
        for i, (rows, head) in enumerate(zip(parts, COCO_HEADS)):
            yield head + "\n"
            # Blanks before a row tell its list; a comma goes before all but the first.
            line = F.concat(F.lit("," + " " * i), F.to_json(F.struct(*rows.columns)))
            for k, piece in enumerate(files.lines(rows.select("id", line.alias("l")), ["id"], f"{folder}/{i}")):
                yield piece[1:] if k == 0 else piece
        yield COCO_END + "\n"

    try:
        files.stream(pieces(), path)
    finally:
        gone = annotations.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        gone.getFileSystem(annotations.sparkSession._jsc.hadoopConfiguration()).delete(gone, True)


def json_array(df: DataFrame, path: str, order: list[str], drop: list[str] | None = None) -> None:
    """The rows of df as one JSON array, in order, without the columns drop."""
    files.stream(files.joined(files.json_rows(df, order, drop), "[", "]"), path)


#: Columns of the table of key figures.
KPI_COLUMNS = {"sequence": "Sequence Name", "tp": "TP", "fp": "FP", "fn": "FN", "tn": "TN", "pr": "Pr", "re": "Re", "acc": "Acc", "ap": "AP"}


def kpi_csv(rows: DataFrame, path: str) -> None:
    """Key figures by sequence as one CSV file, the Summary last."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.array_join(F.array(*[F.when(cell(c).rlike('[",\n]'), F.concat(F.lit('"'), F.replace(cell(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell(c)) for c in KPI_COLUMNS]), ",")
    ordered = rows.orderBy((F.col("sequence") == "Summary"), "sequence", "type").select(line.alias("l"))
    files.stream((x + "\n" for x in [",".join(KPI_COLUMNS.values()), *(r[0] for r in ordered.toLocalIterator())]), path)


def mining_result(found: DataFrame, report: dict[str, int], folder: str) -> None:
    """Mined sources as Parquet, and their counters as lines of a text."""
    found.write.mode("overwrite").parquet(f"{folder}/mined.parquet")
    files.stream((x + "\n" for x in ["Summary:", *[f"  {k}: {v}" for k, v in report.items()]]), f"{folder}/summary.txt")


def matching_result(rounds: list[DataFrame], summary: dict, folder: str) -> None:
    """Rounds of a matching as a Parquet folder each and all together, with their summary as JSON."""
    whole = None
    for i, r in enumerate(rounds, 1):
        r.write.mode("overwrite").parquet(f"{folder}/iteration_{i}.parquet")
        whole = r if whole is None else whole.unionByName(r)
    if whole is not None:
        whole.write.mode("overwrite").parquet(f"{folder}/matched.parquet")
    files.stream([json.dumps(summary, sort_keys=True)], f"{folder}/summary.json")


def gap_report(cases: DataFrame, folder: str) -> bool:
    """Wrong answers as JSON lines and a table of their counts; nothing is written where there are none."""
    n = {r[0]: r[1] for r in cases.groupBy("error_type").count().collect()}
    if not n:
        return False
    cases.write.mode("overwrite").json(f"{folder}/gaps")
    # Heads and descriptions of the report.
    rows = [("Error Type", "Count", "Description"), ("FP", str(n.get("FP", 0)), "model said yes, ground truth no"), ("FN", str(n.get("FN", 0)), "model said no, ground truth yes"), ("Total", str(sum(n.values())), "")]
    wide = [max(len(r[i]) for r in rows) for i in range(3)]
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    lines = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, wide)) + " |" for r in rows]
    files.stream([x + "\n" for x in ["KPI Gaps Report (binary ground truth: yes/no)", rule, lines[0], rule, *lines[1:], rule]], f"{folder}/report.txt")
    return True


def task_envelopes(items: DataFrame, folder: str, format_version: str, date: str, license: str = "", media_root: str | None = None, descriptions: dict[str, str] | None = None) -> list[str]:
    """A file of one JSON object for each task that has items (task, ...); their names. Items are streamed in order of video and question."""
    tasks = sorted(r[0] for r in items.select("task").distinct().collect())
    for task in tasks:
        head = {"format": format_version, "metadata": {"type": "annotation", "task": task, "date": date, "description": (descriptions or {}).get(task, ""), "license": license}, "media_root": media_root}
        rows = files.json_rows(items.filter(F.col("task") == task), ["video_id", "question"], ["task"])
        files.stream(files.joined(rows, json.dumps(head)[:-1] + ', "items": [', "]}"), f"{folder}/{task}.json")
    return tasks


@contextlib.contextmanager
def staged(spark: SparkSession, target: str):
    """A folder to write to that takes target's place when all is written; target stays as it was if anything fails."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    new, old = f"{target}.new-{mark}", f"{target}.old-{mark}"
    store.mkdirs(path(new))
    try:
        yield new
        had = store.exists(path(target))
        if had and not store.rename(path(target), path(old)):
            raise OSError(f"{target} can't be moved away")
        if not store.rename(path(new), path(target)):
            if had:
                store.rename(path(old), path(target))
            raise OSError(f"{new} can't take the place of {target}")
        if had:
            store.delete(path(old), True)
    finally:
        store.delete(path(new), True)


def status(path: str, name: str, state: str, message: str = "", data: dict | None = None) -> None:
    """Append a line of JSON on a run's state (STARTED, RUNNING, SUCCESS, FAILURE) to a local file of the driver's."""
    now = datetime.datetime.now()
    line = {"date": f"{now.month}/{now.day}/{now.year}", "time": f"{now.hour}:{now.minute}:{now.second}", "status": state, "component": name, "message": message, **({"data": data} if data else {})}
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(line) + "\n")


def odvg(records: DataFrame, names: DataFrame, folder: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{folder}/records")
    names.select(F.col("label").cast("string").alias("label"), "category").write.mode("overwrite").json(f"{folder}/labelmap")


def task_folders(items: DataFrame, folder: str, task: str = "task") -> None:
    """A folder of JSON lines for each task that has items."""
    items.write.mode("overwrite").partitionBy(task).json(folder)


def records(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def parquet(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partitions or [])).parquet(path)


def with_digest(df: DataFrame, content: str = "content") -> DataFrame:
    """A manifest's digests: SHA-256 of each artifact's bytes."""
    return df.withColumn("sha256", F.sha2(F.col(content), 256))


#: The first bytes of image files, in hexadecimal.
IMAGE_MAGIC = {"FFD8FF": "jpeg", "89504E470D0A1A0A": "png", "47494638": "gif", "424D": "bmp", "49492A00": "tiff", "4D4D002A": "tiff"}


def image_size(content: str = "content"):
    """(width, height) from an image's first bytes, for PNG, GIF and BMP; null for other files."""
    byte = lambda i: F.hex(F.substring(content, i, 1))
    number = lambda at, n, little: F.conv(F.concat(*[byte(at + i) for i in (reversed(range(n)) if little else range(n))]), 16, 10).cast("int")
    kind = image_kind(content)
    size = lambda at, n, little: F.struct(number(at, n, little).alias("width"), number(at + n, n, little).alias("height"))
    return F.when(kind == "png", size(17, 4, False)).when(kind == "gif", size(7, 2, True)).when(kind == "bmp", size(19, 4, True))


#: Endings of files that are taken for images.
IMAGE_ENDINGS = ("jpg", "jpeg", "png")


def is_image_name(path: str = "path"):
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*IMAGE_ENDINGS)


def image_split(images: DataFrame, folder: str) -> None:
    """Files (path, content) with an image's name, in valid/ and invalid/ as their first bytes tell, as tables with kind and size."""
    rows = images.filter(is_image_name()).withColumns({"kind": image_kind(), "size": image_size()})
    rows.filter("kind is not null").write.mode("overwrite").parquet(f"{folder}/valid")
    rows.filter("kind is null").write.mode("overwrite").parquet(f"{folder}/invalid")


def image_kind(content: str = "content"):
    """The kind that an image's first bytes tell; null for files that are damaged or no images."""
    head, out = F.hex(F.substring(content, 1, 8)), None
    for magic, kind in IMAGE_MAGIC.items():
        out = F.when(head.startswith(magic), kind) if out is None else out.when(head.startswith(magic), kind)
    return out
