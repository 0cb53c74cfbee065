"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The white space that separates words: [\x20\x09-\x0D].
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

#: A side of at most this many rows (each a key and a few numbers) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: its lineage ends there and survives lost executors.

    The folder is spark.checkpoint.dir; only where that is unset (tests, a local session) a temporary one is made.
    """
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


@contextlib.contextmanager
def opened(uri: str, mode: str):
    """A file in the shared folder: a local path, or any store that Arrow can reach."""
    if re.match(r"[a-z][a-z0-9+.-]*:", uri) and not uri.startswith("file:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(path) if mode == "rb" else store.open_output_stream(path) as f:
            yield f
    else:
        with open(re.sub(r"^file:/*", "/", uri), mode) as f:
            yield f


def make_dir(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def drop(spark: SparkSession, path: str) -> None:
    """Delete what this library wrote at path, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """df joined with small, which is broadcast only when it is counted at limit rows or fewer.

    A larger one is joined by sort-merge, where Spark's adaptive execution splits hot keys of df.
    small should be the result of cut(), so that counting it is cheap.
    """
    if small.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(small), on, how)
    return df.join(small.hint("merge"), on, how)


def trimmed(text: Column) -> Column:
    """text (null: empty) without white space at its ends."""
    return F.call_function("btrim", F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))


def word_array(text: Column) -> Column:
    """The words of text as an array; none for null, empty and blank texts."""
    inner = trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WS + "+"))


def stretch(text: str, number: str, chars: int) -> Column:
    """text, or of a longer one so many characters, from a place that the column number chooses."""
    spare = F.greatest(F.char_length(text) - chars, F.lit(0))
    return F.substring(F.col(text), (F.pmod(F.col(number), (spare + 1).cast("long")) + 1).cast("int"), F.lit(chars)).alias(text)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def content_key(row: str, *columns: str) -> Column:
    """A struct that tells rows apart by id (nulls last) and by 128 bits of hashes of the columns."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    one, two = F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)
    return F.struct(F.col(row).isNull().alias("_null"), F.col(row).alias("_id"), one.alias("_h1"), two.alias("_h2"))


def same_key(key: Column, other: Column) -> Column:
    """Whether two content keys are equal, null ids among them."""
    return key["_h1"].eqNullSafe(other["_h1"]) & key["_h2"].eqNullSafe(other["_h2"]) & key["_id"].eqNullSafe(other["_id"])


#: Bits of the filter that keeps rows out of a shuffle: what is broadcast of it is an eighth of this in bytes, at most.
FILTER_BITS = 1 << 27


def split_rows(df: DataFrame, key: Column, keys: DataFrame, limit: int = BROADCAST_ROWS, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose content key is among keys (one column _key, each once), and the others.

    Few keys are broadcast. Beyond that, a bitmap of the keys' hashes, of 64 bits a key but `bits` at most, is broadcast
    and tells most rows that aren't among them where they lie; only the rest, wide as they are, meet the keys in a shuffle.
    The more keys there are for the most bits, the more rows go that way; the result is the same. keys should be the result
    of cut().
    """
    names = df.columns
    keys = keys.select(F.col("_key").alias("_wanted"))
    if (n := keys.count()) <= limit:
        small = F.broadcast(keys)
        return df.join(small, same_key(key, F.col("_wanted")), "left_semi"), df.join(small, same_key(key, F.col("_wanted")), "left_anti")
    bits = min(bits, 1 << max(16, (64 * n).bit_length()))
    place = lambda k: F.pmod(k["_h1"], F.lit(bits))
    at = keys.select(place(F.col("_wanted")).alias("_at"))
    bitmap = at.groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    bitmap = cut(bitmap)
    rows = df.select(F.struct(*[F.col(c) for c in names]).alias("_all"), key.alias("_mine"), F.bitmap_bucket_number(place(key)).alias("_bucket"), F.bitmap_bit_position(place(key)).alias("_bit"))
    rows = rows.join(F.broadcast(bitmap), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce(F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1, F.lit(False))
    rows = rows.withColumn("_byte", byte).withColumn("_may", may)
    none = rows.filter(~F.col("_may")).select("_all.*")
    some = rows.filter("_may").select("_all", "_mine")
    wanted = keys.hint("merge")
    return tuple(x.select("_all.*") if how == "left_semi" else x.select("_all.*").unionByName(none) for how in ("left_semi", "left_anti") for x in [some.join(wanted, same_key(F.col("_mine"), F.col("_wanted")), how)])


def map_rows(df: DataFrame, columns: list[str | Column], schema: str, f: Callable[..., dict[str, list]], through: list[str] | None = None) -> DataFrame:
    """Run f over the given columns of df, a bounded Arrow batch at a time.

    f gets one Python list per column and returns a dict of equally long lists, named as in schema. Columns named in
    through are handed on as they are, after those of schema.
    """
    through = through or []
    kind = StructType.fromDDL(schema)
    made_fields = list(to_arrow_schema(kind))
    n = len(columns)
    for c in through:
        kind = kind.add(df.schema[c])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = f(*[c.to_pylist() for c in part.columns[:n]])
                arrays = [pa.array(made[x.name], x.type) for x in made_fields] + part.columns[n:]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.name for x in made_fields] + through)

    return df.select(*columns, *through).mapInArrow(run, kind)


def code_point_spans(raw: bytes, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """found with places in bytes turned into places in code points."""
    if raw.isascii() or not found:
        return found
    at, chars, to = 0, 0, {}
    for b in sorted({x for _, s, e in found for x in (s, e)}):
        chars += sum((c & 0xC0) != 0x80 for c in raw[at:b]) if b - at < 64 else len(raw[at:b].decode("utf-8", "surrogatepass"))
        at, to[b] = b, chars
    return [(k, to[s], to[e]) for k, s, e in found]
