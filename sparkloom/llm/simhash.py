"""SimHash fingerprints and their near-duplicate groups by covering locality-sensitive hashing.

Method: every document gets a 64-bit fingerprint of its word shingles. Equal fingerprints are first merged. Then each
fingerprint is put in 2 ** (radius + 1) - 1 tables; a table keeps the bits under one structured mask. Bit i has a code
c(i) of radius + 1 bits, not all zero, and table v keeps the bits with an odd number of ones in c(i) AND v. For any
radius bits there is a v that keeps none of them, so every pair within the radius collides in some table.

Scale: a first aggregation finds the (table, key) buckets with two or more members; nearly all others go no further.
Small buckets are compared in memory, a bounded number of rows at a time, and give a spanning forest of their links.
A bucket of more than `bucket` members is not compared pair by pair: each member is sent to every bit string within
half the radius of it under the bucket's free bits; members within the radius of each other share such a string, and
all who share one are within the radius, so linking each to the least finds the same components with rows in proportion.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, cut, map_rows, split_rows
from .components import components

BITS = 64


@dataclass(frozen=True)
class SimHash:
    """shingle: words to a shingle. radius: bits in which linked fingerprints may differ. bucket: members compared in memory."""

    shingle: int = 4
    radius: int = 4
    bucket: int = 2048
    seed: int = 42


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number; zero for a text without words (null, empty, blank)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, p: SimHash = SimHash(), text: str = "text", row: str = "doc_id") -> DataFrame:
    """(row, _fp) for every row of df."""
    shingle, seed = p.shingle, p.seed
    kind = df.schema[row].dataType.simpleString()
    return map_rows(
        df, [F.col(row).alias("_row"), F.col(text).alias("_text")], f"_row {kind}, _fp long",
        lambda ids, texts: {"_row": ids, "_fp": [fingerprint(t, shingle, seed) for t in texts]},
    )


def masks(radius: int) -> list[int]:
    """The covering masks over 64 bits, as unsigned numbers. Codes run evenly through all non-zero values."""
    n = (1 << (radius + 1)) - 1
    codes = [1 + (i * 11) % n for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(codes[i] & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one bucket, as (larger place, smaller place)."""
    label = np.arange(len(fps))
    out = []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)
        if len(near):
            found, first = np.unique(label[near], return_index=True)
            out += [(i, int(j)) for j in near[first]]
            label[i] = found[0]
            if len(found) > 1:
                label[:i][np.isin(label[:i], found)] = found[0]
    return out


def _small_links(members: DataFrame, radius: int) -> DataFrame:
    """Links within buckets, from rows sorted by (_t, _k) in each partition; a bucket is held in memory and no more."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        key, held = None, []

        def links():
            fps = np.array(held, dtype=np.int64).view(np.uint64)
            return [(held[i], held[j]) for i, j in _linked(fps, radius)]

        for batch in batches:
            out = []
            for t, k, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, k) != key:
                    if len(held) > 1:
                        out += links()
                    key, held = (t, k), []
                held.append(fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)
        if len(held) > 1 and (out := links()):
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)

    return members.mapInArrow(run, "u long, v long")


def _hot_links(members: DataFrame, all_masks: list[int], radius: int) -> DataFrame:
    """Links within large buckets through shared bit strings near their members; a row for each link to the least."""
    half = radius // 2
    flips = []
    for m in all_masks:
        free = [i for i in range(BITS) if not m >> i & 1]
        flips.append([_signed(sum(1 << i for i in c)) for n in range(half + 1) for c in combinations(free, n)])

    def run(batches):
        tables = [np.array(x, dtype=np.int64) for x in flips]
        for batch in batches:
            for t, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                z = tables[t] ^ np.int64(fp)
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.full(len(z), fp))], names=["z", "fp"])

    # Any two who share z lie within the radius, whichever table brought them there.
    balls = members.select("_t", "_fp").mapInArrow(run, "z long, fp long")
    least = balls.groupBy("z").agg(F.min("fp").alias("v"), F.max("fp").alias("_m")).filter("v <> _m").select("z", "v")
    return balls.join(least, "z").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(fps: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column _fp), enough to join whatever the radius joins."""
    assert p.radius % 2 == 0, "large buckets are split by half the radius"
    all_masks = masks(p.radius)
    keyed = F.array(*[F.struct(F.lit(t).cast("int").alias("_t"), F.col("_fp").bitwiseAND(F.lit(_signed(m))).alias("_k")) for t, m in enumerate(all_masks)])
    rows = fps.select("_fp", F.explode(keyed).alias("_x")).select("_fp", "_x._t", "_x._k")
    counted = rows.groupBy("_t", "_k").agg(F.count("*").alias("_n"), F.min("_fp").alias("_a"), F.max("_fp").alias("_b")).filter("_n > 1")
    counted = cut(counted)
    pairs = counted.filter((F.col("_n") == 2) & (F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= p.radius)).select(F.col("_b").alias("u"), F.col("_a").alias("v"))
    larger = counted.filter("_n > 2").select("_t", "_k", "_n")
    members = cut(rows.join(larger, ["_t", "_k"]))
    n = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    small = members.filter(F.col("_n") <= p.bucket).select("_t", "_k", "_fp").repartition(int(n), "_t", "_k").sortWithinPartitions("_t", "_k", "_fp")
    out = pairs.unionAll(_small_links(small, p.radius))
    hot = members.filter(F.col("_n") > p.bucket)
    if not hot.isEmpty():
        out = out.unionAll(_hot_links(hot, all_masks, p.radius))
    return out.distinct()


def groups(df: DataFrame, p: SimHash = SimHash(), text: str = "text", row: str = "doc_id") -> DataFrame:
    """One row per row of df: row, fingerprint (16 hex digits), component_id.

    component_id is the least row id that can be reached over links, the row's own included. Null, empty and blank texts
    have fingerprint zero and are linked like others. Texts shorter than a shingle are one shingle. Repeated rows are
    each returned. A null row id takes its group's component_id, null if no row of the group has an id. An empty table
    gives an empty result; other columns of df are not read.
    """
    made = cut(fingerprints(df, p, text, row))
    classes = cut(made.groupBy("_fp").agg(F.min("_row").alias("_least"), F.count("*").alias("_n")))
    edges = links(classes.select("_fp"), p)
    comp = cut(components(edges))
    # Only classes of several rows, or with links, are looked up; any other row is its own group.
    linked = classes.join(comp, classes["_fp"] == comp["node"]).select("_fp", "_least", "component")
    least = linked.groupBy("component").agg(F.min("_least").alias("_c"))
    far = linked.join(least, "component").select("_fp", "_c")
    near = classes.filter("_n > 1").join(linked.select("_fp"), "_fp", "left_anti").select("_fp", F.col("_least").alias("_c"))
    out = made.join(far.unionAll(near), "_fp", "left")
    return out.select(F.col("_row").alias(row), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.coalesce("_c", "_row").alias("component_id"))


def keep_one(df: DataFrame, p: SimHash = SimHash(), text: str = "text", row: str = "doc_id") -> DataFrame:
    """From every group of df one row: of the least id (null last), then the least hash of its text.

    Of rows that are equal in id and text one stays. Rows that stay are not shuffled, but for those that split_rows takes
    for others at first. An empty table gives an empty result.
    """
    key = content_key(row, text)
    found = groups(df.select(F.col(text).alias("_text"), key.alias("_key")), p, "_text", "_key")
    counts = found.groupBy("_key", "component_id").agg(F.count("*").alias("_n"))
    marks = cut(counts.select("_key", "_n", (F.col("_key") == F.col("component_id")).alias("_first")).filter("not _first or _n > 1"))
    _, kept = split_rows(df, key, marks.filter("not _first"))
    again = marks.filter("_first")
    if again.isEmpty():
        return kept
    twice, once = split_rows(kept, key, again)
    twice = twice.withColumn("_once", F.struct(key["_id"], key["_h1"], key["_h2"]))
    return once.unionByName(twice.dropDuplicates(["_once"]).drop("_once"))
