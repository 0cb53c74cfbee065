"""Detection metrics: greedy matching, precision and recall, average precision, suppression, weak images.

Matching and suppression fold over each image and class, as each box depends on those before it: Spark sorts, numpy
measures overlaps with the boxes near by, matching those of many images at once; the boxes of one image bound the state.
All else is windows over (class) and aggregations.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sparkloom.functions.lineage import cut, small
from sparkloom.operators.datasets import running

KEY = ["image_id", "type"]
#: Classes that an evaluation may have.
CLASSES = 20_000
#: Boxes of a strip; pairs that are measured at once; pairs with left edges near, and so the overlaps held, of a block of predictions.
STRIP, MEASURED, WINDOWS = 64, 1 << 18, 1 << 21
#: Copies of either box that a row of pairs has, as all pairs of a row are made at once.
COPIES = 64
_COLUMNS = ("x1", "y1", "x2", "y2")


def _starts(table, keys) -> np.ndarray:
    """Where the runs of equal keys begin."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for c in keys:
        code = table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _whole(batches, keys):
    """Tables of whole images and classes, of batches that are sorted by keys; no more is held than one and a batch."""
    held = []
    for b in batches:
        rows = pa.Table.from_batches([b])
        # The row before tells whether the first one goes on with what is held.
        at = _starts(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), rows]), keys)[1:] - 1 if held else _starts(rows, keys)[1:]
        if len(at):
            yield pa.concat_tables([*held, rows.slice(0, at[-1])]).combine_chunks()
            held = []
            rows = rows.slice(at[-1])
        if rows.num_rows:
            held.append(rows)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _fold(df: DataFrame, order: list[str], run, schema: str) -> DataFrame:
    """What run(table, ends) gives of the images and classes that lie between ends: rows, and columns of theirs by name.

    schema names the columns; one that run doesn't give is the rows' row_id. Rows are sorted by Spark and pass Python a batch
    at a time, so that many small images cost no call each.
    """

    def each(batches):
        for table in _whole(batches, KEY):
            at, cols = run(table, [*_starts(table, KEY).tolist(), table.num_rows])
            if len(at):
                of = lambda c: table[c].take(pa.array(at))
                got = {**{c: of(c) for c in KEY}, **{c: pa.array(cols[c]) if c in cols else of("row_id") for c in names}}
                yield from pa.table(got).combine_chunks().to_batches()

    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in KEY)
    names = [c.split()[0] for c in schema.split(", ")]
    rows = df.repartition(*KEY).sortWithinPartitions(*KEY, *order)
    # Without ids in the result they only sort.
    return (rows if {"pos", "row_id"} & set(names) else rows.drop("row_id")).mapInArrow(each, f"{kind}, {schema}")


def _numbers(table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)


class _Boxes:
    """Boxes by their left edge, for overlaps of a box with those that may reach a threshold. Boxes without an area overlap none.

    Where the overlap (iou) of two boxes is t or more, the other's left edge lies at most the share 1 - t of the box's width
    to its right, and of the other's width, which is up to 1 / t of the box's, to its left.
    """

    def __init__(self, x1, y1, x2, y2, d: float, every: bool = False):
        """every: boxes without an area are kept too, as for thresholds that all boxes reach."""
        at = np.arange(len(x1)) if every else np.flatnonzero((x2 - x1 + d > 0) & (y2 - y1 + d > 0))
        self.at = at[np.argsort(x1[at], kind="stable")]
        self.x1, self.y1, self.x2, self.y2 = (c[self.at] for c in (x1, y1, x2, y2))
        self.d, self.own = d, (self.x2 - self.x1 + d) * (self.y2 - self.y1 + d)
        self.plain = not every and bool(np.isfinite(self.own).all())

    def window(self, x1, x2, t: float) -> tuple[list, list]:
        """For each box, the begin and end of those that may overlap it by t."""
        if t <= 0:
            return [0] * len(x1), [len(self.at)] * len(x1)
        w = x2 - x1 + self.d
        slack = 1e-9 * (np.abs(x1) + np.abs(w))
        return np.searchsorted(self.x1, x1 - w * (1 - t) / t - slack).tolist(), np.searchsorted(self.x1, x1 + w * (1 - t) + slack, "right").tolist()

    def overlaps(self, a: int, b: int, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
        """Overlaps with the boxes a to b; 0 where there is none, or no number."""
        d = self.d
        w, h = np.minimum(self.x2[a:b], x2), np.minimum(self.y2[a:b], y2)
        w -= np.maximum(self.x1[a:b], x1)
        h -= np.maximum(self.y1[a:b], y1)
        if d:
            w += d
            h += d
        np.maximum(w, 0.0, out=w)
        np.maximum(h, 0.0, out=h)
        w *= h
        u = self.own[a:b] + (x2 - x1 + d) * (y2 - y1 + d)
        u -= w
        if self.plain:
            return np.divide(w, u, out=u)
        # A union may be 0 or unknown where nothing overlaps.
        np.divide(w, u, out=u, where=w > 0)
        u[~(w > 0)] = 0.0
        return u


def _visit(g, big, p, threshold: float, d: float) -> tuple[np.ndarray, np.ndarray]:
    """_meet of one image and class, for a threshold of 0 or less, which boxes reach that don't overlap."""
    t, free = np.zeros(len(p[0]), dtype=np.int32), np.ones(len(g[0]), dtype=bool)
    if not len(t) or not len(free):
        return t, free
    held = _Boxes(*g, d, every=True)
    left = np.ones(len(held.at))
    for k, box in enumerate(zip(*[c.tolist() for c in p])):
        ov = held.overlaps(0, len(left), *box)
        ov *= left
        best = ov.max()
        if best >= threshold:
            same = np.flatnonzero(ov == best)
            # Of equal ones the first truth.
            i = same[held.at[same].argmin()]
            if big[held.at[i]]:
                t[k], left[i] = 1, 0.0
                free[held.at[i]] = False
            else:
                t[k] = -1
    return t, free


def _distinct(key, box) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes of equal key and corners once: the first row of each, of each row which of them it is, and all rows by that."""
    rows = np.lexsort((*box, key))
    new = np.ones(len(rows), dtype=bool)
    new[1:] = reduce(np.logical_or, [c[rows[1:]] != c[rows[:-1]] for c in (key, *box)])
    which = np.empty(len(rows), dtype=np.int64)
    which[rows] = np.cumsum(new) - 1
    return rows[new], which, rows


def _codes(key, values):
    """Numbers in the order of (key, values), and a function that places any others among them."""
    known = np.unique(values)
    code = lambda k, v, side: k * (len(known) + 1) + np.searchsorted(known, v, side)
    return code(key, values, "left"), code


def _members(begin, count) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of count members from begin on: the run of each member, and the members."""
    run = np.repeat(np.arange(len(count)), count)
    return run, np.arange(len(run)) + np.repeat(begin - (np.cumsum(count) - count), count)


def _blocks(count, most: int):
    """Ends of blocks whose counts sum to most or less, or have one member."""
    sums, a = np.cumsum(count), 0
    while a < len(sums):
        e = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + most, "right")))
        yield a, e
        a = e


class _Plane:
    """Boxes of many images, all with an area: strips of neighbours from left to right, in each strip from above.

    What _Boxes says of left edges holds of upper ones too.
    """

    def __init__(self, key, box, t: float, d: float):
        rows = np.lexsort((box[0], key))
        key = key[rows]
        self.t, self.d = t, d
        self.x, self.x_code = _codes(key, box[0][rows])
        # Each image begins a strip.
        self.strip = np.cumsum((np.arange(len(key)) - np.searchsorted(key, key)) % STRIP == 0) - 1
        y, self.y_code = _codes(self.strip, box[1][rows])
        order = np.argsort(y, kind="stable")
        self.y, self.rows = y[order], rows[order]
        self.x1, self.y1, self.x2, self.y2 = (c[self.rows] for c in box)
        self.w, self.h = self.x2 - self.x1 + d, self.y2 - self.y1 + d

    def _reach(self, low, high):
        w = high - low + self.d
        slack = 1e-9 * (np.abs(low) + np.abs(w))
        return low - w * (1 - self.t) / self.t - slack, low + w * (1 - self.t) + slack

    def window(self, key, box) -> tuple[np.ndarray, np.ndarray]:
        """For each box, the begin and number of those whose left edges are near, from left to right."""
        low, high = self._reach(box[0], box[2])
        begin = np.searchsorted(self.x, self.x_code(key, low, "left"))
        return begin, np.maximum(np.searchsorted(self.x, self.x_code(key, high, "right")) - begin, 0)

    def overlaps(self, begin, count, box) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(box, held box, overlap) where that reaches t, of boxes that have such windows."""
        some = np.flatnonzero(count)
        first = self.strip[begin[some]]
        at, strip = _members(first, self.strip[begin[some] + count[some] - 1] - first + 1)
        at = some[at]
        low, high = self._reach(box[1], box[3])
        begin = np.searchsorted(self.y, self.y_code(strip, low[at], "left"))
        count = np.maximum(np.searchsorted(self.y, self.y_code(strip, high[at], "right")) - begin, 0)
        x1, y1, x2, y2 = box
        w, h = x2 - x1 + self.d, y2 - y1 + self.d
        t, got = self.t * (1 - 1e-9), []
        for a, e in _blocks(count, MEASURED):
            i, j = _members(begin[a:e], count[a:e])
            i = at[a:e][i]
            wide = np.minimum(x2[i], self.x2[j]) - np.maximum(x1[i], self.x1[j]) + self.d
            # An overlap of t needs as much of either width and height.
            on = wide >= t * np.maximum(w[i], self.w[j])
            i, j, wide = i[on], j[on], wide[on]
            high = np.minimum(y2[i], self.y2[j]) - np.maximum(y1[i], self.y1[j]) + self.d
            on = high >= t * np.maximum(h[i], self.h[j])
            i, j = i[on], j[on]
            both = wide[on] * high[on]
            ov = both / (self.w[j] * self.h[j] + w[i] * h[i] - both)
            on = ov >= self.t
            got.append((i[on], self.rows[j[on]], ov[on]))
        if not got:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        return tuple(np.concatenate(c) for c in zip(*got))


def _meet(gkey, g, big, pkey, p, threshold: float, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy matching: t of each prediction (-1: it doesn't count), and which truths stay free. The threshold is above 0.

    gkey, pkey: numbers of image and class; g, p: corners of truths in their order and of predictions as they are visited;
    big: truths that count, which their corners decide. Overlaps of many images are measured at once, and those of copies
    once; then each prediction in turn looks at the few boxes that reach the threshold. Boxes without an area overlap none.
    """
    t, free = np.zeros(len(pkey), dtype=np.int32), np.ones(len(gkey), dtype=bool)

    def proper(box):
        w, h = box[2] - box[0] + d, box[3] - box[1] + d
        return np.flatnonzero((w > 0) & (h > 0) & np.isfinite(w * h))

    held, seen = proper(g), proper(p)
    if not len(held) or not len(seen):
        return t, free
    first, which, rows = _distinct(gkey[held], [c[held] for c in g])
    # Copies in their order; those from after to end are free.
    truth, one = held[rows].tolist(), held[first]
    end = np.cumsum(np.bincount(which))
    after, end, counts = [0, *end[:-1].tolist()], end.tolist(), big[one].tolist()
    plane, begin, count, p = _plane(gkey[one], [c[one] for c in g], pkey[seen], [c[seen] for c in p], threshold, d)
    for a, e in _blocks(count, WINDOWS):
        some = np.flatnonzero(count[a:e]) + a
        first, which, _ = _distinct(pkey[seen[some]], [c[some] for c in p])
        first = some[first]
        i, j, ov = plane.overlaps(begin[first], count[first], [c[first] for c in p])
        order = np.lexsort((-ov, i))
        boxes_of, marks = j[order].tolist(), ov[order].tolist()
        n = np.bincount(i, minlength=len(first))
        last = np.cumsum(n)
        on = np.flatnonzero(n[which])
        at, last = (last - n).tolist(), last.tolist()
        for k, u in zip(seen[some[on]].tolist(), which[on].tolist()):
            q, z = at[u], last[u]
            # Boxes whose copies are all taken stay so.
            while q < z and after[boxes_of[q]] == end[boxes_of[q]]:
                q += 1
            at[u] = q
            if q == z:
                continue
            best, mark, q = boxes_of[q], marks[q], q + 1
            # Of equal ones the first truth.
            while q < z and marks[q] == mark:
                b = boxes_of[q]
                if after[b] < end[b] and truth[after[b]] < truth[after[best]]:
                    best = b
                q += 1
            if counts[best]:
                t[k] = 1
                free[truth[after[best]]] = False
                after[best] += 1
            else:
                t[k] = -1
    return t, free


def _plane(gkey, g, pkey, p, threshold: float, d: float):
    """A plane of boxes g, the windows of boxes p in it, and p as the plane sees them."""
    plane = _Plane(gkey, g, threshold, d)
    begin, count = plane.window(pkey, p)
    if count.sum() > WINDOWS:
        # Overlaps are the same if axes change places; fewer upper edges than left ones may be near.
        turn = lambda box: [box[i] for i in (1, 0, 3, 2)]
        turned = _Plane(gkey, turn(g), threshold, d)
        window = turned.window(pkey, turn(p))
        if window[1].sum() < count.sum():
            return turned, *window, turn(p)
    return plane, begin, count, p


class _Copies:
    """Boxes of one side of a table, each once: its key, its corners, and the rows of its copies."""

    def __init__(self, at, key, box):
        first, which, rows = _distinct(key[at], [c[at] for c in box])
        self.first, self.rows = at[first], at[rows]
        self.key, self.box = key[self.first], [c[self.first] for c in box]
        self.count = np.bincount(which, minlength=len(first))
        self.begin = np.cumsum(self.count) - self.count
        self.finite = np.isfinite((self.box[2] - self.box[0]) * (self.box[3] - self.box[1]))


def _pairs(left: _Copies, right: _Copies, threshold: float):
    """Pairs (left, right, overlap) of equal keys that overlap by the threshold, in blocks. Boxes of no finite area meet only
    such ones, compared as Spark and SQL do: what is no number is above all numbers."""
    p, g = np.flatnonzero(left.finite), np.flatnonzero(right.finite)
    if len(p) and len(g):
        plane, begin, count, box = _plane(right.key[g], [c[g] for c in right.box], left.key[p], [c[p] for c in left.box], threshold, 0.0)
        for a, e in _blocks(count, WINDOWS):
            i, j, ov = plane.overlaps(begin[a:e], count[a:e], [c[a:e] for c in box])
            yield p[a:e][i], g[j], ov
    p, g = np.flatnonzero(~left.finite), np.flatnonzero(~right.finite)
    if len(p) and len(g):
        g = g[np.argsort(right.key[g], kind="stable")]
        begin, end = (np.searchsorted(right.key[g], left.key[p], side) for side in ("left", "right"))
        for a, e in _blocks(end - begin, MEASURED):
            i, j = _members(begin[a:e], (end - begin)[a:e])
            i, j = p[a:e][i], g[j]
            with np.errstate(all="ignore"):
                l, r = [c[i] for c in left.box], [c[j] for c in right.box]
                w, h = (np.maximum(np.fmin(l[k + 2], r[k + 2]) - np.maximum(l[k], r[k]), 0.0) for k in (0, 1))
                u = (l[2] - l[0]) * (l[3] - l[1]) + (r[2] - r[0]) * (r[3] - r[1]) - w * h
                ov = np.where(u == 0, 0.0, w * h / u)
            on = ~(ov < threshold)
            yield i[on], j[on], ov[on]


def _rounded(x, digits: int | None) -> np.ndarray:
    """Numbers from 0 on, rounded as SQL's round() does: the scaled number to the nearest whole one, halves up."""
    if digits is None:
        return x
    scaled = x * 10.0**digits
    low = np.floor(scaled)
    return (low + (scaled - low >= 0.5)) / 10.0**digits


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], lp: str, rp: str, threshold: float, digits: int | None = None) -> DataFrame:
    """Pairs of left and right with equal keys whose overlap (iou, rounded to digits) reaches a threshold above 0, and their columns.

    Copies of a box are measured once. Boxes of equal keys lie together, where numpy finds and measures the pairs and gives
    each with the columns of its copies; Spark then makes the pairs of copies, which needs no more than two loops. Inverted
    and empty boxes overlap none.
    """
    corners = lambda p: [p + c for c in ("xmin", "ymin", "xmax", "ymax")]
    rest = {n: [c for c in df.columns if c not in (*keys, *corners(p))] for df, p, n in ((left, lp, "_l"), (right, rp, "_r"))}
    # In the rows of both sides columns of equal type share a place, flat, as Arrow writes structs slowly.
    places, types = {n: {} for n in rest}, []
    for df, n in ((left, "_l"), (right, "_r")):
        for c in rest[n]:
            t = df.schema[c].dataType
            k = next((k for k, u in enumerate(types) if u == t and k not in places[n].values()), len(types))
            types += [t] * (k == len(types))
            places[n][c] = k

    def side(df, p, n):
        has = [F.col(c).isNotNull() for c in keys] + [F.col(f"{p}xmax") > F.col(f"{p}xmin"), F.col(f"{p}ymax") > F.col(f"{p}ymin")]
        own = {k: F.col(c) for c, k in places[n].items()}
        held = [F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(corners(p))] + [own.get(k, F.lit(None).cast(t)).alias(f"_p{k}") for k, t in enumerate(types)]
        return df.filter(reduce(Column.__and__, has)).select(*keys, F.lit(n == "_l").alias("_side"), *held)

    def each(batches):
        for table in _whole(batches, ["_key"]):
            table, key = table.combine_chunks(), np.zeros(table.num_rows, dtype=np.int64)
            column = lambda c: table.column(c).chunk(0)
            for c in keys:
                code = column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                key = np.unique(key * (code.max() + 1) + code, return_inverse=True)[1]
            first, box = column("_side").to_numpy(zero_copy_only=False), [_numbers(table, f"_c{i}") for i in range(4)]
            sides = [_Copies(np.flatnonzero(on), key, box) for on in (first, ~first)]
            for *found, ov in _pairs(*sides, threshold):
                # Many copies are dealt to several rows.
                parts = [-(-s.count[k] // COPIES) for s, k in zip(sides, found)]
                row, part = _members(np.zeros(len(ov), dtype=np.int64), parts[0] * parts[1])
                found, ov = [k[row] for k in found], _rounded(ov, digits)[row]
                skip = [n * COPIES for n in (part // parts[1][row], part % parts[1][row])]
                begin = [s.begin[k] + n for s, k, n in zip(sides, found, skip)]
                count = [np.minimum(s.count[k] - n, COPIES) for s, k, n in zip(sides, found, skip)]
                for a, e in _blocks(count[0] + count[1], MEASURED):
                    got = {c: column(c).take(pa.array(sides[0].first[found[0][a:e]])) for c in keys} | {"iou": pa.array(ov[a:e])}
                    for n, s, k, b, m in zip(rest, sides, found, begin, count):
                        got |= {f"{n}_c{i}": pa.array(c[k[a:e]]) for i, c in enumerate(s.box)}
                        ends, copies = pa.array(np.concatenate([[0], np.cumsum(m[a:e])]).astype(np.int32)), pa.array(s.rows[_members(b[a:e], m[a:e])[1]])
                        lists = [column(f"_p{i}").take(copies) for i in places[n].values()] or [copies]
                        got |= {f"{n}{i}": pa.ListArray.from_arrays(ends, c) for i, c in enumerate(lists)}
                    yield from pa.table(got).to_batches()

    both = side(left, lp, "_l").unionAll(side(right, rp, "_r"))
    schema = [T.StructField(c, both.schema[c].dataType) for c in keys] + [T.StructField("iou", T.DoubleType())]
    for n in rest:
        schema += [T.StructField(f"{n}_c{i}", T.DoubleType()) for i in range(4)]
        schema += [T.StructField(f"{n}{i}", T.ArrayType(t)) for i, t in enumerate([types[k] for k in places[n].values()] or [T.LongType()])]
    # Sorted by one number, of which a run may hold several keys.
    rows = both.withColumn("_key", F.xxhash64(*keys)).repartition("_key").sortWithinPartitions("_key")
    pairs = rows.mapInArrow(each, T.StructType(schema))
    for n, names in rest.items():
        one = len(names) < 2
        pairs = pairs.withColumn(n, F.explode(f"{n}0" if one else F.arrays_zip(*[f"{n}{i}" for i in range(len(names))])))
    out = []
    for df, p, n in ((left, lp, "_l"), (right, rp, "_r")):
        own = {c: F.col(f"{n}_c{i}").cast(df.schema[c].dataType) for i, c in enumerate(corners(p))}
        own |= {c: F.col(n) if len(rest[n]) < 2 else F.col(n)[f"{n}{i}"] for i, c in enumerate(rest[n])}
        out += [own[c].alias(c) for c in df.columns if c not in keys]
    return pairs.select(*keys, *out, "iou")


def _asked(gt: DataFrame, pred: DataFrame, conf: float, min_area: float) -> DataFrame:
    """Predictions that matching looks at."""
    return pred.filter((F.col("score") >= conf) & (_size() >= min_area)).join(gt.select("image_id").distinct(), "image_id", "left_semi")


def _size() -> Column:
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))


def _matched(gt: DataFrame, pred: DataFrame, iou_threshold: float, min_area: float, border: float, tell, schema: str) -> DataFrame:
    """What tell(ends, rows, t, score) makes, for _fold, of all pairs of the images and classes between ends."""
    side = lambda df, n, o: df.select(*KEY, F.lit(n).alias("side"), o.cast("double").alias("o"), F.col("row_id").cast("string").alias("row_id"), *[F.col(c).cast("double").alias(c) for c in _COLUMNS], F.coalesce(_size() >= min_area, F.lit(False)).alias("big"))
    sides = side(gt, 0, F.lit(0.0)).unionAll(side(pred, 1, -F.col("score")))

    def run(table, ends):
        second, big, o = _numbers(table, "side") > 0, _numbers(table, "big") > 0, _numbers(table, "o")
        cols = [_numbers(table, c) for c in _COLUMNS]
        g, p = np.flatnonzero(~second), np.flatnonzero(second)
        if iou_threshold > 0:
            key = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            t, free = _meet(key[g], [c[g] for c in cols], big[g], key[p], [c[p] for c in cols], iou_threshold, border)
        else:
            middles = [a + int((~second[a:e]).sum()) for a, e in zip(ends, ends[1:])]
            parts = [_visit([c[a:m] for c in cols], big[a:m], [c[m:e] for c in cols], iou_threshold, border) for a, m, e in zip(ends, middles, ends[1:])]
            t, free = (np.concatenate(x) for x in zip(*parts))
        seen, missed = p[t >= 0], g[free & big[g]]
        return tell(ends, np.concatenate([seen, missed]), np.concatenate([t[t >= 0], np.ones(len(missed), dtype=np.int32)]), np.concatenate([-o[seen], np.zeros(len(missed))]))

    return _fold(sides, ["side", "o", "row_id", *_COLUMNS], run, schema)


def match(gt: DataFrame, pred: DataFrame, iou_threshold: float = 0.5, conf: float = 0.0, min_area: float = 0.0, border: float = 0.0) -> DataFrame:
    """Pairs (image_id, type, t, score, pos) as the metrics need them, and tn rows (t null) for images empty on both sides.

    gt, pred: image_id, type, row_id, x1, y1, x2, y2 (and score). Predictions under conf or min_area are left out. They
    are visited by score, ties by row_id; each takes the free truth of best overlap (the first on ties) if that reaches
    the threshold: t 1; else t 0. If that truth is under min_area, neither counts and the truth stays free. Every free
    truth of min_area is a miss: t 1 with score 0. Only images with truths are looked at, for every class of gt.
    """
    pred = _asked(gt, pred, conf, min_area)
    pairs = _matched(gt, pred, iou_threshold, min_area, border, lambda ends, rows, t, score: (rows, {"t": t, "score": score}), "t int, score double, pos string")
    # Images by classes: as many as the result of the evaluation has; those without any box are true negatives.
    types = [r[0] for r in gt.select("type").distinct().limit(CLASSES + 1).collect()]
    if len(types) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    every = gt.select("image_id").distinct().withColumn("type", F.explode(F.array(*[F.lit(t) for t in types]).cast("array<string>")))
    held = gt.select(*KEY).unionAll(pred.select(*KEY)).distinct()
    empty = every.join(held, KEY, "left_anti")
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("t", "int"), ("score", "double"), ("pos", "string"))]
    return pairs.unionAll(empty.select(*KEY, *nothing))


def curve(pairs: DataFrame, conf: float = 0.0) -> DataFrame:
    """(type, n, precision, recall) after each pair by falling score; ties by image and row, misses last."""
    hit = (F.col("t") == 1) & (F.col("score") >= conf)
    false = (F.col("t") == 0) & (F.col("score") >= conf)
    rows = pairs.filter("t is not null")
    all_of = cut(rows.groupBy("type").agg(F.sum(F.col("t").cast("long")).alias("npos")))
    sums = {"n": (F.lit(1).cast("long"), "sum"), "tp": (hit.cast("long"), "sum"), "fp": (false.cast("long"), "sum")}
    rows = running(rows, ["type"], [F.desc("score"), "image_id", "pos"], sums).join(small(all_of), "type")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("type", F.col("n").cast("bigint").alias("n"), zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), zero(F.try_divide(F.col("tp"), F.col("npos"))).alias("recall"))


def average_precision(points: DataFrame, method: str = "sample", k: int = 11, axes: str = "voc") -> DataFrame:
    """(type, ap) of curve() rows. method: k sampled points, or the envelope integrated. axes: 'voc' reads precision over
    recall; 'swapped' has the two change places, for parity with tools that hand them over in the other order.
    """
    r, p = ("recall", "precision") if axes == "voc" else ("precision", "recall")
    if method == "sample":
        best = [F.coalesce(F.max(F.when(F.col(r) >= i / (k - 1), F.col(p))), F.lit(0.0)) for i in range(k)]
        return points.groupBy("type").agg((reduce(Column.__add__, best) / k).alias("ap"))
    steps = points.groupBy("type", F.col(r).alias("r")).agg(F.max(p).alias("p"))
    steps = running(steps, ["type"], [F.desc("r")], {"p": (F.col("p"), "max")})
    steps = running(steps, ["type"], ["r"], {"before": (F.col("r"), "max_before")}).withColumn("before", F.coalesce("before", F.lit(0.0)))
    return steps.groupBy("type").agg(F.sum((F.col("r") - F.col("before")) * F.col("p")).alias("ap"))


def metrics(pairs: DataFrame, conf: float = 0.0) -> DataFrame:
    """(type, tp, fp, fn, tn, pr, re, acc) per class."""
    t, s, e = F.col("t"), F.col("score") >= conf, 1e-7
    got = pairs.groupBy("type").agg(
        F.count_if((t == 1) & s).alias("tp"), F.count_if((t == 0) & s).alias("fp"), F.count_if((t == 1) & ~s).alias("fn"), F.count_if(t.isNull()).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return got.select("*", (tp / (tp + fp + e)).alias("pr"), F.when(tp + fn > 0, tp / (tp + fn + e)).otherwise(0.0).alias("re"), ((tp + tn) / (tp + fp + tn + fn + e)).alias("acc"))


def evaluate(gt: DataFrame, pred: DataFrame, iou_threshold: float = 0.5, conf: float = 0.5, min_area: float = 0.0, k: int = 11, axes: str = "swapped") -> DataFrame:
    """Per class: metrics() and ap. The mean over the ap column is the mean average precision."""
    pairs = cut(match(gt, pred, iou_threshold, conf, min_area))  # read by the curve and the counts
    ap = average_precision(curve(pairs, conf), "sample", k, axes)
    return metrics(pairs, conf).join(ap, "type", "left").na.fill(0.0, ["ap"])


def summarize(sequences: DataFrame, only: str | None = None) -> DataFrame:
    """Rows of several sequences and one of their sums: rates anew from the counts, ap as a mean. only: one class."""
    rows = sequences if only is None else sequences.filter(F.col("type") == only)
    tp, fp, fn, tn = (F.sum(c) for c in ("tp", "fp", "fn", "tn"))
    total = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.avg("ap").alias("ap"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rate = {"pr": tp / (tp + fp + 1e-7), "re": tp / (tp + fn + 1e-7), "acc": (tp + tn) / (tp + fp + tn + fn + 1e-7)}
    total = total.withColumns(rate).withColumn("sequence", F.lit("Summary")).withColumn("type", F.lit(only or "all"))
    return rows.unionByName(total.select(*rows.columns))


def suppress(found: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """Boxes (image_id, type, row_id, x1, y1, x2, y2, score) that stay when, within image and class, those overlapping a
    better kept one by more than the threshold are dropped. Ties go by row_id."""
    rows = found.select(*KEY, (-F.col("score")).cast("double").alias("o"), F.col("row_id").cast("string").alias("row_id"), *[F.col(c).cast("double").alias(c) for c in _COLUMNS])

    def run(table, ends):
        o, cols, stay = _numbers(table, "o"), [_numbers(table, c) for c in _COLUMNS], []
        for a, e in zip(ends, ends[1:]):
            x1, y1, x2, y2 = box = [c[a:e] for c in cols]
            held = _Boxes(*box, 0.0, every=iou_threshold <= 0)
            begin, end = held.window(held.x1, held.x2, iou_threshold)
            place = np.full(e - a, -1)
            place[held.at] = np.arange(len(held.at))
            gone = np.zeros(len(held.at), dtype=bool)
            kept = []
            for k, i in enumerate(place.tolist()):
                if i < 0:
                    kept.append(k)
                elif not gone[i]:
                    kept.append(k)
                    # Better ones that it meets here are decided already.
                    gone[begin[i] : end[i]] |= held.overlaps(begin[i], end[i], x1[k], y1[k], x2[k], y2[k]) > iou_threshold
            stay += [a + k for k in kept]
        return np.array(stay), {"score": -o[stay]}

    return _fold(rows, ["o", "row_id", *_COLUMNS], run, "row_id string, score double")


def image_counts(gt: DataFrame, pred: DataFrame, iou_threshold: float = 0.5, conf: float = 0.0, min_area: float = 0.0, border: float = 0.0, sure: float = 0.0) -> DataFrame:
    """(image_id, type, tp, fp, fn) of match()'s pairs, of which those from the score sure on are found: counted as they are
    matched, so that no pair leaves the fold."""

    def tell(ends, rows, t, score):
        image, found = np.searchsorted(ends, rows, "right") - 1, ~(score < sure)
        n = lambda on: np.bincount(image[on], minlength=len(ends) - 1)
        some = np.flatnonzero(n(t >= 0))
        return np.array(ends)[some], {c: n(on)[some] for c, on in (("tp", (t == 1) & found), ("fp", (t == 0) & found), ("fn", (t == 1) & ~found))}

    return _matched(gt, _asked(gt, pred, conf, min_area), iou_threshold, min_area, border, tell, "tp bigint, fp bigint, fn bigint")


def weak_images(found: DataFrame, conf: float = 0.0, recall: float = 0.5, precision: float = 0.0) -> DataFrame:
    """Images and classes whose recall or precision is under its limit, with their counts. found: pairs of match(), counted
    here from the score conf on, or image_counts()."""
    t, s = F.col("t"), F.col("score") >= conf
    got = found
    if "t" in found.columns:
        got = found.filter("t is not null").groupBy(*KEY).agg(F.count_if((t == 1) & s).alias("tp"), F.count_if((t == 0) & s).alias("fp"), F.count_if((t == 1) & ~s).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(1.0))
    got = got.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn"))
    return got.filter((F.col("recall") < recall) | (F.col("precision") < precision))


def cumulative_rate(flag: Column, order: list[Column], by: list[str]) -> Column:
    return F.avg(flag.cast("double")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def mean_average_precision(rates: DataFrame) -> DataFrame:
    """One row (map, classes): the mean of class average precisions."""
    return rates.agg(F.avg("ap").alias("map"), F.count("*").alias("classes"))


def label_rounds(detect, images: DataFrame, phrases: list[str], floor: float = 0.3, iou_threshold: float = 0.5, rounds: int = 3) -> DataFrame:
    """Labelling in rounds: what a model finds for phrases, filtered by score and overlap within a class; images whose
    phrases were not all found ask for the rest in the next round.

    detect(df) gets (image_id, phrases) and gives (image_id, type, row_id, x1, y1, x2, y2, score); the last rows of a round
    are kept in the checkpoint folder. Returns image_id, type, row_id, score, x1, y1, x2, y2, round.
    """
    asked = images.select("image_id", F.array(*[F.lit(p) for p in phrases]).cast("array<string>").alias("phrases"))
    out = None
    for i in range(1, rounds + 1):
        found = cut(detect(asked).filter(F.col("score") >= floor))
        kept = cut(found.join(suppress(found, iou_threshold).select(*KEY, "row_id"), [*KEY, "row_id"], "left_semi").withColumn("round", F.lit(i)))
        out = kept if out is None else out.unionByName(kept)
        seen = kept.groupBy("image_id").agg(F.collect_set("type").alias("_seen"))
        asked = asked.join(seen, "image_id", "left").withColumn("phrases", F.array_except("phrases", F.coalesce("_seen", F.array().cast("array<string>")))).filter("size(phrases) > 0").drop("_seen")
        asked = cut(asked)
        if kept.isEmpty() or asked.isEmpty():
            break
    return out
