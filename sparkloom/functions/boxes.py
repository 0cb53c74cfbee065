"""Column expressions on boxes. A box is four DOUBLE columns (x1, y1, x2, y2) unless said otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "bbox_") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("xmin", "ymin", "xmax", "ymax"))


def area(b: Box) -> Column:
    """Signed area; negative for boxes inverted along one axis."""
    return (b[2] - b[0]) * (b[3] - b[1])


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column, digits: int | None = None) -> Box:
    out = (x, y, x + w, y + h)
    return out if digits is None else tuple(F.round(c, digits) for c in out)


def xyxy_to_xywh(b: Box, digits: int | None = None) -> Box:
    out = (b[0], b[1], b[2] - b[0], b[3] - b[1])
    return out if digits is None else tuple(F.round(c, digits) for c in out)


def clip_or_null(b: Box, width: Column, height: Column) -> Box:
    """The box inside its image; four nulls where nothing of positive width and height is left."""
    x1, x2 = (F.least(F.greatest(c, F.lit(0)), width) for c in (b[0], b[2]))
    y1, y2 = (F.least(F.greatest(c, F.lit(0)), height) for c in (b[1], b[3]))
    ok = (x2 > x1) & (y2 > y1)
    return tuple(F.when(ok, c) for c in (x1, y1, x2, y2))


def clamp_int(b: Box, width: Column, height: Column) -> Box:
    """Whole pixels: the near corner is kept at 0 or above, the far corner at the image's size or below."""
    x1, y1, x2, y2 = (c.cast("int") for c in b)
    return F.greatest(x1, F.lit(0)), F.greatest(y1, F.lit(0)), F.least(x2, width.cast("int")), F.least(y2, height.cast("int"))


def scale_thousand(b: Box, width: Column, height: Column) -> Box:
    """Boxes in thousandths of the image to whole pixels inside it."""
    x1, x2 = (F.least(F.greatest((c * width / 1000).cast("int"), F.lit(0)), width.cast("int")) for c in (b[0], b[2]))
    y1, y2 = (F.least(F.greatest((c * height / 1000).cast("int"), F.lit(0)), height.cast("int")) for c in (b[1], b[3]))
    return x1, y1, x2, y2


def thousandths_text(b: Box, width: Column, height: Column) -> Column:
    """A box as text `[x1, y1, x2, y2]` in thousandths of its image."""
    parts = [(c * 1000 / s).cast("int").cast("string") for c, s in zip(b, (width, height, width, height))]
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def iou(a: Box, b: Box, border: str = "half") -> Column:
    """Intersection over union; 0 for boxes apart. border: how many pixels an edge adds (half 0, include 1, exclude -1)."""
    d = {"half": 0.0, "include": 1.0, "exclude": -1.0}[border]
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + d, F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + d, F.lit(0.0))
    own = [(x[2] - x[0] + d) * (x[3] - x[1] + d) for x in (a, b)]
    return F.coalesce(F.try_divide(w * h, own[0] + own[1] - w * h), F.lit(0.0))


def affine(
    size: tuple[float, float], angle: float = 0.0, flip: tuple[bool, bool] = (False, False), shear: Sequence[float] = (0.0, 0.0),
    translate: Sequence[float] = (0.0, 0.0), out_size: tuple[float, float] | None = None, degrees: bool = True,
) -> list[list[float]]:
    """A 2 x 3 matrix: rotation about the centre, then flips, shear, translation and scaling to out_size, in this order."""

    def then(m, n):
        return [[sum(n[i][k] * m[k][j] for k in range(3)) for j in range(3)] for i in range(3)]

    w, h = size
    t = math.radians(angle) if degrees else angle
    c, s, cx, cy = math.cos(t), math.sin(t), w / 2, h / 2
    m = [[c, -s, cx - c * cx + s * cy], [s, c, cy - s * cx - c * cy], [0, 0, 1]]
    fx, fy = (1 - 2 * int(f) for f in flip)
    m = then(m, [[fx, 0, w if flip[0] else 0], [0, fy, h if flip[1] else 0], [0, 0, 1]])
    m = then(m, [[1, shear[0], 0], [shear[1], 1, 0], [0, 0, 1]])
    m = then(m, [[1, 0, translate[0]], [0, 1, translate[1]], [0, 0, 1]])
    if out_size:
        m = then(m, [[out_size[0] / w, 0, 0], [0, out_size[1] / h, 0], [0, 0, 1]])
    return m[:2]


def transform(b: Box, m: list[list[float]], out_w: float, out_h: float) -> Box:
    """The upright box around the four transformed corners, inside [0, out_w] x [0, out_h]."""
    corners = [(b[i], b[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))]
    xs = [x * m[0][0] + y * m[0][1] + m[0][2] for x, y in corners]
    ys = [x * m[1][0] + y * m[1][1] + m[1][2] for x, y in corners]
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
    return inside(F.least(*xs), out_w), inside(F.least(*ys), out_h), inside(F.greatest(*xs), out_w), inside(F.greatest(*ys), out_h)


def pick(values: list[float], row: Column, seed: int = 42) -> Column:
    """A number for each row: 0 for no values, the one value, uniform between two, or one of three and more.

    It comes of the first 32 bits of the MD5 of `seed:row`, so other engines can make it too.
    """
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), row.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    if len(values) < 2:
        return F.lit(float(values[0]) if values else 0.0)
    if len(values) == 2:
        return F.lit(float(values[0])) + u * float(values[1] - values[0])
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))
