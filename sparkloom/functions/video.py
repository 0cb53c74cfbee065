"""Column expressions on durations in seconds: chunks, frames and highlight windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def highlight(at: Column, length: Column, before: float = 3.0, after: float = 3.0, least: float = 2.0) -> tuple[Column, Column]:
    """[max(0, at - before), min(length, at + after)]; if shorter than least, the start alone is moved back."""
    start, end = F.greatest(F.lit(0.0), at - before), F.least(length, at + after)
    return F.when(end - start < least, F.greatest(F.lit(0.0), end - least)).otherwise(start), end


def chunk_seconds(length: Column, options: tuple[int, ...] = (5, 10, 15, 20, 30), most: int = 10) -> Column:
    """The first option that makes at most so many chunks, else the last; the first for an unknown length."""
    out = F.when(length.isNull(), options[0])
    for o in options[:-1]:
        out = out.when(length / o <= most, o)
    return out.otherwise(options[-1])


def chunks(length: Column, size: Column) -> Column:
    """Array of (index, start, end); a tail under a second is dropped."""
    n = F.greatest(F.floor((length - 1) / size).cast("int"), F.lit(-1))
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("index"), (i * size).cast("double").alias("start"), F.least(length, (i + 1) * size).cast("double").alias("end")))


def frame_times(length: Column, fps: float = 0.5, most: int = 60) -> Column:
    """Evenly spread times of max(1, min(int(length * fps), most)) frames, none at the ends."""
    n = F.greatest(F.lit(1), F.least((length * fps).cast("int"), F.lit(most)))
    return F.transform(F.sequence(F.lit(1), n), lambda i: i * length / (n + 1))
