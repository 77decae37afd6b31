"""Closed frame intervals: cut points to scenes, bounded split, checks, and assignment of frames.

All functions take the key columns, so any number of streams is worked on at once and no window
spans streams. Intervals are closed: a chunk has end - start + 1 frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scenes_from_cuts(cuts: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, index, start_frame, end_frame. cuts: keys, cut; totals: keys, total. Starts are 0 and every distinct cut above 0 (below total); a stream without frames has no scene."""
    inside = cuts.join(totals, keys).where((F.col("cut") > 0) & (F.col("cut") < F.col("total"))).select(*keys, F.col("cut").alias("start_frame"), "total").distinct()
    starts = totals.where(F.col("total") > 0).select(*keys, F.lit(0).cast("long").alias("start_frame"), "total").unionByName(inside)
    w = Window.partitionBy(*keys).orderBy("start_frame")
    return starts.select(
        *keys,
        (F.row_number().over(w) - 1).cast("long").alias("index"),
        "start_frame",
        F.coalesce(F.lead("start_frame").over(w) - 1, F.col("total") - 1).alias("end_frame"),
    )


def bounded_split(scenes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The scenes cut into the fewest parts of at most `most` frames, as even as can be, longer ones first; indexed anew. most of 0 or less leaves them."""
    if most <= 0:
        return scenes
    size = F.expr("end_frame - start_frame + 1")
    n = F.expr(f"(end_frame - start_frame + {most}) div {most}")
    parts = scenes.withColumns({"__n": n, "__size": size}).select("*", F.explode(F.expr("sequence(0L, __n - 1)")).alias("__i"))
    start = F.expr("start_frame + __i * (__size div __n) + least(__i, __size % __n)")
    length = F.expr("__size div __n + if(__i < __size % __n, 1, 0)")
    out = parts.select(*keys, start.alias("start_frame"), (start + length - 1).alias("end_frame"))
    return reindexed(out, keys)


def reindexed(scenes: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start_frame")
    return scenes.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("index"), "start_frame", "end_frame")


def effective_most(frames: Column, seconds: Column, fps: Column) -> Column:
    """The frame limit of a chunk: frames if set, else seconds at this rate (24 at least), else none."""
    return F.when(frames > 0, frames.cast("long")).when(seconds > 0, F.greatest(F.lit(24).cast("long"), F.round(seconds * fps).cast("long")))


def violations(scenes: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, violations: gaps, overlaps, empty scenes and uncovered ends of each stream (0: the scenes cover it exactly)."""
    w = Window.partitionBy(*keys).orderBy("index")
    steps = scenes.select(*keys, "start_frame", "end_frame", F.coalesce(F.lag("end_frame").over(w) + 1, F.lit(0).cast("long")).alias("due"))
    bad = steps.groupBy(*keys).agg(F.count_if((F.col("start_frame") != F.col("due")) | (F.col("end_frame") < F.col("start_frame"))).alias("steps"), F.max("end_frame").alias("last"))
    both = totals.join(bad, keys, "left")
    return both.select(*keys, (F.coalesce("steps", F.lit(0)) + F.when(F.coalesce(F.col("last") + 1, F.lit(0)) != F.col("total"), 1).otherwise(0)).cast("long").alias("violations"))


def clamped(scenes: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes beyond the stream dropped, ends cut to it, the last one drawn out to its end."""
    w = Window.partitionBy(*keys).orderBy(F.col("index").desc())
    inside = scenes.join(totals, keys).where(F.col("start_frame") < F.col("total"))
    end = F.when(F.row_number().over(w) == 1, F.col("total") - 1).otherwise(F.least(F.col("end_frame"), F.col("total") - 1))
    return inside.withColumn("end_frame", end).drop("total")


def shifted(scenes: DataFrame, by: int | Column) -> DataFrame:
    """All scenes moved by a leading gap; the first keeps its start."""
    by = F.lit(by) if isinstance(by, int) else by
    return scenes.withColumns({"start_frame": F.when(F.col("index") > 0, F.col("start_frame") + by).otherwise(F.col("start_frame")), "end_frame": F.col("end_frame") + by})


def sample_positions(total: Column, percents: list[int]) -> Column:
    """Array of the frames at these percents of a stream, truncated."""
    return F.transform(F.array(*[F.lit(p).cast("long") for p in percents]), lambda p: F.call_function("floor", total * p / 100).cast("long"))


def assign_frames(frames: DataFrame, scenes: DataFrame, keys: list[str]) -> DataFrame:
    """frames (keys, frame, ...) with the index of the scene each lies in.

    For disjoint, gapless scenes: starts are laid among the frames and carried forward, so there is
    one sort per stream and no range join.
    """
    rest = [c for c in frames.columns if c not in keys]
    marks = scenes.select(*keys, F.col("start_frame").alias("__at"), F.lit(0).alias("__kind"), F.col("index").alias("__index"), F.lit(None).cast(frames.schema["frame"].dataType).alias("frame"))
    both = frames.withColumns({"__at": F.col("frame").cast("long"), "__kind": F.lit(1), "__index": F.lit(None).cast("long")}).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("index", F.last("__index", ignorenulls=True).over(w)).where(F.col("__kind") == 1).select(*keys, *rest, "index")
