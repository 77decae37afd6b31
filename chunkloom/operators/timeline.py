"""Operators over frames and packets in presentation order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def cumulative_bytes(packets: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """keys, frame, cum: bytes before each frame, and after the last; frame 0 has 0. order must be total (add the decode index)."""
    w = _order(keys, order)
    frame = F.row_number().over(w).cast("long").alias("frame")
    summed = packets.select(*keys, frame, F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("cum"))
    zero = packets.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("frame"), F.lit(0).cast("long").alias("cum"))
    return summed.unionByName(zero)


def presentation_order_known(packets: DataFrame, keys: list[str], pts: str = "pts") -> DataFrame:
    """keys, usable: a stream's timestamps are all there or all missing."""
    return packets.groupBy(*keys).agg(F.count("*").alias("n"), F.count(pts).alias("m")).select(*keys, ((F.col("m") == 0) | (F.col("m") == F.col("n"))).alias("usable"))


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the last value that wasn't null, in order; filter afterwards, so that dropped rows still hand theirs on."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(_order(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def frame_rate_kind(frames: DataFrame, keys: list[str], t: str, step: Column, order: list[str]) -> DataFrame:
    """keys, kind: 'constant' if every time is within half a step of its place, else 'variable' if times rise strictly, else 'unordered' (to be treated as constant)."""
    w = _order(keys, order)
    rows = frames.select(*keys, (F.col(t) - F.first(t).over(w)).alias("t"), (F.row_number().over(w) - 1).alias("i"), step.alias("step"), F.lag(t).over(w).alias("p"), F.col(t).alias("now"))
    return rows.groupBy(*keys).agg(
        F.when(F.bool_and(F.abs(F.col("t") - F.col("i") * F.col("step")) * 2 <= F.col("step")), "constant")
        .when(F.bool_and(F.coalesce(F.col("now") > F.col("p"), F.lit(True))), "variable")
        .otherwise("unordered")
        .alias("kind")
    )


def take_while(rows: DataFrame, keys: list[str], order: list[str], holds: Column) -> DataFrame:
    """keys, n: rows before the first one that doesn't hold (null doesn't)."""
    w = _order(keys, order)
    numbered = rows.select(*keys, F.row_number().over(w).alias("r"), F.coalesce(holds, F.lit(False)).alias("ok"))
    first_bad = F.min(F.when(~F.col("ok"), F.col("r")))
    return numbered.groupBy(*keys).agg(F.coalesce(first_bad - 1, F.count("*")).cast("long").alias("n"))


def take_while_cover(rows: DataFrame, keys: list[str], order: list[str], size: str, skip: int) -> DataFrame:
    """keys, n: rows taken while what is covered plus half the next stays below skip; ends at a missing or non-positive size."""
    w = _order(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.select(*keys, *[c for c in order if c not in keys], F.col(size).alias("__s"), F.coalesce(F.sum(size).over(w), F.lit(0)).alias("__before"))
    return take_while(before, keys, order, (F.col("__s") > 0) & (2 * F.col("__before") + F.col("__s") < 2 * skip))


def first_time(packets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first: the earliest pts, or the earliest dts if any pts is missing."""
    return packets.groupBy(*keys).agg(F.when(F.bool_and(F.col("pts").isNotNull()), F.min("pts")).otherwise(F.min("dts")).alias("first"))


def rebased(frames: DataFrame, keys: list[str], t: str, order: list[str]) -> DataFrame:
    return frames.withColumn(t, F.col(t) - F.first(t).over(_order(keys, order)))


def realignment(expected: Column, actual: Column, tolerance: int = 1) -> Column:
    """Struct of shift (milliseconds to add, 0 within the tolerance) and lead (how far others must wait for a negative one)."""
    gap = expected - actual
    shift = F.when(F.abs(gap) <= tolerance, F.lit(0)).otherwise(gap).cast("long")
    return F.struct(shift.alias("shift"), F.greatest(-shift, F.lit(0).cast("long")).alias("lead"))


def track_order(tracks: DataFrame, keys: list[str], order: list) -> DataFrame:
    """tracks with their place (from 0) in the output."""
    return tracks.withColumn("position", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def numbered_concat(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Concatenated chunks with timestamps counted anew from 0."""
    return parts.withColumn("pts", (F.row_number().over(_order(keys, order)) - 1).cast("long"))


def timecodes(frames: DataFrame, keys: list[str], t: str, offset_ms: int = 0) -> DataFrame:
    return frames.withColumn("line", F.format_string("%.3f", F.col(t).cast("double") + F.lit(float(offset_ms))))


def islands(rows: DataFrame, keys: list[str], order: list[str], hit: Column, least: int) -> DataFrame:
    """keys, first_frame, n: runs of at least so many rows in a row that hit."""
    w = _order(keys, order)
    marked = rows.select(*keys, *[c for c in order if c not in keys], F.row_number().over(w).alias("__r"), F.coalesce(hit, F.lit(False)).alias("__h"))
    inner = marked.where("__h").withColumn("__g", F.col("__r") - F.row_number().over(w))
    return inner.groupBy(*keys, "__g").agg((F.min("__r") - 1).cast("long").alias("first_frame"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__g")


def write_timecodes(frames: DataFrame, keys: list[str], t: str, order: list[str], path: str, offset_ms: int = 0) -> None:
    """A timecode file of each stream as text in a folder of its own: a head line, then a time a frame, in order. A stream's lines are in one file, as the muxer reads them."""
    head = frames.select(*keys).distinct().withColumn("__k", F.lit(0).cast("long")).withColumn("value", F.lit("# timestamp format v2"))
    lines = timecodes(frames, keys, t, offset_ms).withColumn("__k", F.row_number().over(_order(keys, order)).cast("long")).select(*keys, "__k", F.col("line").alias("value"))
    folders = [F.col(k).alias(f"by_{k}") for k in keys]
    rows = head.unionByName(lines).select(*folders, "__k", "value").repartition(*[f"by_{k}" for k in keys]).sortWithinPartitions(*[f"by_{k}" for k in keys], "__k")
    rows.drop("__k").write.partitionBy(*[f"by_{k}" for k in keys]).text(path)
