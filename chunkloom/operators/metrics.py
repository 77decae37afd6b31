"""Aggregations of sampled measurements and of finished work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounding_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, w, h: the smallest rectangle that holds all of a group's."""
    edges = boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("__r"), F.max(F.col("y") + F.col("h")).alias("__b"))
    return edges.select(*keys, "x", "y", (F.col("__r") - F.col("x")).alias("w"), (F.col("__b") - F.col("y")).alias("h"))


def plausible_bars(w: Column, h: Column, x: Column, y: Column, src_w: Column, src_h: Column) -> Column:
    """Struct of use and cacheable for a united crop: under 40 % of the picture, or off centre by more than the slack, it isn't believed; 99 % or more, or no box at all, is surely no crop."""

    def centred(begin: Column, size: Column, total: Column) -> Column:
        rest = F.greatest(total - begin - size, F.lit(0))
        return F.abs(begin - rest) <= F.greatest(F.call_function("floor", total / 20), F.lit(8))

    share, there = w * h * 100 / (src_w * src_h), w.isNotNull() & h.isNotNull()
    believed = (share >= 40) & centred(x, w, src_w) & centred(y, h, src_h)
    return F.struct(F.coalesce(there & believed & (share < 99), F.lit(False)).alias("use"), F.coalesce(~there | believed, F.lit(False)).alias("cacheable"))


def sample_outcome(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outcome of samples with a status ('ok', 'none', 'failed', 'transient'): any transient is an error, nothing but failures too; partial results are used and not cached."""
    n = {s: F.count_if(F.col("status") == s) for s in ("ok", "none", "failed", "transient")}
    return samples.groupBy(*keys).agg(
        F.when(n["transient"] > 0, "error").when((n["ok"] == 0) & (n["failed"] > 0), "error").when(n["ok"] == 0, "nothing").when(n["failed"] > 0, "uncached").otherwise("cached").alias("outcome")
    )


def verdict(first: Column, second: Column, names: tuple[str, str] = ("tff", "bff"), least: int = 20, factor: int = 4) -> Column:
    """The name of the side that has at least so many votes and so many times the other's; null if neither. A tie is the first's."""
    major, minor = F.greatest(first, second), F.least(first, second)
    return F.when((major >= least) & (major >= factor * minor), F.when(first >= second, names[0]).otherwise(names[1]))


def nearest_rank(values: DataFrame, keys: list[str], value: str, percent: int = 95) -> DataFrame:
    """keys, p: the element of rank ceil(n * percent / 100); 0 for a group of nulls."""
    return values.groupBy(*keys).agg(F.coalesce(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY `{value}`)"), F.lit(0e0)).alias("p"))


#: Just above one half: the discrete percentile is then the upper median, for up to ten thousand million rows.
UPPER = 0.5000000001


def summary(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, least, most, upper_median."""
    return values.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.expr(f"percentile_disc({UPPER}) WITHIN GROUP (ORDER BY `{value}`)").alias("upper_median"))


def lowest_score(solved: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest score, measured where it was, else probed."""
    return solved.groupBy(*keys).agg(F.min(F.coalesce("measured", "jod")).alias("lowest"))


def widest_layout(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, layout, channels: the layout of most channels (the last of equals), only for groups whose samples differ."""
    top = samples.groupBy(*keys).agg(F.max(F.struct("channels", "seq", "layout")).alias("t"), F.count_distinct("layout", "channels").alias("n"))
    return top.where(F.col("n") > 1).select(*keys, F.col("t.layout").alias("layout"), F.col("t.channels").alias("channels"))


def worker_split(cores: Column, ram_gib: Column, megapixels: Column, threads: Column) -> Column:
    """Workers that fit: one at least, as many as the threads allow, 1.5 GiB a megapixel each; a picture without pixels needs no memory."""
    by_ram = F.floor(F.try_divide(ram_gib, F.nullif(megapixels, F.lit(0e0)) * F.lit(1.5e0))).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.least(F.floor(cores / threads).cast("long"), by_ram))


def throughput(frames: Column, seconds: Column) -> Column:
    return F.try_divide(frames.cast("double"), seconds.cast("double"))


def format_size(n: Column) -> Column:
    """Bytes as text: binary megabytes with one decimal, from 1024 of them on gigabytes with two."""
    mb = n / F.lit(float(1 << 20))
    return F.when(mb < 1024, F.format_string("%.1f MB", mb)).otherwise(F.format_string("%.2f GB", mb / 1024))


def format_duration(seconds: Column) -> Column:
    """Seconds as 7s, 3m07s or 1h02m."""
    s = seconds.cast("long")
    hours, minutes = F.expr("0L") + F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60
    return F.when(hours > 0, F.format_string("%dh%02dm", hours, minutes)).when(minutes > 0, F.format_string("%dm%02ds", minutes, s % 60)).otherwise(F.format_string("%ds", s))
