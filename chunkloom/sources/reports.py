"""Reports of external tools, as captured text, to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIO = "streams array<struct<index:int,codec_type:string,codec_name:string,profile:string,channels:int,channel_layout:string,sample_rate:string,sample_fmt:string,bits_per_raw_sample:string,id:string,tags:map<string,string>>>"


def streams(reports: DataFrame, keys: list[str], kind: str, text: str = "report") -> DataFrame:
    """keys, ordinal (among those of the kind) and the fields of each stream; unknown fields are ignored, missing ones null."""
    parsed = reports.select(*keys, F.from_json(F.col(text), AUDIO).alias("r"))
    some = F.filter("r.streams", lambda s: s["codec_type"] == kind)
    return parsed.select(*keys, F.posexplode(some).alias("ordinal", "s")).select(*keys, "ordinal", "s.*")


def described(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audio streams with a sample rate and channels, and the rest."""
    ok = F.coalesce((F.col("sample_rate").try_cast("int") > 0) & (F.col("channels") > 0), F.lit(False))
    return rows.where(ok), rows.where(~ok)


def number(text: Column) -> Column:
    """A number that may be a fraction n/d; malformed or divided by zero: 0."""
    parts = F.split(F.trim(text), "/")
    top, bottom = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    return F.coalesce(F.when(F.size(parts) == 2, F.try_divide(top, bottom)).when(F.size(parts) == 1, top), F.lit(0e0))


def frame_rate(average: Column, nominal: Column) -> Column:
    """Struct of num and den: the average rate if it is positive, else the nominal; n or n/d."""

    def pair(t: Column) -> Column:
        n, d = F.get(F.split(t, "/"), 0).try_cast("int"), F.coalesce(F.get(F.split(t, "/"), 1).try_cast("int"), F.when(~F.contains(t, F.lit("/")), 1))
        return F.when((n > 0) & (d > 0), F.struct(n.alias("num"), d.alias("den")))

    return F.coalesce(pair(average), pair(nominal))


def last_match(lines: DataFrame, keys: list[str], line_no: str, pattern: str, names: list[str]) -> DataFrame:
    """keys and the pattern's groups in the last line that matches."""
    hits = lines.where(F.col("line").rlike(pattern))
    last = hits.groupBy(*keys).agg(F.max_by("line", line_no).alias("line"))
    return last.select(*keys, *[F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def field_votes(lines: DataFrame, keys: list[str], line_no: str = "line_no") -> DataFrame:
    found = last_match(lines, keys, line_no, r"Multi frame detection:\s*TFF:\s*(\d+)\s*BFF:\s*(\d+)\s*Progressive:\s*(\d+)", ["tff", "bff", "progressive"])
    return found.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("tff", "bff", "progressive")])


def crop_boxes(lines: DataFrame, keys: list[str], line_no: str = "line_no") -> DataFrame:
    found = last_match(lines, keys, line_no, r"crop=(\d+):(\d+):(\d+):(\d+)", ["w", "h", "x", "y"])
    return found.select(*keys, *[F.col(c).cast("int").alias(c) for c in ("w", "h", "x", "y")])


def banding(reports: DataFrame, keys: list[str], text: str = "report") -> DataFrame:
    """keys, frame, score: of each frame's metrics the one of the prefix that is neither the source's nor the reference's."""
    parsed = reports.select(*keys, F.from_json(F.col(text), "frames array<struct<frameNum:int,metrics:map<string,double>>>").alias("r"))
    frames = parsed.select(*keys, F.explode("r.frames").alias("f"))
    own = F.map_filter("f.metrics", lambda k, _: F.startswith(k, F.lit("cambi")) & ~F.startswith(k, F.lit("cambi_source")) & ~F.startswith(k, F.lit("cambi_full_reference")))
    return frames.select(*keys, F.col("f.frameNum").alias("frame"), F.when(F.size(own) == 1, F.get(F.map_values(own), 0)).alias("score"))


def last_score(text: Column) -> Column:
    """The last value of the last row of a JSON array of arrays."""
    rows = F.from_json(text, "array<array<double>>")
    return F.try_element_at(F.try_element_at(rows, F.lit(-1)), F.lit(-1))
