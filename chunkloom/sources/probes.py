"""Probes of whole files, as captured text, to rows: video streams, packets, tracks, comparisons, machine limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import frame_rate
from chunkloom.functions import geometry

VIDEO = """streams array<struct<avg_frame_rate:string,r_frame_rate:string,start_time:string,sample_aspect_ratio:string,side_data_list:array<struct<crop_top:bigint,crop_bottom:bigint,crop_left:bigint,crop_right:bigint>>>>,
  format struct<format_name:string,start_time:string>"""
PACKETS = "packets array<struct<pts:bigint,dts:bigint,size:string,flags:string>>"
TRACKS = "tracks array<struct<id:bigint,type:string,properties:struct<number:bigint,language:string,language_ietf:string>>>"
#: Lines of a comparison's reading and the fields they fill.
READING = {"Color Family": "family", "Range": "range", "YUV Matrix": "matrix", "Transfer Function": "transfer", "Primaries": "primaries"}


def milliseconds(seconds: Column) -> Column:
    """Text of seconds as whole milliseconds, rounded half away from zero; null if it isn't a number."""
    return F.round(seconds.try_cast("double") * 1000).cast("long")


def video_streams(reports: DataFrame, keys: list[str], text: str = "report") -> DataFrame:
    """keys, fps (num and den, null if no rate is usable), offset_ms, container_start_ms (of Matroska files, else 0), sar_num, sar_den and the container's cuts left, top, right, bottom of the first video stream."""
    rows = reports.select(*keys, F.from_json(F.col(text), VIDEO).alias("r")).withColumn("v", F.try_element_at("r.streams", F.lit(1))).where(F.col("v").isNotNull())
    start = F.coalesce(milliseconds(F.col("r.format.start_time")), F.lit(0).cast("long"))
    own = F.coalesce(milliseconds(F.col("v.start_time")), start)
    ratio = F.split("v.sample_aspect_ratio", ":")
    num, den = (F.get(ratio, k).try_cast("int") for k in (0, 1))
    both = (F.size(ratio) == 2) & num.isNotNull() & den.isNotNull()
    cut = F.get(F.filter(F.coalesce("v.side_data_list", F.array().cast("array<struct<crop_top:bigint,crop_bottom:bigint,crop_left:bigint,crop_right:bigint>>")), lambda s: s["crop_top"].isNotNull()), 0)
    edges = [F.coalesce(cut[f"crop_{side}"], F.lit(0)).alias(side) for side in ("left", "top", "right", "bottom")]
    return rows.select(
        *keys, frame_rate(F.col("v.avg_frame_rate"), F.col("v.r_frame_rate")).alias("fps"), F.greatest(own - start, F.lit(0).cast("long")).alias("offset_ms"),
        F.when(F.contains("r.format.format_name", F.lit("matroska")), start).otherwise(0).cast("long").alias("container_start_ms"), F.when(both, num).alias("sar_num"), F.when(both, den).alias("sar_den"), *edges,
    )


def visible_pictures(streams: DataFrame, width: Column, height: Column) -> DataFrame:
    """streams (of video_streams) with visible, the rectangle that a player shows."""
    return streams.withColumn("visible", geometry.visible_rectangle(width, height, *[F.col(side) for side in ("left", "top", "right", "bottom")]))


def packets(reports: DataFrame, keys: list[str], text: str = "report") -> DataFrame:
    """keys, ordinal (in decoding order), pts, dts, size, flags of each packet; a file's report is one row and is opened where it lies."""
    rows = reports.select(*keys, F.posexplode(F.from_json(F.col(text), PACKETS)["packets"]).alias("ordinal", "p"))
    return rows.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), "p.pts", "p.dts", F.col("p.size").try_cast("long").alias("size"), F.coalesce("p.flags", F.lit("")).alias("flags"))


def identified_tracks(reports: DataFrame, keys: list[str], kind: str, text: str = "report") -> DataFrame:
    """keys, ordinal (among those of the kind), track, number, legacy, ietf of each track that the muxer lists."""
    own = F.filter(F.from_json(F.col(text), TRACKS)["tracks"], lambda t: t["type"] == kind)
    rows = reports.select(*keys, F.posexplode(own).alias("ordinal", "t"))
    return rows.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), F.col("t.id").alias("track"), "t.properties.number", F.col("t.properties.language").alias("legacy"), F.col("t.properties.language_ietf").alias("ietf"))


def stream_number(ident: Column) -> Column:
    """A stream's id (hexadecimal text) as a number; null if it isn't one."""
    bare = F.regexp_replace(ident, "^(0x)+", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(bare, 16, 10).try_cast("long"))


def has_chapters(text: Column) -> Column:
    return F.coalesce(F.size(F.from_json(text, "chapters array<string>")["chapters"]) > 0, F.lit(False))


def readings(lines: DataFrame, keys: list[str], line_no: str = "line_no", sections: tuple[str, str] = ("Source", "Encoded")) -> DataFrame:
    """keys, source, encoded: structs of family, range, matrix, transfer, primaries from a comparison's report; files whose report lacks a field on either side have no row. A section begins at the line with its name; fields are `name: value`."""
    w = Window.partitionBy(*keys).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    name, value = F.trim(F.substring_index("line", ":", 1)), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    begins = F.coalesce(*[F.when(F.startswith(F.trim("line"), F.lit(s)), s) for s in sections])
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in READING.items() for x in pair]), name)
    rows = lines.select(*keys, line_no, F.last(begins, ignorenulls=True).over(w).alias("section"), F.when(F.contains("line", F.lit(":")), known).alias("field"), value.alias("value")).where("section is not null and field is not null and value <> ''")

    def side(section: str, field: str) -> Column:
        return F.max_by(F.when((F.col("section") == section) & (F.col("field") == field), F.col("value")), F.when((F.col("section") == section) & (F.col("field") == field), F.col(line_no)))

    parts = [(s, f) for s in sections for f in READING.values()]
    found = rows.groupBy(*keys).agg(*[side(s, f).alias(f"__{s}_{f}") for s, f in parts]).dropna(subset=[f"__{s}_{f}" for s, f in parts])
    return found.select(*keys, *[F.struct(*[F.col(f"__{s}_{f}").alias(f) for f in READING.values()]).alias(alias) for s, alias in zip(sections, ("source", "encoded"), strict=True)])


def available_gib(meminfo: Column) -> Column:
    """GiB that a machine says are available; null if it says nothing."""
    return F.nullif(F.regexp_extract(meminfo, r"(?m)^MemAvailable:\s*([0-9]+) kB", 1), F.lit("")).cast("double") / (1 << 20)


def group_headroom(limit: Column, used: Column, reclaimable: Column) -> Column:
    """GiB that a control group leaves: its limit (`max`: none) less what is used and can't be reclaimed."""
    left = limit.try_cast("long") - (used.try_cast("long") - F.coalesce(reclaimable.try_cast("long"), F.lit(0)))
    return F.when(F.trim(limit) != "max", F.greatest(left, F.lit(0)).cast("double") / (1 << 30))
