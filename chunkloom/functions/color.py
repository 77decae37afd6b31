"""Color descriptions: names to public code points (ITU-T H.273), classes and readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of ITU-T H.273.
PRIMARIES = {"bt709": 1, "bt470m": 4, "bt470bg": 5, "smpte170m": 6, "smpte240m": 7, "film": 8, "bt2020": 9, "smpte428": 10, "smpte431": 11, "smpte432": 12, "ebu3213": 22}
TRANSFER = {
    "bt709": 1, "bt470m": 4, "bt470bg": 5, "smpte170m": 6, "smpte240m": 7, "linear": 8, "log100": 9, "log316": 10, "iec61966-2-4": 11, "bt1361e": 12, "iec61966-2-1": 13,
    "bt2020-10": 14, "bt2020-12": 15, "smpte2084": 16, "smpte428": 17, "arib-std-b67": 18,
}
MATRIX = {"gbr": 0, "bt709": 1, "fcc": 4, "bt470bg": 5, "smpte170m": 6, "smpte240m": 7, "ycgco": 8, "bt2020nc": 9, "bt2020c": 10, "smpte2085": 11, "chroma-derived-nc": 12, "chroma-derived-c": 13, "ictcp": 14}
RANGE = {"tv": 0, "pc": 1}
CHROMA = {"left": 1, "topleft": 2}


def code(name: Column, codes: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), name)


def hdr_kind(dolby: Column, plus: Column, transfer: Column) -> Column:
    return F.when(dolby, "dolby_vision").when(plus, "hdr10plus").when(transfer == "smpte2084", "pq").when(transfer == "arib-std-b67", "hlg").otherwise("sdr")


def known(stream: Column, frame: Column) -> Column:
    """The stream's value, or the first frame's where the stream's is missing or unknown."""
    return F.coalesce(F.nullif(stream, F.lit("unknown")), F.nullif(frame, F.lit("unknown")))


def missing_static(transfer: Column, mastering: Column, light: Column) -> Column:
    """Names of the static metadata a PQ stream lacks."""
    lacks = F.array_compact(F.array(F.when(mastering.isNull(), F.lit("mastering display")), F.when(light.isNull(), F.lit("content light level"))))
    return F.when(transfer == "smpte2084", lacks).otherwise(F.slice(lacks, 1, 0))


def same_picture(a: Column, b: Column) -> Column:
    """Structs of family, transfer, primaries, matrix, range: alike; where a is RGB by family only transfer and primaries count."""
    return a["transfer"].eqNullSafe(b["transfer"]) & a["primaries"].eqNullSafe(b["primaries"]) & (F.coalesce(F.upper(a["family"]) == "RGB", F.lit(False)) | (a["matrix"].eqNullSafe(b["matrix"]) & a["range"].eqNullSafe(b["range"])))


def untagged_flags(args: Column, is_yuv: Column, source_height: Column, output_height: Column) -> Column:
    """Flags and values (BT.709) that an untagged picture needs when a source of over 650 lines becomes one of 650 or fewer; args is an array of the flags already there."""
    needed = is_yuv & (source_height > 650) & (output_height <= 650) & ~F.array_contains(args, "--matrix-coefficients")
    flags = F.array(*[F.lit(f"--{x}") for x in ("color-primaries", "transfer-characteristics", "matrix-coefficients")])
    given = F.flatten(F.transform(F.array_except(flags, args), lambda f: F.array(f, F.lit("1"))))
    return F.when(needed, given).otherwise(F.slice(flags, 1, 0))


def normalized_crop(w: Column, h: Column, x: Column, y: Column, src_w: Column, src_h: Column) -> Column:
    """The rectangle with even sides and corners; null if it is empty or leaves the picture."""
    even = [c - c % 2 for c in (w, h, x, y)]
    ok = (even[0] > 0) & (even[1] > 0) & (even[2] + even[0] <= src_w) & (even[3] + even[1] <= src_h)
    return F.when(ok, F.struct(*[c.alias(n) for c, n in zip(even, "whxy", strict=True)]))


def display_size(w: Column, h: Column, num: Column, den: Column) -> Column:
    """Width and height as shown: the width is scaled by the sample aspect ratio, rounded half up; ratios that aren't positive change nothing."""
    wide = F.when((num > 0) & (den > 0), F.call_function("floor", (2 * w.cast("long") * num + den) / (2 * den)).cast("long")).otherwise(w.cast("long"))
    return F.struct(wide.alias("w"), h.cast("long").alias("h"))


def key_interval(fps: Column, seconds: int = 5) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.round(fps * seconds).cast("long"))


def rate_divisor(fps: Column, most: Column) -> Column:
    return F.when(fps > most, F.ceil(fps / most)).otherwise(F.lit(1)).cast("long")
