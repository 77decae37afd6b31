"""Rectangles, output sizes, filter chains and pixel formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import normalized_crop

#: Pixel formats that the frame header can name, by subsampling and depth.
HEADER_NAMES = {("420", 8): "420", ("420", 10): "420p10", ("420", 12): "420p12", ("422", 8): "422", ("422", 10): "422p10", ("422", 12): "422p12", ("444", 8): "444", ("444", 10): "444p10", ("444", 12): "444p12"}
#: Decoder formats by subsampling and depth.
DECODER_NAMES = {("420", 8): "yuv420p", ("420", 10): "yuv420p10le", ("422", 8): "yuv422p", ("422", 10): "yuv422p10le", ("444", 8): "yuv444p", ("444", 10): "yuv444p10le"}


def even(x: Column) -> Column:
    return x - F.pmod(x, F.lit(2))


def rectangle(w: Column, h: Column, x: Column, y: Column) -> Column:
    return F.struct(*[c.cast("long").alias(n) for c, n in zip((w, h, x, y), "whxy", strict=True)])


def parse_rectangle(text: Column) -> Column:
    """The rectangle of `crop=W:H:X:Y` or `W:H:X:Y`; null if there aren't four whole numbers."""
    parts = F.split(F.regexp_replace(text, "^(crop=)+", ""), ":")
    n = [F.when(F.get(parts, i).rlike("^[+]?[0-9]+$"), F.get(parts, i).try_cast("long")) for i in range(4)]
    return F.when((F.size(parts) == 4) & n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull() & n[3].isNotNull(), rectangle(*n))


def format_rectangle(r: Column) -> Column:
    return F.when(r.isNotNull(), F.concat(F.lit("crop="), F.concat_ws(":", *[r[n].cast("string") for n in "whxy"])))


def visible_rectangle(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """What a player shows of a picture whose container hides its edges; odd edges move inwards, and cuts that leave nothing count as none."""
    w, h, x, y = width - left - right, height - top - bottom, left + left % 2, top + top % 2
    fits = (w > 0) & (h > 0) & (left + w > x + 1) & (top + h > y + 1) & ((left + top + right + bottom) > 0)
    cut = rectangle(even(left + w - x), even(top + h - y), x, y)
    return F.when(fits, cut).otherwise(rectangle(width, height, F.lit(0), F.lit(0)))


def inside(r: Column, visible: Column) -> Column:
    """Whether a rectangle kept from before lies in the visible one and has even edges there."""
    x, y = r["x"] - visible["x"], r["y"] - visible["y"]
    ok = (x >= 0) & (y >= 0) & (r["w"] > 0) & (r["h"] > 0) & (x + r["w"] <= visible["w"]) & (y + r["h"] <= visible["h"])
    for side in (x, y, r["w"], r["h"]):
        ok = ok & (F.pmod(side, F.lit(2)) == 0)
    return F.coalesce(ok, F.lit(False))


def bound(value: Column, use) -> Column:
    """use(value), where value is computed once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def output_geometry(src_w: Column, src_h: Column, crop: Column, target_height: Column, interlaced: Column) -> Column:
    """Struct of crop (null: none) and scale (struct of w, h, or null). crop is text; one that doesn't fit is ignored, an odd picture loses its last column or row, fields keep their order, and only taller pictures are scaled."""
    odd = (src_w % 2 != 0) | (src_h % 2 != 0)
    evened = F.when(odd, rectangle(even(src_w), even(src_h), F.lit(0), F.lit(0)))

    def aligned(cut: Column) -> Column:
        swaps = F.coalesce(interlaced, F.lit(False)) & (cut["y"] % 4 == 2) & (cut["h"] > 2)  # fields alternate by chroma row
        return F.when(swaps, rectangle(cut["w"], cut["h"] - 2, cut["x"], cut["y"] + 2)).otherwise(cut)

    def scaled(cut: Column) -> Column:
        w, h, tall = F.coalesce(cut["w"], src_w.cast("long")), F.coalesce(cut["h"], src_h.cast("long")), even(target_height.cast("long"))
        size = F.struct(even(F.floor((2 * w * tall + h) / (2 * h)).cast("long")).alias("w"), tall.alias("h"))
        return F.struct(cut.alias("crop"), F.when(h > target_height, size).alias("scale"))

    fitted = bound(parse_rectangle(crop), lambda r: normalized_crop(r["w"], r["h"], r["x"], r["y"], src_w, src_h))
    cut = bound(fitted, lambda r: F.coalesce(F.when(r.isNotNull(), rectangle(r["w"], r["h"], r["x"], r["y"])), evened))
    return bound(bound(cut, aligned), scaled)


def filter_chain(crop: Column, deinterlace: Column, scale: Column) -> Column:
    """The picture filters in the order they apply, or null if there is none. deinterlace is the filter's text or null."""
    sized = F.when(scale.isNotNull(), F.concat(F.lit("scale="), scale["w"].cast("string"), F.lit(":"), scale["h"].cast("string")))
    return F.nullif(F.concat_ws(",", format_rectangle(crop), deinterlace, sized), F.lit(""))


def moves_chroma(mirror: Column, siting: Column, subsampling: Column) -> Column:
    """Whether a mirror puts chroma at the far edge of its pair."""
    over = (subsampling == "420") & (F.startswith(siting, F.lit("top")) | F.startswith(siting, F.lit("bottom")))
    across = (subsampling != "444") & F.endswith(siting, F.lit("left"))
    return F.coalesce(F.when(mirror == "horizontal", across).when(mirror == "vertical", over), F.lit(False))


def _named(names: dict[tuple[str, int], str], subsampling: Column, depth: Column) -> Column:
    table = F.create_map(*[F.lit(x) for (sub, bits), name in names.items() for x in (f"{sub}/{bits}", name)])
    return F.try_element_at(table, F.concat_ws("/", subsampling, depth.cast("string")))


def header_colorspace(subsampling: Column, depth: Column) -> Column:
    """The frame header's name of a format; those it can't name are 8-bit 4:2:0."""
    return F.coalesce(_named(HEADER_NAMES, subsampling, depth), F.lit("420"))


def decoder_format(subsampling: Column, depth: Column) -> Column:
    return _named(DECODER_NAMES, subsampling, depth)


def output_shape(subsampling: Column, depth: Column, target_depth: Column, keep_subsampling: Column) -> Column:
    """Struct of depth and subsampling as encoded: the depth asked for, else the source's up to 10; 4:2:0 unless kept."""
    return F.struct(F.coalesce(target_depth, F.least(depth, F.lit(10))).cast("int").alias("depth"), F.when(keep_subsampling, subsampling).otherwise("420").alias("subsampling"))


def conversion_notes(subsampling: Column, depth: Column, target_depth: Column) -> Column:
    """Array of what the encode changes about the samples."""
    out = output_shape(subsampling, depth, target_depth, F.lit(False))
    bits = F.concat(F.lit("bit-depth conversion: "), depth.cast("string"), F.lit("-bit to "), out["depth"].cast("string"), F.lit("-bit"))
    chroma = F.concat(F.lit("chroma conversion: "), subsampling, F.lit(" to "), out["subsampling"])
    return F.array_compact(F.array(F.when(out["depth"] != depth, bits), F.when(subsampling != out["subsampling"], chroma)))


def classify_pixels(components: Column, log2_w: Column, log2_h: Column, depth: Column, rgb: Column) -> Column:
    """Struct of subsampling (420, 422, 444; other shifts null), depth, gray and not_yuv from a pixel descriptor."""
    gray = components < 3
    sub = F.when(gray | ((log2_w == 1) & (log2_h == 1)), "420").when((log2_w == 1) & (log2_h == 0), "422").when((log2_w == 0) & (log2_h == 0), "444")
    return F.struct(sub.alias("subsampling"), depth.alias("depth"), gray.alias("gray"), (gray | rgb).alias("not_yuv"))


def uses_reference(scale: Column, mirror: Column) -> Column:
    return scale.isNotNull() | mirror.isNotNull()


def measurable(deinterlace: Column, scale: Column, mirror: Column) -> Column:
    """A deinterlaced encode can only be measured against a reference of its own."""
    return deinterlace.isNull() | uses_reference(scale, mirror)


def display_model(name: str, width: Column, height: Column, diagonal: Column, hdr: Column, distance: float = 0.75) -> Column:
    """The display's description as JSON; HDR and SDR displays differ in luminance, contrast and surroundings."""
    def pick(yes: float, no: float) -> Column:
        return F.when(hdr, F.lit(yes)).otherwise(F.lit(no))

    fields = [
        F.array(width, height).alias("resolution"), F.when(hdr, "HDR").otherwise("sRGB").alias("colorspace"), F.lit(distance).alias("viewing_distance_meters"),
        F.round(diagonal, 3).alias("diagonal_size_inches"), pick(1500, 200).alias("max_luminance"), pick(1_000_000, 1000).alias("contrast"), pick(10, 250).alias("E_ambient"), F.lit(0.005).alias("k_refl"),
    ]
    return F.to_json(F.struct(F.struct(F.lit(name).alias("name"), *fields).alias(name)))
