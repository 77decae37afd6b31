"""Decisions about a picture from sampled measurements: crop, fields, color and HDR metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from chunkloom.functions import color, geometry
from chunkloom.sources.reports import number


def crop_decision(samples: DataFrame, pictures: DataFrame, keys: list[str]) -> DataFrame:
    """keys, crop (text or null), outcome ('cached', 'crop', 'none', 'error') and keep (whether to remember it).

    samples: keys, status, w, h, x, y (relative to what is visible). pictures: keys, visible (a
    rectangle) and cached (what was remembered: empty for no bars, null for nothing). Samples are
    united; what isn't plausible is neither used nor kept, nor is what misses samples.
    """
    known = F.trim("cached")
    kept = geometry.parse_rectangle(known)
    remembered = F.when(known == "", F.lit("none")).when(geometry.inside(kept, F.col("visible")), F.lit("cached"))
    state = pictures.select(*keys, "visible", "cached", remembered.alias("remembered"), kept.alias("kept"))
    fresh = samples.join(state.where(F.col("remembered").isNull()).select(*keys), keys, "left_semi")
    outcome = metrics.sample_outcome(fresh, keys)
    union = metrics.bounding_box(fresh.where("status = 'ok'"), keys)
    both = state.join(outcome, keys, "left").join(union, keys, "left")
    vw, vh = F.col("visible.w"), F.col("visible.h")
    whole = color.normalized_crop(F.col("w"), F.col("h"), F.col("x"), F.col("y"), vw, vh)
    judged = both.withColumn("u", whole).withColumn("bars", metrics.plausible_bars(F.col("u.w"), F.col("u.h"), F.col("u.x"), F.col("u.y"), vw, vh))
    found = geometry.format_rectangle(geometry.rectangle(F.col("u.w"), F.col("u.h"), F.col("u.x") + F.col("visible.x"), F.col("u.y") + F.col("visible.y")))
    fine = F.coalesce(F.col("outcome").isin("cached", "uncached"), F.lit(False))
    use = fine & F.col("bars.use")
    return judged.select(
        *keys,
        F.when(F.col("remembered") == "cached", geometry.format_rectangle(F.col("kept"))).when(use, found).alias("crop"),
        F.coalesce(F.col("remembered"), F.when(F.col("outcome") == "error", "error").when(use, "crop").otherwise("none")).alias("outcome"),
        F.coalesce(F.col("remembered").isNull() & (F.col("outcome") == "cached") & F.col("bars.cacheable"), F.lit(False)).alias("keep"),
    )


def field_order(windows: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fields ('tff', 'bff' or null), measured. sources: keys, flagged, cached ('progressive', 'tff', 'bff' or null); windows: keys, tff, bff. Only flagged sources without a remembered answer are measured."""
    known = F.trim("cached").isin("progressive", "tff", "bff")
    asked = sources.where(F.col("flagged") & ~F.coalesce(known, F.lit(False))).select(*keys)
    votes = windows.join(asked, keys, "left_semi").groupBy(*keys).agg(F.sum("tff").alias("tff"), F.sum("bff").alias("bff"))
    both = sources.join(votes, keys, "left")
    told = F.coalesce(known, F.lit(False))
    fields = F.when(told, F.when(F.trim("cached") != "progressive", F.trim("cached"))).when(F.col("flagged"), metrics.verdict(F.col("tff"), F.col("bff")))
    return both.select(*keys, fields.alias("fields"), (~told & F.col("flagged")).alias("measured"))


# -- color and HDR -----------------------------------------------------------------------------------


def color_description(stream: Column, frame: Column) -> Column:
    """Struct of primaries, transfer, matrix names: the first frame's PQ or HLG transfer wins, and then its other names too; else the frame fills what the stream leaves unknown. Both: structs of primaries, transfer, matrix."""
    told = F.when(frame["transfer"].isin("smpte2084", "arib-std-b67"), frame["transfer"])
    by_frame = F.coalesce(told != F.coalesce(stream["transfer"], F.lit("")), F.lit(False))

    def name(part: str) -> Column:
        said, seen = F.coalesce(stream[part], F.lit("")), F.nullif(F.nullif(frame[part], F.lit("unknown")), F.lit(""))
        return F.when(by_frame & seen.isNotNull(), seen).when(said.isin("", "unknown") & frame[part].isNotNull(), frame[part]).otherwise(said)

    return F.struct(name("primaries").alias("primaries"), F.coalesce(told, stream["transfer"], F.lit("")).alias("transfer"), name("matrix").alias("matrix"))


def chroma_position(siting: Column, log2_w: Column, log2_h: Column, not_yuv: Column) -> Column:
    """The code of the chroma siting after conversion to 4:2:0: none for full-width chroma or none at all, the left edge for full-height chroma."""
    code = color.code(siting, color.CHROMA)
    return F.when(F.coalesce(not_yuv | (log2_w == 0), F.lit(False)), F.lit(None)).when((code == 2) & F.coalesce(log2_h == 0, F.lit(False)), 1).otherwise(code)


def chroma_name(position: Column, centered: Column) -> Column:
    return F.when(centered, "center").when(position == 2, "topleft").otherwise("left")


def color_args(c: dict[str, Column], not_yuv: Column) -> Column:
    """The encoder's color flags and values (array), those known in a fixed order; pictures that aren't YUV are converted by matrix 5 and have no siting or range. c: primaries, transfer, matrix, chroma, range (codes)."""
    matrix = F.when(not_yuv, F.lit(5)).otherwise(c["matrix"])
    rest = {k: F.when(~not_yuv, c[k]) for k in ("chroma", "range")}
    flags = (("--color-primaries", c["primaries"]), ("--transfer-characteristics", c["transfer"]), ("--matrix-coefficients", matrix), ("--chroma-sample-position", rest["chroma"]), ("--color-range", rest["range"]))
    return F.flatten(F.array_compact(F.array(*[F.when(v.isNotNull(), F.array(F.lit(k), v.cast("string"))) for k, v in flags])))


def flag_value(args: Column, flag: str) -> Column:
    """The value after a flag in an array of flags and values."""
    at = F.array_position(args, flag)
    return F.when(at > 0, F.try_element_at(args, (at + 1).cast("int")))


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", x), r"0+$", ""), r"\.$", "")


def mux_color_args(args: Column, track: Column) -> Column:
    """The muxer's options for a track from the encoder's flags: color, siting, light levels and mastering display."""
    def num(flag: str) -> Column:
        return flag_value(args, flag).try_cast("int")

    def option(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.array(F.lit(name), F.concat(track.cast("string"), F.lit(":"), value)))

    prim, trc, mat, full = num("--color-primaries"), num("--transfer-characteristics"), num("--matrix-coefficients"), F.coalesce(num("--color-range") == 1, F.lit(False))
    told = prim.isNotNull() | trc.isNotNull() | mat.isNotNull()
    siting = F.when(num("--chroma-sample-position") == 1, "1,2").when(num("--chroma-sample-position") == 2, "1,1")
    light = F.split(flag_value(args, "--content-light"), ",", 2)
    md = flag_value(args, "--mastering-display")
    pairs = {}
    for label in ("G", "B", "R", "WP", "L"):
        inner = F.split(F.regexp_extract(md, rf"(?:^|\)){label}\(([^)]*)\)", 1), ",")
        pairs[label] = [F.trim(F.get(inner, k)).try_cast("double") for k in (0, 1)]
    ok = pairs["L"][1].isNotNull()
    for two in pairs.values():
        for x in two:
            ok = ok & x.isNotNull()
    shown = F.concat_ws(",", *[_plain(x) for label in ("R", "G", "B") for x in pairs[label]])
    return F.flatten(
        F.array_compact(
            F.array(
                option("--color-matrix-coefficients", mat.cast("string")),
                option("--color-transfer-characteristics", trc.cast("string")),
                option("--color-primaries", prim.cast("string")),
                option("--color-range", F.when(told | full, F.when(full, "2").otherwise("1"))),
                option("--chroma-siting", siting),
                option("--max-content-light", F.when(F.size(light) == 2, F.trim(F.get(light, 0)))),
                option("--max-frame-light", F.when(F.size(light) == 2, F.trim(F.get(light, 1)))),
                option("--chromaticity-coordinates", F.when(ok, shown)),
                option("--white-color-coordinates", F.when(ok, F.concat_ws(",", *[_plain(x) for x in pairs["WP"]]))),
                option("--max-luminance", F.when(ok, _plain(pairs["L"][0]))),
                option("--min-luminance", F.when(ok, _plain(pairs["L"][1]))),
            )
        )
    )


def _text(x: Column) -> Column:
    """A double as short as it can be, whole numbers without a point."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def static_metadata(side_data: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, light, mastering: the first complete light level (max, average) and mastering display (all ten numbers) in order; fractions n/d are divided. side_data: keys, order, max_content, max_average, red_x ... white_point_y, min_luminance, max_luminance (text)."""
    n = {c: number(F.col(c)) for c in ("red_x", "red_y", "green_x", "green_y", "blue_x", "blue_y", "white_point_x", "white_point_y", "min_luminance", "max_luminance")}
    whole = F.col("max_content").isNotNull() & F.col("max_average").isNotNull()
    level = F.concat_ws(",", *[F.coalesce(F.col(c).try_cast("long"), F.lit(0)).cast("string") for c in ("max_content", "max_average")])
    all_ten = F.lit(True)
    for c in n:
        all_ten = all_ten & F.col(c).isNotNull()
    two = lambda a, b: F.concat(F.lit("("), _text(n[a]), F.lit(","), _text(n[b]), F.lit(")"))
    shown = F.concat(F.lit("G"), two("green_x", "green_y"), F.lit("B"), two("blue_x", "blue_y"), F.lit("R"), two("red_x", "red_y"), F.lit("WP"), two("white_point_x", "white_point_y"), F.lit("L"), two("max_luminance", "min_luminance"))
    at = F.struct(*order)
    return side_data.groupBy(*keys).agg(F.min_by(F.when(whole, level), F.when(whole, at)).alias("light"), F.min_by(F.when(all_ten, shown), F.when(all_ten, at)).alias("mastering"))


def unsupported_base_layer(profile: Column, compatibility: Column, unit_profile: Column) -> Column:
    """A base layer in a color space of its own, which no player shows without its metadata."""
    return F.coalesce(profile == 5, F.lit(False)) | F.coalesce(compatibility == 0, F.lit(False)) | F.coalesce(unit_profile == 0, F.lit(False))


def probed_frames(first: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """The frames of the short probe, and of the longer one for files whose short probe decoded none."""
    return first.unionByName(later.join(first.select(*keys).distinct(), keys, "left_anti"))


def messages_in_order(packets: DataFrame, pictures: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, message, problem: each shown frame's metadata in display order. packets: keys, ordinal, pts, flags; pictures: keys, ordinal, message.

    Messages are carried on in display order, and pictures that are discarded (flag D) hand theirs
    on and are no frame. A file whose sides differ in number, or with a packet without a time, has
    one row that says so.
    """
    n = packets.groupBy(*keys).agg(F.count("*").alias("n"), F.count("pts").alias("timed"))
    m = pictures.groupBy(*keys).agg(F.count("*").alias("m"))
    sizes = n.join(m, keys, "full_outer")
    problem = F.when(~F.col("n").eqNullSafe(F.col("m")), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" packets but "), F.coalesce("m", F.lit(0)).cast("string"), F.lit(" pictures"))).when(F.col("timed") < F.col("n"), "a packet without a time")
    judged = sizes.select(*keys, problem.alias("problem"))
    bad = judged.where(F.col("problem").isNotNull()).select(*keys, F.lit(None).cast("long").alias("frame"), F.lit(None).cast(pictures.schema["message"].dataType).alias("message"), "problem")
    both = packets.join(pictures, [*keys, "ordinal"]).join(judged.where(F.col("problem").isNull()).select(*keys), keys, "left_semi")
    w = Window.partitionBy(*keys).orderBy("pts", "ordinal")
    carried = both.withColumn("carried", F.last("message", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.contains(F.coalesce("flags", F.lit("")), F.lit("D")))
    good = carried.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("carried").alias("message"), F.lit(None).cast("string").alias("problem"))
    return good.unionByName(bad)


def chunk_metadata(frames: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, index, local, message, readable: the metadata of each chunk's frames by place in the chunk. frames: keys, frame, message, readable; chunks: keys, index, start_frame, end_frame.

    The first frame of the first chunk borrows the first readable message where its own isn't;
    other messages that can't be read are left out.
    """
    spread = chunks.select(*keys, "index", "start_frame", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    placed = spread.join(frames, [*keys, "frame"])
    local = F.col("frame") - F.col("start_frame")
    ok = F.col("message").isNotNull() & F.coalesce(F.col("readable"), F.lit(False))
    lent = placed.where((F.col("index") == 0) & ok).groupBy(*keys).agg(F.min_by("message", "frame").alias("__lent"))
    both = placed.join(lent, keys, "left")
    first = (F.col("index") == 0) & (local == 0)
    return both.select(*keys, "index", local.alias("local"), F.when(ok, F.col("message")).when(first, F.col("__lent")).alias("message"), ok.alias("readable"))


def unreadable_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, without, first_readable: frames without metadata, and the first that has some that can be read."""
    ok = F.col("message").isNotNull() & F.coalesce(F.col("readable"), F.lit(False))
    return frames.groupBy(*keys).agg(F.count_if(F.col("message").isNull()).alias("without"), F.min(F.when(ok, F.col("frame"))).alias("first_readable"))


def comparison_tags(args: Column, source_height: Column, rgb: Column) -> Column:
    """Flags and values that an encode read against its source needs on top: the matrix that is assumed by height, and for RGB its transfer and primaries."""
    matrix = F.when(~F.array_contains(args, "--matrix-coefficients"), F.array(F.lit("--matrix-coefficients"), F.when(source_height > 650, "1").otherwise("5")))
    more = [F.when(rgb & ~F.array_contains(args, flag), F.array(F.lit(flag), F.lit(v))) for flag, v in (("--transfer-characteristics", "13"), ("--color-primaries", "1"))]
    return F.flatten(F.array_compact(F.array(matrix, *more)))


def metadata_filter(tags: Column, name: str = "av1_metadata") -> Column:
    """The same tags as a bitstream filter's text; null without any."""
    n = F.floor(F.size(tags) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.replace(F.ltrim(F.element_at(tags, 2 * i + 1), F.lit("-")), F.lit("-"), F.lit("_")), F.lit("="), F.element_at(tags, 2 * i + 2)))
    return F.when(n > 0, F.concat(F.lit(f"{name}="), F.array_join(pairs, ":")))


def banding_feature(args: Column) -> Column:
    """The banding metric's options: PQ has a curve of its own."""
    return F.when(flag_value(args, "--transfer-characteristics") == "16", "cambi=full_ref=true:eotf=pq").otherwise("cambi=full_ref=true")


def message_dictionary(frames: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each file's messages once (keys, id, hex), numbered by their first frame, and its frames with the number of theirs (keys, frame, id). frames: keys, frame, message (binary)."""
    first = frames.where(F.col("message").isNotNull()).groupBy(*keys, F.lower(F.hex("message")).alias("hex")).agg(F.min("frame").alias("__f"))
    ids = first.select(*keys, "hex", (F.row_number().over(Window.partitionBy(*keys).orderBy("__f")) - 1).cast("long").alias("id"))
    numbered = frames.select(*keys, "frame", F.lower(F.hex("message")).alias("hex")).join(ids, [*keys, "hex"], "left").select(*keys, "frame", "id")
    return ids.select(*keys, "id", "hex"), numbered


def from_dictionary(messages: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, message, again from a dictionary; a number that it lacks is an error."""
    both = frames.join(messages.select(*keys, "id", F.unhex("hex").alias("message")), [*keys, "id"], "left")
    lost = F.col("id").isNotNull() & F.col("message").isNull()
    return both.select(*keys, "frame", F.when(lost, F.raise_error(F.lit("message number out of range")).cast("binary")).otherwise(F.col("message")).alias("message"))
