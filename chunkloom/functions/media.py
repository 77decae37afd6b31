"""Scalar decisions about tracks, pictures and the output of tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subtitle codecs that the container stores as they are.
STORABLE_SUBTITLES = ("subrip", "text", "ass", "webvtt", "dvd_subtitle", "dvb_subtitle", "hdmv_pgs_subtitle", "hdmv_text_subtitle", "arib_caption")
#: Audio encoders without loss; names that begin with pcm_ are too.
LOSSLESS_OUTPUT = ("flac", "alac", "wavpack", "tta", "truehd", "mlp", "s302m")
#: Channels of the layouts that the speech and music encoder takes.
ENCODER_CHANNELS = {"mono": 1, "stereo": 2, "3.0": 3, "quad": 4, "5.0": 5, "5.1": 6, "6.1": 7, "7.1": 8}
#: Fields of a track's disposition and the muxer's flags for them.
DISPOSITION_FLAGS = (
    ("forced", "--forced-display-flag"), ("hearing_impaired", "--hearing-impaired-flag"), ("visual_impaired", "--visual-impaired-flag"), ("original", "--original-flag"),
    ("comment", "--commentary-flag"),
)
#: Diagonal of the assumed display, in inches; its sides are as 16 to 9.
DISPLAY_INCHES = 30.0


def output_is_lossless(codec: Column) -> Column:
    return codec.isin(*LOSSLESS_OUTPUT) | F.startswith(codec, F.lit("pcm_"))


def pcm_codec(sample_format: Column, bits: Column) -> Column:
    """The PCM codec that holds the samples: floats keep their width, integers take 16, 24 or 32 bits; 0 bits mean unknown."""
    base = F.regexp_replace(sample_format, "p$", "")
    short = bits.between(1, 16) | ((bits == 0) & base.isin("u8", "s16"))
    return F.when(base == "flt", "pcm_f32le").when(base == "dbl", "pcm_f64le").when(short, "pcm_s16le").when(bits.between(17, 24), "pcm_s24le").otherwise("pcm_s32le")


def capped_bitrate(text: Column, bits_per_second: Column, layout: Column) -> Column:
    """The bitrate as written, or 256k for each channel where it is more; layouts that aren't known count as one channel."""
    channels = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ENCODER_CHANNELS.items() for x in pair]), layout), F.lit(1))
    return F.when(bits_per_second > channels * 256_000, F.concat((channels * 256).cast("string"), F.lit("k"))).otherwise(text)


def marked_title(title: Column, marker: str) -> Column:
    """A title that ends with the marker in parentheses, once; the marker alone where there is no title of its own."""
    plain, tail = F.trim(F.coalesce(title, F.lit(""))), f"({marker})"
    base = F.when(F.endswith(plain, F.lit(tail)), F.rtrim(F.substring(plain, F.lit(1), F.length(plain) - len(tail)))).otherwise(plain)
    return F.when((base == "") | (F.lower(base) == marker.lower()), F.lit(marker)).otherwise(F.concat(base, F.lit(f" {tail}")))


def disposition_flags(disposition: Column, track: Column) -> Column:
    """A muxer's arguments for a track's disposition (struct of numbers): the default flag always, the others where set."""

    def argument(yes: Column | str) -> Column:
        return F.concat(track.cast("string"), F.lit(":"), F.lit(yes) if isinstance(yes, str) else yes)

    always = F.array(F.lit("--default-track-flag"), argument(F.when(disposition["default"] != 0, "yes").otherwise("no")))
    some = F.array(*[F.when(disposition[name] != 0, F.array(F.lit(flag), argument("yes"))) for name, flag in DISPOSITION_FLAGS])
    return F.concat(always, F.flatten(F.array_compact(some)))


def subtitle_route(codec: Column) -> Column:
    """How a subtitle gets into the output: as it is, converted to srt, or taken by the muxer."""
    return F.when(codec.isin(*STORABLE_SUBTITLES), "extract").when(codec == "mov_text", "extract_srt").otherwise("mux")


def extraction_shift_ms(container: Column, first: Column, start: Column, kept: Column) -> Column:
    """Milliseconds to move tracks taken from a transport stream; 0 for other containers or if a time (seconds) is missing."""
    shift = F.round((first - start - kept) * 1000).cast("long")
    return F.when(container == "mpegts", F.coalesce(shift, F.lit(0))).otherwise(0).cast("long")


def wrapped_shift_ms(container: Column, first_packet: Column, start: Column, duration: Column) -> Column:
    """Milliseconds to take off tracks of a transport stream whose packets lie over a second beyond its duration."""
    late = (container == "mpegts") & start.isNotNull() & (first_packet > duration + 1)
    return F.when(late, -F.round(start * 1000)).otherwise(0).cast("long")


def interlaced_flag(field_order: Column, any_frame: Column) -> Column:
    """The container's field order decides if it says anything, else whether a sampled frame is marked."""
    return F.when(field_order.isin("tt", "bb", "tb", "bt"), True).when(field_order == "progressive", False).otherwise(F.coalesce(any_frame, F.lit(False)))


def orientation(flip: Column, rotation: Column) -> Column:
    """mirror (null, horizontal, vertical) and roll (degrees counter-clockwise, -179 to 180). A flip with half a turn is the other flip."""
    turn, sign = F.pmod(rotation, F.lit(360)), F.signum(flip)
    half = (turn == 180) & (sign != 0)
    mirror = F.when(sign == 0, None).when((sign > 0) != half, "horizontal").otherwise("vertical")
    back = F.pmod(-F.when(half, 0).otherwise(turn), F.lit(360))
    return F.struct(mirror.alias("mirror"), F.when(back > 180, back - 360).otherwise(back).cast("int").alias("roll"))


def chroma_geometry(subsampling: Column, w: Column, h: Column, x: Column, y: Column) -> Column:
    """Size and corner of the chroma planes: sizes are rounded up, corners down."""
    wide, tall = F.when(subsampling == "444", 1).otherwise(2), F.when(subsampling == "420", 2).otherwise(1)
    return F.struct(F.ceil(w / wide).alias("w"), F.ceil(h / tall).alias("h"), F.floor(x / wide).alias("x"), F.floor(y / tall).alias("y"))


def active_area(offsets: Column, source: Column, crop: Column, scale: Column, mirror: Column) -> Column:
    """Black borders (left, right, top, bottom) as they are after crop (x, y, w, h or null), scale (w, h or null) and mirror, rounded half up."""
    x, y = F.coalesce(crop["x"], F.lit(0)), F.coalesce(crop["y"], F.lit(0))
    w, h = F.coalesce(crop["w"], source["w"]), F.coalesce(crop["h"], source["h"])

    def fit(side: str, cut: Column, kept: Column, out: Column) -> Column:
        left = F.least(F.greatest(offsets[side] - F.greatest(cut, F.lit(0)), F.lit(0)), kept)
        whole = F.greatest(kept, F.lit(1))
        return F.floor((left * F.coalesce(out, kept) + F.floor(whole / 2)) / whole).cast("int")

    left, right = fit("left", x, w, scale["w"]), fit("right", source["w"] - x - w, w, scale["w"])
    top, bottom = fit("top", y, h, scale["h"]), fit("bottom", source["h"] - y - h, h, scale["h"])
    across, over = mirror.eqNullSafe("horizontal"), mirror.eqNullSafe("vertical")
    return F.struct(
        F.when(across, right).otherwise(left).alias("left"), F.when(across, left).otherwise(right).alias("right"),
        F.when(over, bottom).otherwise(top).alias("top"), F.when(over, top).otherwise(bottom).alias("bottom"),
    )


def display_diagonal(w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """Inches of the diagonal of a picture of w by h pixels when a frame fills the assumed display."""
    unit = F.lit(DISPLAY_INCHES) / F.hypot(F.lit(16.0), F.lit(9.0))
    return F.least(unit * 16 / frame_w, unit * 9 / frame_h) * F.hypot(w, h)


def ignored_when_copied(options: Column) -> Column:
    """Names of the picture options (struct) that have no effect on a copied picture."""
    return F.array_compact(F.array(*[F.when(options[n], n) for n in ("dv", "crop", "keyint")], *[F.when(options[n].isNotNull(), n) for n in ("scale", "bit_depth")]))


def tail_lines(text: Column, n: int) -> Column:
    """The last n lines, after a line that counts those left out."""
    lines = F.split(F.btrim(text, F.lit("\n \t\r")), "\r?\n")
    left_out = F.size(lines) - n
    kept = F.array_join(F.slice(lines, F.greatest(left_out + 1, F.lit(1)), F.lit(n)), "\n")
    return F.when(left_out > 0, F.concat(F.lit("["), left_out.cast("string"), F.lit(" earlier lines]\n"), kept)).otherwise(kept)


def cpu_count(text: Column) -> Column:
    """How many numbers a list such as 0-3,5 names; null if it is malformed."""
    ends = F.transform(F.split(F.trim(text), ","), lambda r: F.struct(F.substring_index(r, "-", 1).try_cast("long").alias("a"), F.substring_index(r, "-", -1).try_cast("long").alias("b")))
    sizes = F.transform(ends, lambda e: F.when(e["b"] >= e["a"], e["b"] - e["a"] + 1))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, n: acc + n)


def whole_file_timeout(size_bytes: Column, base: int) -> Column:
    return F.lit(base) + F.coalesce(F.floor(size_bytes / 10_000_000), F.lit(0))


def tool_failed(exit_code: Column) -> Column:
    """A muxer's exit: 1 is only warnings; no code (a signal) is a failure."""
    return F.coalesce(exit_code, F.lit(2)) >= 2


def audio_codecs(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """keys, name, lossless, decodable: the audio rows of a decoder tool's codec list (six flags, then a name)."""
    fields = lines.select(*keys, F.split(F.trim(line), r"\s+").alias("f")).where((F.size("f") >= 2) & (F.length(F.col("f")[0]) >= 6))
    flag = lambda n: F.substring(F.col("f")[0], n, 1)
    return fields.where(flag(3) == "A").select(*keys, F.col("f")[1].alias("name"), (flag(6) == "S").alias("lossless"), (flag(1) == "D").alias("decodable"))


def audio_encoders(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """keys, name: the audio rows of an encoder list; the legend's rows have no name."""
    return lines.select(*keys, F.regexp_extract(F.trim(line), r"^A\S{5}\s+([A-Za-z0-9_-]+)(\s|$)", 1).alias("name")).where(F.col("name") != "").distinct()


def devices(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """keys, id, label, hardware: rows such as `GPU 0: name`; software renderers are told by their names."""
    pattern = r"^GPU ([^:]*):(.*)$"
    rows = lines.select(*keys, F.trim(F.regexp_extract(F.trim(line), pattern, 1)).try_cast("int").alias("id"), F.trim(F.regexp_extract(F.trim(line), pattern, 2)).alias("label"))
    return rows.where(F.col("id") >= 0).withColumn("hardware", ~F.lower("label").rlike("llvmpipe|software|swrast"))


def short_label(text: Column, most: int) -> Column:
    """A message whose leading [name] is cut to so many characters; brackets in the name are counted, and only the first line is looked at. Others stay as they are."""
    line = F.substring_index(text, "\n", 1)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        here = acc["at"] + 1
        return F.struct(depth.alias("depth"), here.alias("at"), F.when((acc["end"] == 0) & (depth == 0), here).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(F.split(line, ""), zero, step, lambda acc: acc["end"])
    cut = F.concat(F.lit("["), F.substring(text, 2, most), F.lit("\u2026]"), F.substring(text, end + 1, F.length(text)))
    return F.when(F.startswith(text, F.lit("[")) & (end - 2 > most), cut).otherwise(text)


def single_cpu_args(encoder: Column, cpus: Column, params: Column, flag: str = "lp") -> Column:
    """The level of parallelism that the plain encoder must be told on one CPU, unless the settings (map) say it."""
    alone = (cpus == 1) & (encoder == "svt-av1") & ~F.map_contains_key(params, flag)
    return F.when(F.coalesce(alone, F.lit(False)), F.array(F.lit(f"--{flag}"), F.lit("1")))


def frame_header(w: Column, h: Column, num: Column, den: Column, colorspace: Column) -> Column:
    """The head line of a raw video stream."""
    return F.concat(F.lit("YUV4MPEG2 W"), w.cast("string"), F.lit(" H"), h.cast("string"), F.lit(" F"), num.cast("string"), F.lit(":"), den.cast("string"), F.lit(" Ip C"), colorspace, F.lit("\n"))


def any_interlaced(frames: DataFrame, keys: list[str], order: str, first: int = 5) -> DataFrame:
    """keys, any_frame: whether one of the first frames is marked. frames: keys, order (from 0), interlaced."""
    return frames.where(F.col(order) < first).groupBy(*keys).agg(F.bool_or(F.coalesce("interlaced", F.lit(False))).alias("any_frame"))


def settings(env: dict[str, str]) -> dict[str, str | int]:
    """Folders and poll interval from the environment; a bad or missing interval is the default, and a second is the least."""
    raw = env.get("POLL_INTERVAL", "")
    poll = int(raw) if raw.isascii() and raw.isdigit() else 60
    return {"input": env.get("INPUT_DIR", "./input"), "output": env.get("OUTPUT_DIR", "./output"), "poll_s": max(1, poll)}


def reply_kind(args: list[str]) -> str | None:
    """What a command line asks for: nothing, 'version' or 'help'; anything else is an error."""
    if not args:
        return None
    known = {"--version": "version", "-V": "version", "--help": "help", "-h": "help"}
    if len(args) == 1 and args[0] in known:
        return known[args[0]]
    raise ValueError("no argument but --version or --help is taken, got: " + " ".join(args))
