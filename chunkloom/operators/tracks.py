"""Audio and subtitle tracks: languages across two catalogs, plans, orders, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matching, profiles, rules, timeline
from chunkloom.functions import media

#: What codecs and encoders are called in a report.
DISPLAY_NAMES = {"libopus": "Opus", "opus": "Opus", "flac": "FLAC", "aac": "AAC", "libfdk_aac": "AAC", "ac3": "AC3", "eac3": "E-AC-3", "libmp3lame": "MP3", "mp3": "MP3", "alac": "ALAC", "libvorbis": "Vorbis", "vorbis": "Vorbis"}
#: Channels of named layouts, as the public decoder library lists them.
LAYOUT_CHANNELS = {
    "mono": "FC", "stereo": "FL+FR", "2.1": "FL+FR+LFE", "3.0": "FL+FR+FC", "3.0(back)": "FL+FR+BC", "4.0": "FL+FR+FC+BC", "quad": "FL+FR+BL+BR", "quad(side)": "FL+FR+SL+SR",
    "3.1": "FL+FR+FC+LFE", "5.0": "FL+FR+FC+BL+BR", "5.0(side)": "FL+FR+FC+SL+SR", "4.1": "FL+FR+FC+LFE+BC", "5.1": "FL+FR+FC+LFE+BL+BR", "5.1(side)": "FL+FR+FC+LFE+SL+SR",
    "6.0": "FL+FR+FC+BC+SL+SR", "6.0(front)": "FL+FR+FLC+FRC+SL+SR", "3.1.2": "FL+FR+FC+LFE+TFL+TFR", "hexagonal": "FL+FR+FC+BL+BR+BC", "6.1": "FL+FR+FC+LFE+BC+SL+SR",
    "6.1(back)": "FL+FR+FC+LFE+BL+BR+BC", "6.1(front)": "FL+FR+LFE+FLC+FRC+SL+SR", "7.0": "FL+FR+FC+BL+BR+SL+SR", "7.0(front)": "FL+FR+FC+FLC+FRC+SL+SR",
    "7.1": "FL+FR+FC+LFE+BL+BR+SL+SR", "7.1(wide)": "FL+FR+FC+LFE+BL+BR+FLC+FRC", "7.1(wide-side)": "FL+FR+FC+LFE+FLC+FRC+SL+SR", "5.1.2": "FL+FR+FC+LFE+SL+SR+TFL+TFR",
    "5.1.2(back)": "FL+FR+FC+LFE+BL+BR+TFL+TFR", "octagonal": "FL+FR+FC+BL+BR+BC+SL+SR", "cube": "FL+FR+BL+BR+TFL+TFR+TBL+TBR", "5.1.4": "FL+FR+FC+LFE+SL+SR+TFL+TFR+TBL+TBR",
    "7.1.2": "FL+FR+FC+LFE+BL+BR+SL+SR+TFL+TFR", "7.1.4": "FL+FR+FC+LFE+BL+BR+SL+SR+TFL+TFR+TBL+TBR", "7.2.3": "FL+FR+FC+LFE+BL+BR+SL+SR+TFL+TFR+TBC+LFE2",
    "9.1.4": "FL+FR+FC+LFE+BL+BR+FLC+FRC+SL+SR+TFL+TFR+TBL+TBR", "9.1.6": "FL+FR+FC+LFE+BL+BR+FLC+FRC+SL+SR+TFL+TFR+TBL+TBR+TSL+TSR",
    "hexadecagonal": "FL+FR+FC+BL+BR+BC+SL+SR+TFL+TFC+TFR+TBL+TBC+TBR+WL+WR", "binaural": "BIL+BIR", "downmix": "DL+DR",
    "22.2": "FL+FR+FC+LFE+BL+BR+FLC+FRC+BC+SL+SR+TC+TFL+TFC+TFR+TBL+TBC+TBR+LFE2+TSL+TSR+BFC+BFL+BFR",
}
#: Channels that a downmix drops, and the sets of channels that may take them, by preference.
FOLDS = {
    "TBL": ["BL", "SL", "FL"], "TBR": ["BR", "SR", "FR"], "TBC": ["BC", "BL+BR", "SL+SR", "FL+FR"], "TSL": ["SL", "BL", "FL"], "TSR": ["SR", "BR", "FR"], "TC": ["FC", "FL+FR"],
    "TFC": ["FC", "FL+FR"], "LFE2": ["LFE"], "WL": ["FL"], "WR": ["FR"], "SDL": ["SL", "BL", "FL"], "SDR": ["SR", "BR", "FR"], "BFC": ["FC", "FL+FR"], "BFL": ["FL"], "BFR": ["FR"],
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def display_name(codec: Column) -> Column:
    return F.coalesce(_lookup(DISPLAY_NAMES, codec), codec)


def channels_of(layout: Column) -> Column:
    """The channels of a layout that is named, spelled out with + or described as `n channels (...)`; null if it isn't made of channel names."""
    inner = F.regexp_extract(layout, r"^[^(]* channels \((.*)\)$", 1)
    name = F.when(inner != "", inner).otherwise(layout)
    names = F.split(F.coalesce(_lookup(LAYOUT_CHANNELS, name), name), r"\+")
    return F.when(F.forall(names, lambda n: n.rlike("^[A-Z0-9]+$")), names)


# -- languages ---------------------------------------------------------------------------------------


def matched_tag(ours: Column, legacy: Column, ietf: Column) -> Column:
    """The tag to write for a track: of several codes in one tag, what the other catalog has; else its BCP 47 tag if both mean the same language. legacy and ietf are the twin's (null: no twin)."""
    first = F.trim(F.substring_index(ours, ",", 1))
    alike = rules.language_key(first) == rules.language_key(legacy)
    return F.when(legacy.isNotNull() & ours.isNotNull(), F.when(first != ours, F.coalesce(ietf, legacy)).when(alike, ietf))


def language_catalog(streams: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, tag, legacy: for each stream what its twin in the other catalog adds; streams without one twin or more have nulls, and of several twins the first counts.

    streams: keys, ordinal, id, language. tracks: keys, ordinal, number, legacy, ietf.
    """
    pairs = matching.twins(streams, tracks.select(*keys, "ordinal", "number"), keys)
    first = pairs.groupBy(*keys, "ordinal").agg(F.min("number").alias("number"), F.min("by").alias("by"))
    known = tracks.select(*keys, F.col("ordinal").alias("place"), "number", "legacy", "ietf")
    numbered = known.groupBy(*keys, "number").agg(F.min_by(F.struct("legacy", "ietf"), "place").alias("t"))
    twin = first.where("by = 'number'").join(numbered, [*keys, "number"]).select(*keys, "ordinal", "t")
    placed = first.where("by = 'place'").select(*keys, "ordinal").join(known.select(*keys, F.col("place").alias("ordinal"), F.struct("legacy", "ietf").alias("t")), [*keys, "ordinal"])
    both = streams.join(twin.unionByName(placed), [*keys, "ordinal"], "left")
    return both.select(*keys, "ordinal", matched_tag(F.col("language"), F.col("t.legacy"), F.col("t.ietf")).alias("tag"), F.col("t.legacy").alias("legacy"))


def video_language(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, language of the first video track: its BCP 47 tag or legacy code, null where it says nothing."""
    first = tracks.where(F.col("kind") == "video").groupBy(*keys).agg(F.min_by(F.struct("ietf", "legacy"), "ordinal").alias("v"))
    said = F.coalesce("v.ietf", "v.legacy")
    return first.select(*keys, F.when(~said.isin("", "und"), said).alias("language"))


def nothing_matched(tracks: DataFrame, keys: list[str], kept: Column) -> DataFrame:
    """keys, languages: files whose whitelist left none of their tracks, with what the tracks were."""
    said = F.coalesce("language", F.lit("und"))
    found = tracks.groupBy(*keys).agg(F.count_if(kept).alias("n"), F.array_sort(F.collect_list(F.struct("ordinal", said.alias("l")))).alias("all"))  # a file has a few tracks
    return found.where(F.col("n") == 0).select(*keys, F.array_join(F.transform("all", lambda x: x["l"]), ", ").alias("languages"))


# -- plans -------------------------------------------------------------------------------------------


def deeper_probe(shallow: DataFrame, deep: DataFrame, keys: list[str]) -> DataFrame:
    """keys, use: 'deep' where the deeper probe found no fewer tracks and more described ones, else 'shallow'. Both: keys, described (boolean)."""
    def counted(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(a), F.count_if("described").alias(b))

    both = counted(shallow, "n", "d").join(counted(deep, "m", "e"), keys, "left")
    return both.select(*keys, F.when((F.col("m") >= F.col("n")) & (F.col("e") > F.col("d")), "deep").otherwise("shallow").alias("use"))


def audio_plan(tracks: DataFrame, config: DataFrame, on: str, lossless: list[str]) -> DataFrame:
    """tracks with lossless, mode, action, codec, target_layout, bitrate and options: what becomes of each audio track.

    tracks: on, ordinal, codec_name, profile, channels, layout, sample_format, bits, decodable,
    copies (whether the container stores it), twin (the muxer's track that repacks it, or null).
    config: on and the audio section (profiles.SCHEMA). Copies come from the muxer's twin if there
    is one, else as they are if the container stores them, else as PCM if they can be decoded, else
    they are dropped. Encodes need a codec; lossy ones get their layout's bitrate.
    """
    c = F.col
    kind = rules.is_lossless(c("codec_name"), c("profile"), lossless)
    both = tracks.withColumn("lossless", kind).join(config.select(on, "audio"), on).withColumn("__r", profiles.audio_for(F.col("audio"), F.col("codec_name"), F.col("lossless")))
    copied = (c("__r.mode") == "copy") | ~c("decodable")
    action = F.when(copied, F.when(c("twin").isNotNull(), "from_source").when(c("copies"), "copy").when(c("decodable"), "pcm").otherwise("skip")).when(c("__r.codec").isNull(), "error").otherwise("encode")
    encode, opus = action == "encode", F.contains(c("__r.codec"), F.lit("opus"))
    target = F.when(encode & opus, matching.smallest_layout(channels_of(c("layout")), c("channels")))
    rate = rules.bitrate_for(c("__r.bitrate"), F.coalesce(target, rules.layout_name(c("channels"))))
    rate = F.when(c("__r.codec") == "libopus", media.capped_bitrate(rate, rules.parse_bitrate(rate), target)).otherwise(rate)
    codec = F.when(encode, c("__r.codec")).when(action == "pcm", media.pcm_codec(c("sample_format"), c("bits")))
    return both.select(
        *[x for x in tracks.columns], "lossless", c("__r.mode").alias("mode"), action.alias("action"), codec.alias("out_codec"), target.alias("target_layout"),
        F.when(encode & ~media.output_is_lossless(c("__r.codec")), rate).alias("out_bitrate"), F.when(encode, F.array_sort(F.map_entries("__r.options"))).alias("out_options"),
    )


def audio_summary(t: dict[str, Column]) -> Column:
    """A track's line of the report. t: ordinal, language, codec_name, layout, channels, lossless, action, preroll, out_codec, out_bitrate, target_layout."""
    layout = F.coalesce(F.nullif(t["layout"], F.lit("")), F.when(t["channels"].isNotNull(), rules.layout_name(t["channels"])), F.lit("?"))
    copied = F.when(t["preroll"] == 0, "copy").otherwise(F.concat(F.lit("copy without "), t["preroll"].cast("string"), F.lit(" priming packet(s)")))
    other = F.contains(t["out_codec"], F.lit("opus")) & (t["target_layout"] != layout)
    encoded = F.concat(display_name(t["out_codec"]), F.coalesce(F.concat(F.lit(" "), t["out_bitrate"]), F.lit("")), F.when(other, F.concat(F.lit(" as "), t["target_layout"])).otherwise(""))
    pcm = F.concat(t["out_codec"], F.lit(", no codec ID for "), t["codec_name"])
    what = F.when(t["action"] == "copy", copied).when(t["action"] == "from_source", "copy as AAC").when(t["action"] == "pcm", pcm).otherwise(encoded)
    loss = F.when(t["lossless"], "lossless").otherwise("lossy")
    return F.concat(F.lit("track "), t["ordinal"].cast("string"), F.lit(": "), F.coalesce(t["language"], F.lit("und")), F.lit(" "), t["codec_name"], F.lit(" "), layout, F.lit(" ("), loss, F.lit(") -> "), what)


def subtitle_plan(streams: DataFrame, tracks: DataFrame, keys: list[str], whitelist: list[str], strip: bool = False) -> DataFrame:
    """keys, ordinal, route, track, kept, reason: what becomes of each subtitle stream. streams: keys, ordinal, id, codec, language, legacy; tracks: keys, ordinal, number, track, language.

    Storable streams go by their own language (or the other catalog's code); the rest are taken
    from the muxer's twins by the twins' languages, and are skipped without a twin.
    """
    if strip:
        streams = streams.where("false")
    routed = streams.withColumn("route", media.subtitle_route(F.coalesce("codec", F.lit("unknown"))))
    own = routed.where("route != 'mux'").withColumn("kept", rules.selected_with_fallback(F.col("language"), F.col("legacy"), whitelist))
    own = own.select(*keys, "ordinal", "route", F.lit(None).cast("long").alias("track"), "kept", F.when(~F.col("kept"), "language").alias("reason"))
    rest = routed.where("route = 'mux'")
    # places count among all streams, so all take part in matching
    pairs = matching.twins(streams, tracks.select(*keys, "ordinal", "number"), keys)
    by_number = pairs.where("by = 'number'").select(*keys, "ordinal", "number").join(tracks.select(*keys, "number", "track", F.col("language").alias("twin_language")), [*keys, "number"]).drop("number")
    by_place = pairs.where("by = 'place'").select(*keys, "ordinal").join(tracks.select(*keys, "ordinal", "track", F.col("language").alias("twin_language")), [*keys, "ordinal"])
    found = rest.join(by_number.unionByName(by_place), [*keys, "ordinal"], "left")
    ok = F.col("track").isNotNull() & rules.language_selected(F.col("twin_language"), whitelist)
    other = found.select(*keys, "ordinal", "route", F.col("track").cast("long"), ok.alias("kept"), F.when(F.col("track").isNull(), "unsupported").when(~ok, "language").alias("reason"))
    return own.unionByName(other)


def repacked(streams: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, number: streams in transport AAC whose twin is one track exactly. streams: keys, ordinal, id, codec_name."""
    one = matching.exactly_one(matching.twins(streams, tracks, keys), keys)
    return one.join(streams.where(F.col("codec_name") == "aac_latm").select(*keys, "ordinal"), [*keys, "ordinal"], "left_semi").select(*keys, "ordinal", "number")


def priming_packets(packets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, n: whole packets that only hold what is to be skipped. packets: keys, order, seconds, skip (samples, of the first packet only), rate, padding (the codec's own, which rules it out)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = packets.select(*keys, *order, (F.col("seconds") * F.col("rate")).alias("size"), F.first("skip").over(w).alias("first_skip"), F.first("padding").over(w).alias("padding"))
    before = rows.withColumn("before", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0e0)))
    holds = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 < F.col("first_skip")) & (F.col("padding") <= 0)
    return timeline.take_while(before, keys, order, holds)


def source_span(start: Column, duration: Column) -> Column:
    """Struct of start (0 if unknown) and duration in seconds, or null without a finite duration."""
    def seconds(t: Column) -> Column:
        x = t.try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    return F.when(seconds(duration).isNotNull(), F.struct(F.coalesce(seconds(start), F.lit(0e0)).alias("start"), seconds(duration).alias("duration")))


def lenient(value: Column, error: Column, transient: Column) -> Column:
    """Struct of value (null after an error), warning (the text of an error that doesn't clear on its own) and retry."""
    failed = error.isNotNull()
    return F.struct(F.when(~failed, value).alias("value"), F.when(failed & ~transient, error).alias("warning"), F.coalesce(failed & transient, F.lit(False)).alias("retry"))


def selector(tracks: DataFrame, keys: list[str], flag: str, none: str) -> DataFrame:
    """keys, args: the muxer's choice of a file's tracks, or the flag that takes none. tracks: keys, ordinal, track (null: none taken)."""
    found = tracks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("track").isNotNull(), F.struct("ordinal", "track")))).alias("t"))  # a file has a few tracks
    ids = F.array_join(F.transform("t", lambda x: x["track"].cast("string")), ",")
    return found.select(*keys, F.when(F.size("t") > 0, F.array(F.lit(flag), ids)).otherwise(F.array(F.lit(none))).alias("args"))


def leading_videos(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: video tracks before the first track of another kind."""
    return timeline.take_while(tracks, keys, ["ordinal"], F.col("kind") == "video")


