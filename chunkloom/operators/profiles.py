"""Profiles: reading, rules that a profile must keep, and fingerprints of settings.

A profile is a row of nested structs (see SCHEMA); settings that aren't given are null.
"""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import LAYOUTS, parse_bitrate
from chunkloom.functions.media import output_is_lossless

_AUDIO = "mode:string,codec:string,bitrate:map<string,string>,options:map<string,string>"
SCHEMA = f"""profile string, encoder string, encoder_params map<string,struct<kind:string,text:string>>,
  picture struct<video:string,dv:boolean,crop:boolean,keyint:boolean,scale:bigint,bit_depth:bigint,keep_temp:boolean>,
  audio struct<{_AUDIO},language_whitelist:array<string>,lossless:struct<{_AUDIO}>,codec_rules:map<string,struct<{_AUDIO}>>>,
  subtitles struct<mode:string,language_whitelist:array<string>>,
  scene_detection struct<min_scene_len:bigint,extra_split_sec:bigint,extra_split:bigint,speed:string,downscale_height:bigint>,
  target_quality struct<jod:double,min_crf:bigint,max_crf:bigint,min_probes:bigint,max_probes:bigint,tolerance:double,probe_preset:bigint,max_encoded_percent:double,max_cambi:double,max_cambi_diff:double>"""
#: Encoder parameters that hold color codes.
COLOR_KEYS = ("color-primaries", "transfer-characteristics", "matrix-coefficients", "chroma-sample-position", "color-range")
#: What settings are where a profile says nothing.
DEFAULTS = {
    "picture": {"video": "encode", "dv": False, "crop": False, "keyint": False, "keep_temp": False},
    "audio": {"mode": "copy"},
    "subtitles": {"mode": "copy"},
    "scene_detection": {"min_scene_len": 24, "extra_split_sec": 10, "extra_split": 0, "speed": "standard"},
    "target_quality": {"min_crf": 1, "max_crf": 70, "min_probes": 2, "max_probes": 7, "tolerance": 0.05, "probe_preset": 13, "max_encoded_percent": 90.0},
}


class UnknownKey(ValueError):
    pass


def _scalar(v: object) -> str:
    return ("1" if v else "0") if isinstance(v, bool) else str(v)


def _bitrate(v: object) -> dict[str, str] | None:
    return v if v is None or isinstance(v, dict) else {"*": str(v)}


def parse_profile(name: str, text: str, schema=None) -> dict:
    """A profile's row from its text (TOML); a key that SCHEMA lacks is an error."""
    raw = tomllib.loads(text)
    known = {f.name: f.dataType for f in (schema or _schema()).fields if f.name != "profile"}

    def strict(where: str, table: dict, names: list[str]) -> None:
        if extra := sorted(set(table) - set(names)):
            raise UnknownKey(f"{where}: {', '.join(extra)}")

    strict("profile", raw, list(known))
    out: dict = {"profile": name, "encoder": raw.get("encoder")}
    out["encoder_params"] = {k: {"kind": type(v).__name__, "text": _scalar(v)} for k, v in raw.get("encoder_params", {}).items()}
    audio = ("mode", "codec", "bitrate", "options")

    def sound(where: str, t: dict, more: tuple[str, ...] = ()) -> dict:
        strict(where, t, [*audio, *more])
        return {"mode": t.get("mode"), "codec": t.get("codec"), "bitrate": _bitrate(t.get("bitrate")), "options": {k: _scalar(v) for k, v in t.get("options", {}).items()}}

    for part in ("picture", "subtitles", "scene_detection", "target_quality"):
        if part in raw or part in DEFAULTS and part != "target_quality":
            table = raw.get(part, {})
            fields = [f.name for f in known[part].fields]
            strict(part, table, fields)
            kinds = {f.name: f.dataType.simpleString() for f in known[part].fields}
            filled = {**DEFAULTS[part], **table}
            out[part] = {f: float(filled[f]) if kinds[f] == "double" and f in filled else filled.get(f) for f in fields}
    table = raw.get("audio", {})
    out["audio"] = {**DEFAULTS["audio"], **{k: v for k, v in sound("audio", table, ("language_whitelist", "lossless", "codec_rules")).items() if v is not None}}
    out["audio"]["language_whitelist"] = table.get("language_whitelist", [])
    out["audio"]["lossless"] = sound("audio.lossless", table["lossless"]) if "lossless" in table else None
    out["audio"]["codec_rules"] = {k: sound(f"audio.codec_rules.{k}", v) for k, v in table.get("codec_rules", {}).items()}
    return out


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMA)


def read_profiles(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """A row per profile; profiles are configuration, a few small files."""
    return spark.createDataFrame([json.loads(json.dumps(parse_profile(n, t))) for n, t in texts.items()], _schema())


def no_options() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def resolved_audio(base: Column, rule: Column) -> Column:
    """A rule laid over the audio section: its unset fields inherit, and options that aren't empty replace all of the section's."""
    keep = lambda f: F.coalesce(rule[f], base[f]).alias(f)
    options = F.when(F.size(F.coalesce(rule["options"], no_options())) > 0, rule["options"]).otherwise(base["options"])
    return F.struct(keep("mode"), keep("codec"), keep("bitrate"), options.alias("options"))


def audio_for(audio: Column, codec: Column, lossless: Column) -> Column:
    """The rule of the track's codec, else that of lossless tracks, else the section itself."""
    rule = F.try_element_at(audio["codec_rules"], codec)
    plain = F.struct(*[audio[f].alias(f) for f in ("mode", "codec", "bitrate", "options")])
    return F.when(rule.isNotNull(), resolved_audio(audio, rule)).when(lossless & audio["lossless"].isNotNull(), resolved_audio(audio, audio["lossless"])).otherwise(plain)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _audio_rules(where: str, a: Column) -> list[tuple[str, Column]]:
    encode = F.coalesce(a["mode"] == "encode", F.lit(False))
    rates = F.coalesce(F.map_values(a["bitrate"]), F.array().cast("array<string>"))
    keys = F.coalesce(F.map_keys(a["bitrate"]), F.array().cast("array<string>"))
    return [
        (f"{where}.bitrate_layout", F.exists(keys, lambda k: ~k.isin(*LAYOUTS, "default", "*"))),
        (f"{where}.bitrate_form", F.exists(rates, lambda r: parse_bitrate(r).isNull())),
        (f"{where}.bitrate_small", F.exists(rates, lambda r: F.coalesce(parse_bitrate(r) < 1000, F.lit(False)))),
        (f"{where}.codec_required", encode & a["codec"].isNull()),
        (f"{where}.bitrate_required", encode & a["codec"].isNotNull() & ~output_is_lossless(a["codec"]) & a["bitrate"].isNull()),
    ]


def profile_rules() -> list[tuple[str, Column]]:
    """Name and violation of each rule that a profile must keep, in the order in which they are looked at."""
    c, params = F.col, F.col("encoder_params")
    q, scenes = c("target_quality"), c("scene_detection")
    has = lambda k: F.coalesce(F.map_contains_key(params, k), F.lit(False))
    copied, wanted = F.coalesce(c("picture.video") == "copy", F.lit(False)), q.isNotNull()
    crf = F.try_element_at(params, F.lit("crf"))
    number = F.when(crf["kind"].isin("int", "float", "str"), crf["text"].try_cast("double"))

    def coded(key: str) -> Column:
        v = F.try_element_at(params, F.lit(key))
        return v.isNotNull() & (v["kind"].isin("bool", "float") | ~F.coalesce(v["text"].rlike("^[+]?[0-9]+$"), F.lit(False)))

    no_code = lambda x: ~x.rlike(r"^\s*[A-Za-z]{3}([-_][\s\S]*)?\s*$")
    lists = F.coalesce(c("audio.language_whitelist"), F.array().cast("array<string>")), F.coalesce(c("subtitles.language_whitelist"), F.array().cast("array<string>"))
    limit = lambda x: x.isNotNull() & (~_finite(x) | (x < 0))
    rules: list[tuple[str, Column]] = [
        ("encoder_required", ~copied & c("encoder").isNull()),
        ("bit_depth", c("picture.bit_depth").isNotNull() & ~c("picture.bit_depth").isin(8, 10)),
        ("dv_bit_depth", c("picture.dv") & (c("picture.bit_depth") == 8)),
        ("scale", c("picture.scale") < 64),
        ("crf_number", crf.isNotNull() & ~_finite(number)),
        *[(f"code.{k}", coded(k)) for k in COLOR_KEYS],
        ("quality_needs_encode", wanted & copied),
        ("quality_rate_control", wanted & (has("tbr") | has("cqp") | (F.try_element_at(params, F.lit("rc"))["text"] != "0"))),
        ("quality_color", wanted & F.exists(F.array(*[has(k) for k in COLOR_KEYS if k != "chroma-sample-position"]), lambda x: x)),
        ("jod_required", wanted & (q["jod"].isNull() | F.isnan(q["jod"]))),
        ("jod_range", wanted & ~((q["jod"] > 0) & (q["jod"] < 10)) & ~F.isnan(q["jod"])),
        ("min_crf", q["min_crf"] < 1),
        ("crf_order", q["min_crf"] >= q["max_crf"]),
        ("max_crf", q["max_crf"] > 70),
        ("min_probes", q["min_probes"] < 2),
        ("probe_order", q["max_probes"] < q["min_probes"]),
        ("probe_preset", q["probe_preset"] > 13),
        ("tolerance", wanted & (~_finite(q["tolerance"]) | (q["tolerance"] < 0))),
        ("size_cap", wanted & (~_finite(q["max_encoded_percent"]) | (q["max_encoded_percent"] <= 0))),
        ("max_cambi", limit(q["max_cambi"])),
        ("max_cambi_diff", limit(q["max_cambi_diff"])),
        ("min_scene_len", scenes["min_scene_len"] == 0),
        ("extra_split", (scenes["extra_split"] > 0) & (scenes["extra_split"] < 24)),
        ("downscale_height", scenes["downscale_height"] < 64),
        ("audio.language", F.exists(lists[0], no_code)),
        ("subtitles.language", F.exists(lists[1], no_code)),
        *_audio_rules("audio", c("audio")),
        *[(n, c("audio.lossless").isNotNull() & v) for n, v in _audio_rules("audio.lossless", resolved_audio(c("audio"), c("audio.lossless")))],
    ]
    each = F.coalesce(F.map_values(c("audio.codec_rules")), F.array().cast(f"array<struct<{_AUDIO}>>"))

    def any_rule(k: int) -> Column:
        return F.exists(each, lambda r: _audio_rules("", resolved_audio(F.col("audio"), r))[k][1])

    rules += [(name, any_rule(k)) for k, (name, _) in enumerate(_audio_rules("audio.codec_rules", c("audio")))]
    return rules


def broken_rules(profiles: DataFrame, rules: list[tuple[str, Column]] | None = None) -> DataFrame:
    """profile, rule: a row for each rule a profile breaks."""
    rules = rules if rules is not None else profile_rules()
    broken = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(name)) for name, v in rules]))
    return profiles.select("profile", F.explode(broken).alias("rule"))


def unknown_codecs(profiles: DataFrame, known: DataFrame) -> DataFrame:
    """profile, codec: codec rules for names that the decoder doesn't know, so they match no track. known: name."""
    named = profiles.select("profile", F.explode(F.map_keys("audio.codec_rules")).alias("codec"))
    return named.join(known, named["codec"] == known["name"], "left_anti")


def output_settings(settings: Column, quality: Column) -> Column:
    """The settings (map) that bear on the output; under a quality target the crf doesn't, as it is found per chunk."""
    return F.map_filter(settings, lambda k, v: v.isNotNull() & ~(quality & (k == "crf")))
