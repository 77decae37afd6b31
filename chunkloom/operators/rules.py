"""Layered configuration rules, language filters, layouts and bitrates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages that ISO 639-2 spells twice, bibliographic code first.
TWICE_SPELLED = (
    ("alb", "sqi"), ("arm", "hye"), ("baq", "eus"), ("bur", "mya"), ("chi", "zho"), ("cze", "ces"), ("dut", "nld"), ("fre", "fra"), ("geo", "kat"), ("ger", "deu"),
    ("gre", "ell"), ("ice", "isl"), ("mac", "mkd"), ("mao", "mri"), ("may", "msa"), ("per", "fas"), ("rum", "ron"), ("slo", "slk"), ("tib", "bod"), ("wel", "cym"),
)
#: Names of channel layouts by number of channels; more than eight are 7.1.
LAYOUTS = ("mono", "stereo", "3.0", "quad", "5.0", "5.1", "6.1", "7.1")


def language_key(tag: Column) -> Column:
    """A tag's base subtag in lower case; both ISO 639-2 spellings of a language have one key. Two-letter codes stay apart from three-letter ones."""
    base = F.regexp_extract(F.lower(F.trim(tag)), "^[^-_]*", 0)
    spelled = F.create_map(*[F.lit(x) for pair in TWICE_SPELLED for x in pair])
    return F.coalesce(F.try_element_at(spelled, base), base)


def language_selected(tag: Column, whitelist: list[str]) -> Column:
    """An empty whitelist keeps all; a comma list of which any language matches is kept, and so is one without any known language (missing, blank, und)."""
    if not whitelist:
        return F.lit(True)
    wanted = F.array(*[language_key(F.lit(w)) for w in whitelist if w.strip()]).cast("array<string>")
    said = F.filter(F.transform(F.split(F.coalesce(tag, F.lit("")), ","), lambda t: F.trim(t)), lambda t: (t != "") & (F.lower(t) != "und"))
    return (F.size(said) == 0) | F.exists(said, lambda t: F.array_contains(wanted, language_key(t)))


def selected_with_fallback(tag: Column, legacy: Column, whitelist: list[str]) -> Column:
    """As language_selected, or by the other catalog's code."""
    if not whitelist:
        return F.lit(True)
    return language_selected(tag, whitelist) | (legacy.isNotNull() & language_selected(legacy, whitelist))


def is_lossless(codec: Column, profile: Column, lossless: list[str]) -> Column:
    return F.when(codec == "dts", F.coalesce(F.contains(profile, F.lit("MA")), F.lit(False))).otherwise(F.startswith(codec, F.lit("pcm_")) | codec.isin(*lossless))


def layout_name(channels: Column) -> Column:
    n = F.greatest(F.lit(1), F.least(F.lit(8), F.coalesce(channels, F.lit(0))))
    return F.element_at(F.array(*[F.lit(x) for x in LAYOUTS]), n.cast("int"))


def bitrate_for(rates: Column, layout: Column) -> Column:
    """Of a map of bitrates: the layout's, else the default's, else the single one's (key *)."""
    return F.coalesce(F.try_element_at(rates, layout), F.try_element_at(rates, F.lit("default")), F.try_element_at(rates, F.lit("*")))


def parse_bitrate(text: Column) -> Column:
    """Bits per second: digits, optionally k, K (thousands) or M (millions); null if malformed or not above 0."""
    pattern = r"^([0-9]+\.?[0-9]*|\.[0-9]+)([kKM]?)$"
    number = F.regexp_extract(F.trim(text), pattern, 1).try_cast("double")
    unit = F.regexp_extract(F.trim(text), pattern, 2)
    value = number * F.when(unit == "M", 1e6).when(unit.isin("k", "K"), 1e3).otherwise(1e0)
    return F.when(value > 0, F.floor(value).cast("long"))


def scalar_text(kind: Column, text: Column) -> Column:
    """A configuration scalar as an argument; booleans are 1 and 0."""
    return F.when(kind == "bool", F.when(F.lower(text) == "true", "1").otherwise("0")).otherwise(text)


def flag_list(params: Column) -> Column:
    """Array of --key value, sorted by key."""
    pairs = F.array_sort(F.map_entries(params))
    return F.flatten(F.transform(pairs, lambda e: F.array(F.concat(F.lit("--"), e["key"]), e["value"])))


def set_flag(params: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(params, lambda k, _: k != key), F.create_map(F.lit(key), value))


def without_flag(params: Column, key: str) -> Column:
    return F.map_filter(params, lambda k, _: k != key)


def overlaid(rows: DataFrame, rules: DataFrame, on: str, override: Column, override_values: dict, defaults: dict) -> DataFrame:
    """rows with each of defaults' fields resolved: by the row's own rule (fields that are null inherit), else by override where it holds, else by default.

    rules: on and the fields, a row per key; it is small by nature (a configuration file) and Spark
    decides by its size whether it is broadcast.
    """
    fields = list(defaults)
    named = rules.select(F.col(on).alias("__on"), *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__has"))
    both = rows.join(named, rows[on] == F.col("__on"), "left")
    out = {}
    for f in fields:
        base = F.when(F.coalesce(F.col("__has"), F.lit(False)), F.col(f"__{f}")).when(override, F.lit(override_values.get(f)))
        out[f] = F.coalesce(base, F.lit(defaults[f]))
    return both.withColumns(out).select(*rows.columns, *fields)


def changed_fields(rows: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """keys, field, value (text) of each field that differs from its default."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(str(d)).alias("d")) for f, d in defaults.items()])
    long = rows.select(*keys, F.explode(entries).alias("e"))
    return long.where(~F.col("e.value").eqNullSafe(F.col("e.d"))).select(*keys, "e.field", "e.value")


def violated(rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """keys, rule: a row for each rule (name to condition that must hold; null counts as broken) a row breaks."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(broken).alias("rule"))


def quality_checks() -> dict[str, Column]:
    """Rules of a quality target's row."""
    c = F.col
    return {
        "jod_in_range": (c("jod") > 0) & (c("jod") < 10),
        "crf_order": c("min_crf") < c("max_crf"),
        "crf_range": (c("min_crf") >= 1) & (c("max_crf") <= 70),
        "probe_order": c("min_probes") <= c("max_probes"),
        "probe_count": c("min_probes") >= 1,
        "tolerance": (c("tolerance") >= 0) & (c("tolerance") < 10),
        "size_cap": c("max_encoded_percent") > 0,
    }
