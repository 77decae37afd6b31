"""Decisions on tracks, pictures, profiles and work in progress, on the tables the driver supplies, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import catalogued
from .catalogued import DONE, FRAMES, SPLIT, _chunks_done, _frames, _scenes, _table, query
from chunkloom.functions import color, geometry, media
from chunkloom.operators import catalog, intervals, matching, metrics, pictures, profiles, progress, rules, search, state, timeline, tracks
from chunkloom.sources import reports

#: Line items with a line number of their own in each order (the table repeats some).
LINES = "lines AS (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l_linenumber) FROM lineitem)"


def _lines(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _table(spark, sf, "lineitem").withColumn("l_linenumber", F.row_number().over(w).cast("long"))


# -- repaired scalars --------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CAST((2 * l_partkey * (l_linenumber + 1) + l_suppkey % 9) // (2 * greatest(l_suppkey % 9, 1)) AS BIGINT) AS raw_w,
  CASE WHEN l_suppkey % 9 > 0 THEN CAST((2 * l_partkey * (l_linenumber + 1) + l_suppkey % 9) // (2 * (l_suppkey % 9)) AS BIGINT) ELSE l_partkey END AS w, l_suppkey AS h FROM lineitem""")
def display_size(spark, sf):
    li, den = _table(spark, sf, "lineitem"), F.col("l_suppkey") % 9
    d = color.display_size(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber") + 1, den).alias("d")
    raw = F.expr("(2 * l_partkey * (l_linenumber + 1) + l_suppkey % 9) div (2 * greatest(l_suppkey % 9, 1L))").alias("raw_w")
    return li.select("l_orderkey", "l_linenumber", raw, d).select("l_orderkey", "l_linenumber", "raw_w", "d.w", "d.h")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 200 + l_partkey % 1721 END AS w, 300 + l_suppkey % 781 AS h,
  l_partkey % 300 AS x, l_suppkey % 200 AS y FROM lineitem),
j AS (SELECT *, w * h * 100.0 / (1920 * 1080) AS share, abs(x - greatest(1920 - x - w, 0)) <= 96 AND abs(y - greatest(1080 - y - h, 0)) <= 54 AS centred FROM b)
SELECT l_orderkey, l_linenumber, coalesce(share >= 40 AND centred AND share < 99, false) AS use, coalesce(w IS NULL OR (share >= 40 AND centred), false) AS cacheable FROM j""")
def plausible_bars(spark, sf):
    w = F.when(F.col("l_partkey") % 11 != 0, 200 + F.col("l_partkey") % 1721)
    p = metrics.plausible_bars(w, 300 + F.col("l_suppkey") % 781, F.col("l_partkey") % 300, F.col("l_suppkey") % 200, F.lit(1920), F.lit(1080)).alias("p")
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", p).select("l_orderkey", "l_linenumber", "p.use", "p.cacheable")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey * 7919 / CAST(1048576 AS DOUBLE) < 1024 THEN printf('%.1f MB', o_orderkey * 7919 / CAST(1048576 AS DOUBLE)) ELSE printf('%.2f GB', o_orderkey * 7919 / CAST(1048576 AS DOUBLE) / 1024) END AS size,
  CASE WHEN s >= 3600 THEN printf('%dh%02dm', s // 3600, s // 60 % 60) WHEN s >= 60 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took FROM (SELECT o_orderkey, o_orderkey * 13 % 9000 AS s FROM orders)""")
def formatted_numbers(spark, sf):
    o = F.col("o_orderkey")
    return _table(spark, sf, "orders").select("o_orderkey", metrics.format_size(o * 7919).alias("size"), metrics.format_duration(o * 13 % 9000).alias("took"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN greatest(1, CAST(floor((c_custkey % 32 + 1) / 6.0) AS BIGINT)) ELSE greatest(1, least(CAST(floor((c_custkey % 32 + 1) / 6.0) AS BIGINT), CAST(floor((c_custkey % 64 + 1) / (c_nationkey * CAST(1.5 AS DOUBLE))) AS BIGINT))) END AS workers FROM customer""")
def worker_split_without_pixels(spark, sf):
    c = _table(spark, sf, "customer")
    return c.select("c_custkey", metrics.worker_split(F.col("c_custkey") % 32 + 1, (F.col("c_custkey") % 64 + 1).cast("double"), F.col("c_nationkey").cast("double"), F.lit(6)).alias("workers"))


_SOURCE = ("FL", "FR", "FC", "LFE", "SL", "SR", "BL", "BR", "DL", "DR", "TFL")


@query(f"""WITH c AS (SELECT p_partkey, list_filter([{", ".join(f"CASE WHEN (p_partkey // {2**i}) % 2 = 1 THEN '{n}' END" for i, n in enumerate(_SOURCE))}], lambda x: x IS NOT NULL) AS ch FROM part),
l(rank, layout, members) AS (VALUES {", ".join(f"({i}, '{n}', string_split('{m}', '+'))" for i, (n, m) in enumerate(matching.ENCODER_LAYOUTS))}),
s(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in matching.SUBSTITUTES.items())}),
e AS (SELECT p_partkey, ch, unnest(ch) AS c FROM c),
bad AS (SELECT DISTINCT p_partkey, rank FROM e, l LEFT JOIN s ON a = c WHERE NOT (list_contains(members, c) OR coalesce(list_contains(members, b) AND NOT list_contains(ch, b), false))),
fit AS (SELECT c.p_partkey, min(l.rank) AS rank FROM c CROSS JOIN l LEFT JOIN bad ON bad.p_partkey = c.p_partkey AND bad.rank = l.rank WHERE bad.rank IS NULL GROUP BY c.p_partkey)
SELECT c.p_partkey, CAST(len(ch) AS INTEGER) AS n, coalesce(l.layout, (SELECT layout FROM l WHERE rank = greatest(1, least(8, len(ch))) - 1)) AS layout FROM c LEFT JOIN fit USING (p_partkey) LEFT JOIN l USING (rank)""")
def encoder_layout(spark, sf):
    p = F.col("p_partkey")
    have = F.array_compact(F.array(*[F.when(F.shiftright(p, i) % 2 == 1, F.lit(n)) for i, n in enumerate(_SOURCE)]))
    return _table(spark, sf, "part").select("p_partkey", F.size(have).alias("n"), matching.smallest_layout(have).alias("layout"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber AS ordinal, l_partkey AS x FROM lineitem), b AS (SELECT l_orderkey, l_linenumber AS ordinal, l_suppkey AS y FROM lineitem WHERE l_linenumber < 5 OR l_orderkey % 2 = 0),
n AS (SELECT l_orderkey, count(*) AS n FROM a GROUP BY 1), m AS (SELECT l_orderkey, count(*) AS m FROM b GROUP BY 1)
SELECT l_orderkey, ordinal, x, y, n.n IS NOT DISTINCT FROM m.m AS even FROM a FULL JOIN b USING (l_orderkey, ordinal) JOIN n USING (l_orderkey) LEFT JOIN m USING (l_orderkey)""")
def ordinal_match(spark, sf):
    li = _table(spark, sf, "lineitem")
    a = li.select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("x"))
    b = li.where("l_linenumber < 5 or l_orderkey % 2 = 0").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.col("l_suppkey").alias("y"))
    return matching.by_ordinal(a, b, ["l_orderkey"]).select("l_orderkey", "ordinal", "x", "y", "even")


# -- geometry ----------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, 1000 + l_partkey % 13 AS w, 500 + l_suppkey % 7 AS h, l_partkey % 5 AS l, l_suppkey % 4 AS t, CASE WHEN l_partkey % 17 = 0 THEN 2000 ELSE l_linenumber % 3 END AS r, l_orderkey % 3 AS b FROM lineitem),
m AS (SELECT *, l + l % 2 AS x, t + t % 2 AS y, w - l - r AS vw, h - t - b AS vh FROM s),
f AS (SELECT *, vw > 0 AND vh > 0 AND l + vw > x + 1 AND t + vh > y + 1 AND l + t + r + b > 0 AS fits FROM m)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN fits THEN (l + vw - x) - (l + vw - x) % 2 ELSE w END AS BIGINT) AS vis_w, CAST(CASE WHEN fits THEN (t + vh - y) - (t + vh - y) % 2 ELSE h END AS BIGINT) AS vis_h,
  CAST(CASE WHEN fits THEN x ELSE 0 END AS BIGINT) AS x, CAST(CASE WHEN fits THEN y ELSE 0 END AS BIGINT) AS y FROM f""")
def visible_rectangle(spark, sf):
    c = F.col
    right = F.when(c("l_partkey") % 17 == 0, 2000).otherwise(c("l_linenumber") % 3)
    v = geometry.visible_rectangle(1000 + c("l_partkey") % 13, 500 + c("l_suppkey") % 7, c("l_partkey") % 5, c("l_suppkey") % 4, right, c("l_orderkey") % 3).alias("v")
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v).select("l_orderkey", "l_linenumber", c("v.w").alias("vis_w"), c("v.h").alias("vis_h"), "v.x", "v.y")


@query("""WITH s AS (SELECT p_partkey, 1280 + p_partkey % 3 AS w, 720 + p_partkey % 5 AS h, p_partkey % 4 AS kind, 2 * (p_partkey % 40) AS m, CASE WHEN p_partkey % 2 = 0 THEN 480 + p_partkey % 9 END AS target, p_partkey % 3 = 0 AS fields FROM part),
a AS (SELECT *, CASE kind WHEN 0 THEN w - 10 WHEN 1 THEN w + 10 END AS cw, CASE WHEN kind < 2 THEN h - 2 * m - 3 END AS ch, CASE WHEN kind < 2 THEN 5 END AS cx, CASE WHEN kind < 2 THEN m + 1 END AS cy FROM s),
e AS (SELECT *, cw - cw % 2 AS ew, ch - ch % 2 AS eh, cx - cx % 2 AS ex, cy - cy % 2 AS ey FROM a),
n AS (SELECT *, coalesce(ew > 0 AND eh > 0 AND ex + ew <= w AND ey + eh <= h, false) AS ok, w % 2 <> 0 OR h % 2 <> 0 AS odd FROM e),
c AS (SELECT *, CASE WHEN ok THEN ew WHEN odd THEN w - w % 2 END AS gw, CASE WHEN ok THEN eh WHEN odd THEN h - h % 2 END AS gh, CASE WHEN ok THEN ex WHEN odd THEN 0 END AS gx, CASE WHEN ok THEN ey WHEN odd THEN 0 END AS gy FROM n),
f AS (SELECT *, CASE WHEN fields AND gy % 4 = 2 AND gh > 2 THEN 2 ELSE 0 END AS d FROM c),
z AS (SELECT *, coalesce(gw, w) AS fw, coalesce(gh - d, h) AS fh, target - target % 2 AS th FROM f),
q AS (SELECT *, CASE WHEN fh > target THEN ((2 * fw * th + fh) // (2 * fh)) - ((2 * fw * th + fh) // (2 * fh)) % 2 END AS sw, CASE WHEN fh > target THEN th END AS sh FROM z)
SELECT p_partkey, CASE WHEN gw IS NOT NULL THEN 'crop=' || gw || ':' || (gh - d) || ':' || gx || ':' || (gy + d) END AS crop, CAST(sw AS BIGINT) AS scale_w, CAST(sh AS BIGINT) AS scale_h,
  nullif(concat_ws(',', CASE WHEN gw IS NOT NULL THEN 'crop=' || gw || ':' || (gh - d) || ':' || gx || ':' || (gy + d) END, CASE WHEN fields THEN 'bwdif' END, CASE WHEN sw IS NOT NULL THEN 'scale=' || sw || ':' || sh END), '') AS chain FROM q""")
def output_geometry(spark, sf):
    p = F.col("p_partkey")
    w, h, m = 1280 + p % 3, 720 + p % 5, 2 * (p % 40)
    text = F.when(p % 4 < 2, F.concat(F.lit("crop="), F.concat_ws(":", F.when(p % 4 == 0, w - 10).otherwise(w + 10).cast("string"), (h - 2 * m - 3).cast("string"), F.lit("5"), (m + 1).cast("string"))))
    g = geometry.output_geometry(w, h, text, F.when(p % 2 == 0, 480 + p % 9), p % 3 == 0)
    rows = _table(spark, sf, "part").select("p_partkey", g.alias("g"), (p % 3 == 0).alias("fields"))
    chain = geometry.filter_chain(F.col("g.crop"), F.when(F.col("fields"), "bwdif"), F.col("g.scale"))
    return rows.select("p_partkey", geometry.format_rectangle(F.col("g.crop")).alias("crop"), F.col("g.scale.w").alias("scale_w"), F.col("g.scale.h").alias("scale_h"), chain.alias("chain"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, ['420', '422', '444', '411'][l_partkey % 4 + 1] AS sub, CAST([8, 10, 12, 9][l_suppkey % 4 + 1] AS INTEGER) AS depth, CASE WHEN l_linenumber % 3 = 0 THEN 8 END AS target, ['left', 'topleft', 'bottom', 'center'][l_orderkey % 4 + 1] AS loc, ['horizontal', 'vertical'][l_linenumber % 3 + 1] AS mirror FROM lineitem),
o AS (SELECT *, coalesce(target, least(depth, 10)) AS d FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN depth = 9 OR sub = '411' THEN '420' WHEN depth = 8 THEN sub ELSE sub || 'p' || depth END AS header,
  CASE WHEN sub <> '411' AND depth = 8 THEN 'yuv' || sub || 'p' WHEN sub <> '411' AND depth = 10 THEN 'yuv' || sub || 'p10le' END AS decoder,
  array_to_string(list_filter([CASE WHEN d <> depth THEN 'bit-depth conversion: ' || depth || '-bit to ' || d || '-bit' END, CASE WHEN sub <> '420' THEN 'chroma conversion: ' || sub || ' to 420' END], lambda x: x IS NOT NULL), '; ') AS notes,
  coalesce(CASE mirror WHEN 'horizontal' THEN sub <> '444' AND loc LIKE '%left' WHEN 'vertical' THEN sub = '420' AND (loc LIKE 'top%' OR loc LIKE 'bottom%') END, false) AS moves FROM o""")
def pixel_formats(spark, sf):
    c = F.col
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    sub, depth = pick(("420", "422", "444", "411"), c("l_partkey") % 4), pick((8, 10, 12, 9), c("l_suppkey") % 4)
    notes = geometry.conversion_notes(sub, depth, F.when(c("l_linenumber") % 3 == 0, 8))
    moves = geometry.moves_chroma(pick(("horizontal", "vertical"), c("l_linenumber") % 3), pick(("left", "topleft", "bottom", "center"), c("l_orderkey") % 4), sub)
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", geometry.header_colorspace(sub, depth).alias("header"), geometry.decoder_format(sub, depth).alias("decoder"), F.array_join(notes, "; ").alias("notes"), moves.alias("moves"))


# -- tracks ------------------------------------------------------------------------------------------

_TAGS = "['eng', 'ger', 'en', 'fra, deu', 'und', 'DEU']"
_STREAMS = f"""{LINES}, s AS (SELECT l_orderkey, l_linenumber - 1 AS ordinal, CASE WHEN l_partkey % 4 = 0 THEN l_linenumber END AS id, CASE WHEN l_partkey % 7 > 0 THEN {_TAGS}[l_partkey % 6 + 1] END AS language FROM lines),
t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ordinal, l_linenumber AS number, ['eng', 'deu', 'fra'][l_suppkey % 3 + 1] AS legacy, CASE WHEN l_suppkey % 2 = 0 THEN ['en-GB', 'de', 'fr-CA'][l_suppkey % 3 + 1] END AS ietf FROM lines WHERE l_orderkey % 3 > 0 OR l_linenumber <> 2)"""


def _two_catalogs(spark, sf):
    c, li = F.col, _lines(spark, sf)
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    place = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).cast("long").alias("ordinal")
    language = F.when(c("l_partkey") % 7 > 0, pick(("eng", "ger", "en", "fra, deu", "und", "DEU"), c("l_partkey") % 6))
    s = li.select("l_orderkey", place, F.when(c("l_partkey") % 4 == 0, c("l_linenumber")).alias("id"), language.alias("language"))
    legacy, ietf = pick(("eng", "deu", "fra"), c("l_suppkey") % 3), F.when(c("l_suppkey") % 2 == 0, pick(("en-GB", "de", "fr-CA"), c("l_suppkey") % 3))
    t = li.where("l_orderkey % 3 > 0 or l_linenumber <> 2").select("l_orderkey", place, c("l_linenumber").alias("number"), legacy.alias("legacy"), ietf.alias("ietf"))
    return s, t


@query(f"""WITH {_STREAMS}, n AS (SELECT a.l_orderkey FROM (SELECT l_orderkey, count(*) AS n FROM s GROUP BY 1) a JOIN (SELECT l_orderkey, count(*) AS n FROM t GROUP BY 1) b ON a.l_orderkey = b.l_orderkey AND a.n = b.n),
j AS (SELECT s.l_orderkey, s.ordinal, s.language, t.legacy, t.ietf, trim(string_split(s.language, ',')[1]) AS first FROM s LEFT JOIN t ON s.l_orderkey = t.l_orderkey AND CASE WHEN s.id IS NOT NULL THEN t.number = s.id ELSE t.ordinal = s.ordinal AND s.l_orderkey IN (SELECT l_orderkey FROM n) END),
k AS (SELECT *, CASE lower(first) WHEN 'ger' THEN 'deu' ELSE lower(first) END AS base FROM j)
SELECT l_orderkey, ordinal, CASE WHEN legacy IS NOT NULL AND language IS NOT NULL THEN CASE WHEN first <> language THEN coalesce(ietf, legacy) WHEN base = legacy THEN ietf END END AS tag, legacy FROM k""")
def language_catalog(spark, sf):
    s, t = _two_catalogs(spark, sf)
    return tracks.language_catalog(s, t, ["l_orderkey"])


@query(f"""WITH {_STREAMS}, k AS (SELECT *, language IS NULL OR lower(trim(language)) IN ('', 'und') OR list_has_any(list_transform(string_split(language, ','), lambda x: CASE lower(trim(x)) WHEN 'ger' THEN 'deu' ELSE lower(trim(x)) END), ['deu', 'spa']) AS kept FROM s)
SELECT l_orderkey, array_to_string(list(coalesce(language, 'und') ORDER BY ordinal), ', ') AS languages FROM k GROUP BY l_orderkey HAVING count(*) FILTER (kept) = 0""")
def nothing_matched(spark, sf):
    s, _ = _two_catalogs(spark, sf)
    return tracks.nothing_matched(s, ["l_orderkey"], rules.language_selected(F.col("language"), ["deu", "spa"]))


@query("""SELECT o_orderkey, [' ', 'de-AT', 'GER', 'en', 'fra,ger', 'und', 'und, fra'][o_orderkey % 7 + 1] AS tag, ['deu', 'eng'][o_orderkey % 3 + 1] AS legacy,
  CASE o_orderkey % 7 WHEN 1 THEN false WHEN 3 THEN false WHEN 6 THEN false ELSE true END AS by_tag, CASE o_orderkey % 7 WHEN 1 THEN o_orderkey % 3 = 0 WHEN 3 THEN o_orderkey % 3 = 0 WHEN 6 THEN o_orderkey % 3 = 0 ELSE true END AS by_either FROM orders""")
def language_fallback(spark, sf):
    o = F.col("o_orderkey")
    tag, legacy = F.get(F.array(*map(F.lit, (" ", "de-AT", "GER", "en", "fra,ger", "und", "und, fra"))), (o % 7).cast("int")), F.get(F.array(F.lit("deu"), F.lit("eng")), (o % 3).cast("int"))
    rows = _table(spark, sf, "orders").select("o_orderkey", tag.alias("tag"), legacy.alias("legacy"))
    return rows.select("*", rules.language_selected(F.col("tag"), ["deu"]).alias("by_tag"), rules.selected_with_fallback(F.col("tag"), F.col("legacy"), ["deu"]).alias("by_either"))


_PLAN = """p AS (SELECT o_orderkey, ['dts', 'flac', 'aac', 'pcm_s16le', 'ac3'][o_orderkey % 5 + 1] AS codec_name, CASE WHEN o_orderkey % 2 = 0 THEN 'DTS-HD MA' END AS profile, CAST(o_orderkey % 9 AS INTEGER) AS channels, o_orderkey % 7 > 0 AS decodable, o_orderkey % 3 > 0 AS copies, CASE WHEN o_orderkey % 11 = 0 THEN 4 END AS twin, o_custkey % 4 AS setting FROM orders),
l AS (SELECT *, CASE WHEN codec_name = 'dts' THEN profile IS NOT NULL ELSE codec_name IN ('pcm_s16le', 'flac') END AS lossless FROM p),
r AS (SELECT *, CASE WHEN setting = 0 THEN 'copy' WHEN setting = 1 AND codec_name = 'aac' THEN 'copy' ELSE 'encode' END AS mode,
  CASE WHEN setting = 0 THEN NULL WHEN setting = 1 THEN 'aac' WHEN setting = 2 THEN CASE WHEN lossless THEN 'flac' ELSE 'aac' END ELSE NULL END AS codec FROM l),
a AS (SELECT *, CASE WHEN mode = 'copy' OR NOT decodable THEN CASE WHEN twin IS NOT NULL THEN 'from_source' WHEN copies THEN 'copy' WHEN decodable THEN 'pcm' ELSE 'skip' END WHEN codec IS NULL THEN 'error' ELSE 'encode' END AS action FROM r)"""


@query(f"""WITH {_PLAN} SELECT o_orderkey, lossless, mode, action, CASE action WHEN 'encode' THEN codec WHEN 'pcm' THEN 'pcm_s16le' END AS out_codec,
  CASE WHEN action = 'encode' AND codec = 'aac' THEN CASE least(8, greatest(1, channels)) WHEN 2 THEN '160k' WHEN 6 THEN '384k' ELSE '96k' END END AS out_bitrate FROM a""")
def audio_plan(spark, sf):
    o = F.col("o_orderkey")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    t = _table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 4).alias("setting"), F.lit(0).alias("ordinal"), pick(("dts", "flac", "aac", "pcm_s16le", "ac3"), o % 5).alias("codec_name"), F.when(o % 2 == 0, "DTS-HD MA").alias("profile"),
        (o % 9).cast("int").alias("channels"), F.lit(None).cast("string").alias("layout"), F.lit("s16").alias("sample_format"), F.lit(16).alias("bits"), (o % 7 > 0).alias("decodable"), (o % 3 > 0).alias("copies"), F.when(o % 11 == 0, 4).alias("twin"),
    )
    rate = '{stereo = "160k", "5.1" = "384k", default = "96k"}'
    texts = {
        "0": 'encoder = "x"\n[audio]\nmode = "copy"', "1": f'encoder = "x"\n[audio]\nmode = "encode"\ncodec = "aac"\nbitrate = {rate}\n[audio.codec_rules.aac]\nmode = "copy"',
        "2": f'encoder = "x"\n[audio]\nmode = "encode"\ncodec = "aac"\nbitrate = {rate}\n[audio.lossless]\ncodec = "flac"', "3": 'encoder = "x"\n[audio]\nmode = "encode"',
    }
    config = profiles.read_profiles(spark, texts).select(F.col("profile").cast("long").alias("setting"), "audio")
    return tracks.audio_plan(t, config, "setting", ["flac"]).select("o_orderkey", "lossless", "mode", "action", "out_codec", "out_bitrate")


@query(f"""WITH {_STREAMS}, r AS (SELECT s.*, CASE ordinal % 3 WHEN 0 THEN 'extract' WHEN 1 THEN 'extract_srt' ELSE 'mux' END AS route, language IS NULL OR lower(language) = 'und' OR list_has_any(list_transform(string_split(language, ','), lambda x: CASE lower(trim(x)) WHEN 'ger' THEN 'deu' ELSE lower(trim(x)) END), ['deu']) AS sel FROM s),
n AS (SELECT a.l_orderkey FROM (SELECT l_orderkey, count(*) AS n FROM s GROUP BY 1) a JOIN (SELECT l_orderkey, count(*) AS n FROM t GROUP BY 1) b ON a.l_orderkey = b.l_orderkey AND a.n = b.n)
SELECT l_orderkey, ordinal, route, CAST(NULL AS BIGINT) AS track, sel AS kept, CASE WHEN NOT sel THEN 'language' END AS reason FROM r WHERE route <> 'mux'
UNION ALL SELECT r.l_orderkey, r.ordinal, route, CAST(t.number + 100 AS BIGINT), coalesce(t.legacy = 'deu', false), CASE WHEN t.number IS NULL THEN 'unsupported' WHEN t.legacy <> 'deu' THEN 'language' END
FROM r LEFT JOIN t ON r.l_orderkey = t.l_orderkey AND CASE WHEN r.id IS NOT NULL THEN t.number = r.id ELSE t.ordinal = r.ordinal AND r.l_orderkey IN (SELECT l_orderkey FROM n) END WHERE route = 'mux'""")
def subtitle_plan(spark, sf):
    s, t = _two_catalogs(spark, sf)
    codec = F.get(F.array(F.lit("subrip"), F.lit("mov_text"), F.lit("eia_608")), (F.col("ordinal") % 3).cast("int"))
    streams = s.withColumn("codec", codec).withColumn("legacy", F.lit(None).cast("string"))
    return tracks.subtitle_plan(streams, t.select("l_orderkey", "ordinal", "number", (F.col("number") + 100).cast("long").alias("track"), F.col("legacy").alias("language")), ["l_orderkey"], ["deu"])


@query(f"""WITH {LINES}, p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 > 0 THEN l_quantity END AS size, first_value(l_suppkey % 90) OVER w AS skip, first_value(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) OVER w AS padding,
  row_number() OVER w - 1 AS k FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
h AS (SELECT *, coalesce(size > 0 AND before + size / 2 < skip AND padding <= 0, false) AS ok FROM b)
SELECT l_orderkey, CAST(coalesce(min(k) FILTER (NOT ok), count(*)) AS BIGINT) AS n FROM h GROUP BY l_orderkey""")
def priming_packets(spark, sf):
    c = F.col
    p = _lines(spark, sf).select("l_orderkey", "l_linenumber", F.when(c("l_partkey") % 10 > 0, c("l_quantity").cast("double")).alias("seconds"), F.lit(1e0).alias("rate"), (c("l_suppkey") % 90).alias("skip"), F.when(c("l_partkey") % 5 == 0, 1).otherwise(0).alias("padding"))
    return tracks.priming_packets(p, ["l_orderkey"], ["l_linenumber"])


@query(f"""WITH {LINES} SELECT l_orderkey, CASE WHEN count(*) FILTER (l_partkey % 3 = 0) = 0 THEN '--no-audio' ELSE '--audio-tracks ' || array_to_string(list(l_suppkey ORDER BY l_linenumber) FILTER (l_partkey % 3 = 0), ',') END AS args FROM lines GROUP BY l_orderkey""")
def track_selector(spark, sf):
    t = _lines(spark, sf).select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey")).alias("track"))
    return tracks.selector(t, ["l_orderkey"], "--audio-tracks", "--no-audio").select("l_orderkey", F.array_join("args", " ").alias("args"))


@query(f"""WITH {LINES} SELECT l_orderkey, CAST(coalesce(min(l_linenumber) FILTER (l_returnflag <> 'N') - 1, count(*)) AS BIGINT) AS n FROM lines GROUP BY l_orderkey""")
def leading_videos(spark, sf):
    t = _lines(spark, sf).select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_returnflag") == "N", "video").otherwise("audio").alias("kind"))
    return tracks.leading_videos(t, ["l_orderkey"])


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN 'x|y' ELSE array_to_string(CASE p_size % 5 WHEN 0 THEN ['FL', 'FR', 'FC', 'LFE', 'SL', 'SR'] WHEN 1 THEN ['FL', 'FR'] WHEN 2 THEN ['FC', 'LFE'] ELSE ['FL', 'TFL'] END, '|') END AS channels FROM part""")
def layout_channels(spark, sf):
    layout = F.get(F.array(*map(F.lit, ("5.1(side)", "stereo", "FC+LFE", "2 channels (FL+TFL)", "odd one"))), (F.col("p_size") % 5).cast("int"))
    return _table(spark, sf, "part").select("p_partkey", F.coalesce(F.array_join(tracks.channels_of(layout), "|"), F.lit("x|y")).alias("channels"))


# -- crop, fields, HDR -------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey, CASE WHEN l_partkey % 40 = 0 THEN 'failed' WHEN l_partkey % 400 = 1 THEN 'transient' WHEN l_partkey % 9 = 0 THEN 'none' ELSE 'ok' END AS status, 1800 + l_partkey % 60 AS w, 700 + l_suppkey % 90 AS h, l_partkey % 20 AS x, 100 + l_suppkey % 40 AS y FROM lineitem),
p AS (SELECT DISTINCT l_orderkey, CASE l_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'crop=1600:800:164:144' WHEN 2 THEN 'crop=1601:800:4:4' END AS cached FROM lineitem),
m AS (SELECT *, CASE WHEN cached = '' THEN 'none' WHEN cached = 'crop=1600:800:164:144' THEN 'cached' END AS known FROM p),
f AS (SELECT s.* FROM s JOIN m USING (l_orderkey) WHERE known IS NULL),
o AS (SELECT l_orderkey, bool_or(status = 'transient') AS tr, bool_or(status = 'ok') AS ok, bool_or(status = 'failed') AS failed,
  min(x) FILTER (status = 'ok') AS x, min(y) FILTER (status = 'ok') AS y, max(x + w) FILTER (status = 'ok') AS r, max(y + h) FILTER (status = 'ok') AS b FROM f GROUP BY l_orderkey),
e AS (SELECT *, (r - x) - (r - x) % 2 AS ew, (b - y) - (b - y) % 2 AS eh, x - x % 2 AS ex, y - y % 2 AS ey FROM o),
n AS (SELECT *, ew > 0 AND eh > 0 AND ex + ew <= 1912 AND ey + eh <= 1072 AS there FROM e),
j AS (SELECT *, ew * eh * 100.0 / (1912 * 1072) AS share, abs(ex - greatest(1912 - ex - ew, 0)) <= 95 AND abs(ey - greatest(1072 - ey - eh, 0)) <= 53 AS centred FROM n),
d AS (SELECT *, CASE WHEN tr OR (NOT ok AND failed) THEN 'error' WHEN NOT ok THEN 'nothing' WHEN failed THEN 'uncached' ELSE 'cached' END AS outcome, coalesce(there AND share >= 40 AND centred AND share < 99, false) AS use, coalesce(NOT there OR (share >= 40 AND centred), true) AS sure FROM j)
SELECT m.l_orderkey, CASE WHEN known = 'cached' THEN cached WHEN outcome IN ('cached', 'uncached') AND use THEN 'crop=' || ew || ':' || eh || ':' || (ex + 4) || ':' || (ey + 4) END AS crop,
  coalesce(known, CASE WHEN outcome = 'error' THEN 'error' WHEN outcome IN ('cached', 'uncached') AND use THEN 'crop' ELSE 'none' END) AS outcome, coalesce(known IS NULL AND outcome = 'cached' AND sure, false) AS keep FROM m LEFT JOIN d USING (l_orderkey)""")
def crop_decision(spark, sf):
    c, li = F.col, _table(spark, sf, "lineitem")
    status = F.when(c("l_partkey") % 40 == 0, "failed").when(c("l_partkey") % 400 == 1, "transient").when(c("l_partkey") % 9 == 0, "none").otherwise("ok")
    s = li.select("l_orderkey", status.alias("status"), (1800 + c("l_partkey") % 60).alias("w"), (700 + c("l_suppkey") % 90).alias("h"), (c("l_partkey") % 20).alias("x"), (100 + c("l_suppkey") % 40).alias("y"))
    o = c("l_orderkey") % 8
    cached = F.when(o == 0, "").when(o == 1, "crop=1600:800:164:144").when(o == 2, "crop=1601:800:4:4")
    visible = geometry.rectangle(F.lit(1912), F.lit(1072), F.lit(4), F.lit(4)).alias("visible")
    return pictures.crop_decision(s, li.select("l_orderkey").distinct().select("l_orderkey", visible, cached.alias("cached")), ["l_orderkey"])


@query("""WITH v AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS tff, count(*) FILTER (event_type = 'purchase') AS bff FROM events GROUP BY user_id),
s AS (SELECT *, user_id % 5 <> 1 AS flagged, CASE user_id % 7 WHEN 0 THEN 'progressive' WHEN 1 THEN 'bff' WHEN 2 THEN 'odd' END AS cached FROM v),
t AS (SELECT *, coalesce(cached IN ('progressive', 'bff', 'tff'), false) AS told FROM s)
SELECT user_id, CASE WHEN told THEN nullif(cached, 'progressive') WHEN flagged AND greatest(tff, bff) >= 20 AND greatest(tff, bff) >= 4 * least(tff, bff) THEN CASE WHEN tff >= bff THEN 'tff' ELSE 'bff' END END AS fields, NOT told AND flagged AS measured FROM t""")
def field_order(spark, sf):
    e, u = _table(spark, sf, "events"), F.col("user_id")
    votes = e.groupBy("user_id", F.expr("event_id % 3").alias("window")).agg(F.count_if(F.col("event_type") == "click").alias("tff"), F.count_if(F.col("event_type") == "purchase").alias("bff"))
    cached = F.when(u % 7 == 0, "progressive").when(u % 7 == 1, "bff").when(u % 7 == 2, "odd")
    return pictures.field_order(votes, e.select("user_id").distinct().select("user_id", (u % 5 != 1).alias("flagged"), cached.alias("cached")), ["user_id"])


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, ['bt709', 'unknown', '', 'bt2020'][l_partkey % 4 + 1] AS sp, ['bt709', 'smpte2084', 'bt2020-10'][l_suppkey % 3 + 1] AS st, ['bt709', 'unknown'][l_partkey % 2 + 1] AS sm, ['bt2020', 'unknown'][l_orderkey % 3 + 1] AS fp, ['arib-std-b67', 'smpte2084', 'bt709'][l_linenumber % 4 + 1] AS ft, ['bt2020nc', ''][l_suppkey % 3 + 1] AS fm FROM lineitem),
t AS (SELECT *, CASE WHEN ft IN ('smpte2084', 'arib-std-b67') THEN ft END AS told FROM s), b AS (SELECT *, coalesce(told <> st, false) AS byf FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN byf AND fp NOT IN ('', 'unknown') THEN fp WHEN sp IN ('', 'unknown') AND fp IS NOT NULL THEN fp ELSE sp END AS primaries, coalesce(told, st) AS transfer, CASE WHEN byf AND fm NOT IN ('', 'unknown') THEN fm WHEN sm IN ('', 'unknown') AND fm IS NOT NULL THEN fm ELSE sm END AS matrix FROM b""")
def color_description(spark, sf):
    c = F.col
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    stream = F.struct(pick(("bt709", "unknown", "", "bt2020"), c("l_partkey") % 4).alias("primaries"), pick(("bt709", "smpte2084", "bt2020-10"), c("l_suppkey") % 3).alias("transfer"), pick(("bt709", "unknown"), c("l_partkey") % 2).alias("matrix"))
    frame = F.struct(pick(("bt2020", "unknown"), c("l_orderkey") % 3).alias("primaries"), pick(("arib-std-b67", "smpte2084", "bt709"), c("l_linenumber") % 4).alias("transfer"), pick(("bt2020nc", ""), c("l_suppkey") % 3).alias("matrix"))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pictures.color_description(stream, frame).alias("d")).select("l_orderkey", "l_linenumber", "d.*")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 20 END AS p, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 19 END AS t, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 15 END AS m, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 END AS c, CASE WHEN l_orderkey % 2 = 0 THEN 1 END AS r, l_suppkey % 5 = 0 AS rgb FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, p, t, CASE WHEN rgb THEN 5 ELSE m END AS m, CASE WHEN NOT rgb THEN c END AS c, CASE WHEN NOT rgb THEN r END AS r FROM s)
SELECT l_orderkey, l_linenumber, concat_ws(' ', CASE WHEN p IS NOT NULL THEN '--color-primaries ' || p END, CASE WHEN t IS NOT NULL THEN '--transfer-characteristics ' || t END, CASE WHEN m IS NOT NULL THEN '--matrix-coefficients ' || m END, CASE WHEN c IS NOT NULL THEN '--chroma-sample-position ' || c END, CASE WHEN r IS NOT NULL THEN '--color-range ' || r END) AS args,
  concat_ws(' ', CASE WHEN m IS NOT NULL THEN '--color-matrix-coefficients 0:' || m END, CASE WHEN t IS NOT NULL THEN '--color-transfer-characteristics 0:' || t END, CASE WHEN p IS NOT NULL THEN '--color-primaries 0:' || p END, CASE WHEN coalesce(p, t, m) IS NOT NULL OR r = 1 THEN '--color-range 0:' || CASE WHEN r = 1 THEN '2' ELSE '1' END END, CASE c WHEN 1 THEN '--chroma-siting 0:1,2' WHEN 2 THEN '--chroma-siting 0:1,1' END) AS mux,
  concat_ws(' ', CASE WHEN m IS NULL THEN '--matrix-coefficients ' || CASE WHEN l_linenumber * 200 > 650 THEN '1' ELSE '5' END END, CASE WHEN l_orderkey % 2 = 0 AND t IS NULL THEN '--transfer-characteristics 13' END, CASE WHEN l_orderkey % 2 = 0 AND p IS NULL THEN '--color-primaries 1' END) AS tags,
  CASE WHEN t = 16 THEN 'cambi=full_ref=true:eotf=pq' ELSE 'cambi=full_ref=true' END AS banding FROM v""")
def color_arguments(spark, sf):
    c = F.col
    codes = {"primaries": F.when(c("l_partkey") % 3 > 0, c("l_partkey") % 20), "transfer": F.when(c("l_suppkey") % 3 > 0, c("l_suppkey") % 19), "matrix": F.when(c("l_partkey") % 4 > 0, c("l_partkey") % 15), "chroma": F.when(c("l_linenumber") % 3 > 0, c("l_linenumber") % 3), "range": F.when(c("l_orderkey") % 2 == 0, 1)}
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pictures.color_args(codes, c("l_suppkey") % 5 == 0).alias("a"))
    tags = pictures.comparison_tags(c("a"), c("l_linenumber") * 200, c("l_orderkey") % 2 == 0)
    return rows.select("l_orderkey", "l_linenumber", F.array_join("a", " ").alias("args"), F.array_join(pictures.mux_color_args(c("a"), F.lit(0)), " ").alias("mux"), F.array_join(tags, " ").alias("tags"), pictures.banding_feature(c("a")).alias("banding"))


@query(f"""WITH {LINES}, s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey AS VARCHAR) END AS c, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS a, CASE WHEN l_partkey % 4 > 0 THEN l_partkey || '/2' END AS n FROM lines),
v AS (SELECT *, CAST(string_split(n, '/')[1] AS DOUBLE) / 2 AS q FROM s), w AS (SELECT *, replace(CAST(q AS VARCHAR) || '#', '.0#', '') AS z FROM v), u AS (SELECT *, replace(z, '#', '') AS t FROM w)
SELECT l_orderkey, arg_min(c || ',' || a, l_linenumber) FILTER (c IS NOT NULL AND a IS NOT NULL) AS light,
  arg_min('G(' || t || ',' || t || ')B(' || t || ',' || t || ')R(' || t || ',' || t || ')WP(' || t || ',' || t || ')L(' || t || ',' || t || ')', l_linenumber) FILTER (n IS NOT NULL) AS mastering FROM u GROUP BY l_orderkey""")
def static_metadata(spark, sf):
    c = F.col
    n = F.when(c("l_partkey") % 4 > 0, F.concat(c("l_partkey").cast("string"), F.lit("/2")))
    ten = [n.alias(x) for x in ("red_x", "red_y", "green_x", "green_y", "blue_x", "blue_y", "white_point_x", "white_point_y", "min_luminance", "max_luminance")]
    rows = _lines(spark, sf).select("l_orderkey", "l_linenumber", F.when(c("l_partkey") % 3 > 0, c("l_partkey").cast("string")).alias("max_content"), F.when(c("l_suppkey") % 2 == 0, c("l_suppkey").cast("string")).alias("max_average"), *ten)
    return pictures.static_metadata(rows, ["l_orderkey"], ["l_linenumber"])


@query(f"""WITH {LINES}, p AS (SELECT l_orderkey, l_linenumber AS ordinal, CASE WHEN l_partkey % 50 > 0 THEN l_suppkey END AS pts, CASE WHEN l_partkey % 4 = 0 THEN 'KD' ELSE 'K_' END AS flags FROM lines),
u AS (SELECT l_orderkey, l_linenumber AS ordinal, CASE WHEN l_partkey % 3 = 0 THEN 'm' || l_partkey END AS message FROM lines WHERE l_orderkey % 7 > 0 OR l_linenumber <> 3),
n AS (SELECT l_orderkey, count(*) AS n, count(pts) AS timed FROM p GROUP BY 1), m AS (SELECT l_orderkey, count(*) AS m FROM u GROUP BY 1),
z AS (SELECT l_orderkey, CASE WHEN n IS DISTINCT FROM m THEN coalesce(n, 0) || ' packets but ' || coalesce(m, 0) || ' pictures' WHEN timed < n THEN 'a packet without a time' END AS problem FROM n FULL JOIN m USING (l_orderkey)),
c AS (SELECT p.l_orderkey, pts, ordinal, flags, last_value(message IGNORE NULLS) OVER (PARTITION BY p.l_orderkey ORDER BY pts, ordinal ROWS UNBOUNDED PRECEDING) AS message FROM p JOIN u USING (l_orderkey, ordinal) JOIN z ON z.l_orderkey = p.l_orderkey AND problem IS NULL)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY pts, ordinal) - 1 AS BIGINT) AS frame, message, CAST(NULL AS VARCHAR) AS problem FROM c WHERE flags NOT LIKE '%D%'
UNION ALL SELECT l_orderkey, NULL, NULL, problem FROM z WHERE problem IS NOT NULL""")
def display_order_messages(spark, sf):
    c, li = F.col, _lines(spark, sf)
    p = li.select("l_orderkey", c("l_linenumber").alias("ordinal"), F.when(c("l_partkey") % 50 > 0, c("l_suppkey")).alias("pts"), F.when(c("l_partkey") % 4 == 0, "KD").otherwise("K_").alias("flags"))
    u = li.where("l_orderkey % 7 > 0 or l_linenumber <> 3").select("l_orderkey", c("l_linenumber").alias("ordinal"), F.when(c("l_partkey") % 3 == 0, F.concat(F.lit("m"), c("l_partkey").cast("string"))).alias("message"))
    return pictures.messages_in_order(p, u, ["l_orderkey"])


@query(f"""WITH {SPLIT}, f AS (SELECT user_id, frame, CASE WHEN event_id % 3 > 0 THEN event_id END AS message, event_id % 5 > 0 AS readable FROM frames),
j AS (SELECT c.user_id, c.index, f.frame - c.start_frame AS local, message, message IS NOT NULL AND readable AS ok, frame FROM f JOIN chunks c ON f.user_id = c.user_id AND f.frame BETWEEN c.start_frame AND c.end_frame),
l AS (SELECT user_id, arg_min(message, frame) AS lent FROM j WHERE index = 0 AND ok GROUP BY user_id)
SELECT j.user_id, index, CAST(local AS BIGINT) AS local, CASE WHEN ok THEN message WHEN index = 0 AND local = 0 THEN lent END AS message, ok AS readable FROM j LEFT JOIN l USING (user_id)""")
def chunk_metadata(spark, sf):
    frames = _frames(spark, sf)
    chunks = intervals.bounded_split(_scenes(frames), ["user_id"], 5)
    e = F.col("event_id")
    return pictures.chunk_metadata(frames.select("user_id", "frame", F.when(e % 3 > 0, e).alias("message"), (e % 5 > 0).alias("readable")), chunks, ["user_id"])


@query(f"WITH {FRAMES} SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS without, min(frame) FILTER (event_id % 3 > 0 AND event_id % 5 > 0) AS first_readable FROM frames GROUP BY user_id")
def unreadable_frames(spark, sf):
    e = F.col("event_id")
    return pictures.unreadable_frames(_frames(spark, sf).select("user_id", "frame", F.when(e % 3 > 0, e).alias("message"), (e % 5 > 0).alias("readable")), ["user_id"])


# -- profiles ----------------------------------------------------------------------------------------

_PROFILES = {
    "good": 'encoder = "x"\n[audio]\nmode = "encode"\ncodec = "libopus"\nbitrate = "128k"\nlanguage_whitelist = ["eng", "deu-AT"]',
    "no_encoder": "[picture]\nscale = 32\nbit_depth = 9",
    "copied": '[picture]\nvideo = "copy"\n[target_quality]\njod = 9.5',
    "numbers": 'encoder = "x"\n[encoder_params]\ncrf = nan\ncolor-primaries = "bt709"\nrc = 1\n[picture]\ndv = true\nbit_depth = 8\n[target_quality]\njod = 10\nmin_crf = 0\nmax_crf = 71\nmin_probes = 1\nmax_probes = 0\ntolerance = inf\nprobe_preset = 14\nmax_encoded_percent = 0\nmax_cambi = -1\nmax_cambi_diff = nan',
    "scenes": 'encoder = "x"\n[scene_detection]\nmin_scene_len = 0\nextra_split = 23\ndownscale_height = 63\n[target_quality]\nmin_crf = 9\nmax_crf = 9',
    "sound": 'encoder = "x"\n[audio]\nmode = "encode"\nlanguage_whitelist = ["en"]\n[subtitles]\nlanguage_whitelist = ["germ"]\n[audio.lossless]\ncodec = "flac"\nbitrate = "192"\n[audio.codec_rules.dts]\ncodec = "aac"\n[audio.codec_rules.aac]\nmode = "copy"\nbitrate = {stereo = "1m", odd = "64k"}',
}
_BROKEN = {
    "no_encoder": ("encoder_required", "bit_depth", "scale"),
    "copied": ("quality_needs_encode",),
    "numbers": ("dv_bit_depth", "crf_number", "code.color-primaries", "quality_rate_control", "quality_color", "jod_range", "min_crf", "max_crf", "min_probes", "probe_order", "probe_preset", "tolerance", "size_cap", "max_cambi", "max_cambi_diff"),
    "scenes": ("jod_required", "crf_order", "min_scene_len", "extra_split", "downscale_height"),
    "sound": ("audio.language", "subtitles.language", "audio.codec_required", "audio.lossless.bitrate_small", "audio.codec_rules.bitrate_layout", "audio.codec_rules.bitrate_form", "audio.codec_rules.bitrate_required"),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{r}')" for p, rs in _BROKEN.items() for r in rs) + ") t(profile, rule)")
def profile_rules(spark, sf):
    return profiles.broken_rules(profiles.read_profiles(spark, _PROFILES))


@query("SELECT * FROM (VALUES ('sound', 'dts')) t(profile, codec)")
def unknown_codec_rules(spark, sf):
    known = spark.createDataFrame([("aac",), ("flac",)], "name string")
    return profiles.unknown_codecs(profiles.read_profiles(spark, _PROFILES), known)


# -- work in progress --------------------------------------------------------------------------------

_CHUNKS = LINES + ", c AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS index, l_partkey % 2 = 0 AS done, CASE WHEN l_partkey % 3 > 0 THEN l_discount END AS jod, CASE WHEN l_partkey % 5 = 0 THEN l_tax END AS measured, l_partkey AS start_frame, l_partkey + l_linenumber AS end_frame FROM lines)"


def _work(spark, sf):
    c = F.col
    return _lines(spark, sf).select(
        "l_orderkey", c("l_linenumber").cast("long").alias("index"), (c("l_partkey") % 2 == 0).alias("done"), F.when(c("l_partkey") % 3 > 0, c("l_discount")).alias("jod"), F.when(c("l_partkey") % 5 == 0, c("l_tax")).alias("measured"),
        c("l_partkey").alias("start_frame"), (c("l_partkey") + c("l_linenumber")).alias("end_frame"),
    )


@query(f"""WITH {_CHUNKS} SELECT l_orderkey, index, CASE WHEN done THEN 'measure' ELSE 'encode' END AS task, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY NOT done, index) - 1 AS BIGINT) AS position FROM c WHERE NOT done OR (jod IS NOT NULL AND measured IS NULL)""")
def work_queue(spark, sf):
    return progress.work_queue(_work(spark, sf), ["l_orderkey"])


@query(f"""WITH {_CHUNKS} SELECT l_orderkey, count(*) AS total_chunks, CAST(sum(end_frame - start_frame + 1) AS BIGINT) AS total_frames, count(*) FILTER (done) AS resumed_chunks, CAST(coalesce(sum(end_frame - start_frame + 1) FILTER (done), 0) AS BIGINT) AS resumed_frames FROM c GROUP BY l_orderkey""")
def work_totals(spark, sf):
    return progress.totals(_work(spark, sf), ["l_orderkey"])


@query(f"""WITH {_CHUNKS}, t AS (SELECT l_orderkey, sum(end_frame - start_frame + 1) AS total, count(*) FILTER (done) AS rc, coalesce(sum(end_frame - start_frame + 1) FILTER (done), 0) AS rf FROM c GROUP BY l_orderkey),
o AS (SELECT l_orderkey, index, sum(end_frame - start_frame + 1) OVER w AS own, count(*) OVER w AS n, index * 10 AS elapsed FROM c WHERE NOT done WINDOW w AS (PARTITION BY l_orderkey ORDER BY index ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, index, CAST(n + rc AS BIGINT) AS n_chunks, CAST(own + rf AS BIGINT) AS n_frames, CAST((own + rf) * 100 // total AS BIGINT) AS pct, CASE WHEN total - own - rf > 0 THEN CAST(round((total - own - rf) * CAST(elapsed AS DOUBLE) / own) AS BIGINT) END AS left_s FROM o JOIN t USING (l_orderkey)""")
def work_progress(spark, sf):
    w = _work(spark, sf)
    finished = w.where("not done").select("l_orderkey", "index", F.expr("end_frame - start_frame + 1").alias("frames"), (F.col("index") * 10).alias("elapsed_s"))
    return progress.progress(finished, progress.totals(w, ["l_orderkey"]), ["l_orderkey"], ["index"])


@query(f"WITH {DONE} SELECT o_orderkey, d.frames, a.frames AS due, CASE WHEN d.frames = a.frames THEN 'ok' WHEN d.frames < a.frames THEN 'retry' ELSE 'error' END AS verdict FROM a LEFT JOIN d USING (o_orderkey)")
def frame_check(spark, sf):
    chunks, done = _chunks_done(spark, sf)
    return progress.frame_check(done.select("o_orderkey", "frames"), chunks.select("o_orderkey", "frames"), ["o_orderkey"])


@query("""WITH c AS (SELECT o_orderkey, CAST(o_orderkey % 70 AS DOUBLE) AS crf, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS jod, CASE WHEN o_orderkey % 8 = 1 THEN CAST(1 AS DOUBLE) END AS measured FROM orders WHERE o_orderkey % 3 > 0),
n AS (SELECT o_orderkey, CAST(33 AS DOUBLE) AS crf, CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderkey AS DOUBLE) END AS jod FROM orders WHERE o_orderkey % 5 = 0),
u AS (SELECT * FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT *, NULL FROM n)
SELECT o_orderkey, crf, jod, CASE WHEN jod IS NOT NULL AND o_orderkey % 6 = 1 THEN CAST(9.25 AS DOUBLE) ELSE measured END AS measured FROM u""")
def solution_records(spark, sf):
    o = F.col("o_orderkey")
    orders = _table(spark, sf, "orders")
    cache = orders.where(o % 3 > 0).select("o_orderkey", (o % 70).cast("double").alias("crf"), F.when(o % 4 > 0, F.col("o_totalprice").cast("double")).alias("jod"), F.when(o % 8 == 1, F.lit(1e0)).alias("measured"))
    new = orders.where(o % 5 == 0).select("o_orderkey", F.lit(33e0).alias("crf"), F.when(o % 10 > 0, o.cast("double")).otherwise(F.lit(float("nan"))).alias("jod"))
    scores = orders.where(o % 6 == 1).select("o_orderkey", F.lit(9.25).alias("score"))
    return progress.record_measured(progress.record_solution(cache, new, ["o_orderkey"]), scores, ["o_orderkey"])


@query("""SELECT o_orderkey, o_orderkey % 5 IN (1, 2) AS killed, o_orderkey % 5 IN (1, 2) OR o_orderkey % 7 IN (0, 3) AS transient, o_orderkey % 6 IN (1, 3) AS chain_transient,
  CASE o_orderkey % 6 WHEN 0 THEN 'probe: parse' WHEN 1 THEN 'probe: x' WHEN 2 THEN 'probe: parse' WHEN 3 THEN 'probe: disk' ELSE 'probe: parse' END AS text,
  CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 3 > 0 OR o_orderkey % 11 = 0) THEN 'encoder' WHEN o_orderkey % 3 = 0 THEN 'writer' WHEN o_orderkey % 2 = 0 THEN 'encoder' END AS blamed FROM orders""")
def failure_kinds(spark, sf):
    o = F.col("o_orderkey")
    signal = F.get(F.array(F.lit(None).cast("int"), F.lit(9), F.lit(15), F.lit(11), F.lit(6)), (o % 5).cast("int"))
    message = F.when(o % 7 == 0, "x: No space left to write").when(o % 7 == 3, "EDQUOT").otherwise("odd")
    link = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text"))
    chain = F.when(o % 6 == 1, F.array(link("Transient", "will clear"), link("Other", "probe"), link("Other", "x"))).when(o % 6 == 3, F.array(link("Other", "probe"), link("StorageFull", "disk"))).otherwise(F.array(link("Other", "probe"), link("NotFound", "parse")))
    e = progress.tool_error(signal, message)
    return _table(spark, sf, "orders").select("o_orderkey", e["killed"].alias("killed"), e["transient"].alias("transient"), progress.is_transient(chain).alias("chain_transient"), progress.chain_text(chain).alias("text"), progress.blamed_stage(o % 3 == 0, o % 11 == 0, o % 2 == 0).alias("blamed"))


@query("""WITH s AS (SELECT o_orderkey, '/in/' || o_custkey || '.mkv' AS path, CAST(o_orderkey % 100 AS BIGINT) AS size FROM orders), r AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN path || chr(10) || size WHEN 1 THEN path || chr(10) || (size + 1) WHEN 2 THEN '  ' END AS id FROM s)
SELECT o_orderkey, path, size, coalesce(o_orderkey % 4 = 1, false) AS wipe, o_orderkey % 4 > 0 AS record FROM r""")
def claimed_sources(spark, sf):
    o = F.col("o_orderkey")
    s = _table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("/in/"), F.col("o_custkey").cast("string"), F.lit(".mkv")).alias("path"), (o % 100).alias("size"))
    own = progress.source_id(F.col("path"), F.col("size"))
    recorded = s.where(o % 4 < 3).select("o_orderkey", F.when(o % 4 == 0, own).when(o % 4 == 1, progress.source_id(F.col("path"), F.col("size") + 1)).otherwise("  ").alias("id"))
    return progress.claimed(s, recorded, ["o_orderkey"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'view' AS returned, event_type = 'click' AS stop, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w AS (SELECT user_id, event_id, k, CAST(0 AS BIGINT) AS before, returned, stop FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN w.before >= 3 OR w.returned THEN 0 WHEN w.stop THEN w.before ELSE w.before + 1 END, e.returned, e.stop FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id, before, before >= 3 AS locked FROM w""")
def crash_attempts(spark, sf):
    kind = F.col("event_type")
    return progress.attempts(_table(spark, sf, "events").select("user_id", "event_id", (kind == "view").alias("returned"), (kind == "click").alias("stop_requested")), ["user_id"], "event_id")


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 7 ELSE user_id % 2 END AS size, 1 AS mtime, row_number() OVER w AS r, lag(CASE WHEN event_type IN ('view', 'click') THEN 7 ELSE user_id % 2 END) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT *, CASE WHEN size = p AND size > 0 THEN 1 ELSE 0 END AS same FROM s), g AS (SELECT *, same + coalesce(lag(same) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS held FROM h)
SELECT user_id, CAST(min(r - 1) FILTER (held = 2 AND r <= 101) AS BIGINT) AS n FROM g GROUP BY user_id""")
def stable_files(spark, sf):
    size = F.when(F.col("event_type").isin("view", "click"), 7).otherwise(F.col("user_id") % 2)
    return progress.stable(_table(spark, sf, "events").select("user_id", "event_id", size.alias("size"), F.lit(1).alias("mtime")), ["user_id"], ["event_id"])


@query("""WITH f AS (SELECT o_custkey, o_orderkey, 'f' || o_orderkey % 2 AS stem, 'mkv' AS ext FROM orders), t AS (SELECT DISTINCT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'f0.mkv' WHEN 1 THEN 'f1.2.mkv' ELSE 'x' END AS name FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, stem ORDER BY o_orderkey) AS k FROM f), g AS (SELECT n AS i FROM generate_series(1, 60) s(n)),
c AS (SELECT DISTINCT o_custkey, stem, i, CASE WHEN i = 1 THEN stem || '.mkv' ELSE stem || '.' || i || '.mkv' END AS name FROM f, g),
free AS (SELECT c.*, row_number() OVER (PARTITION BY c.o_custkey, stem ORDER BY i) AS k FROM c LEFT JOIN t ON t.o_custkey = c.o_custkey AND t.name = c.name WHERE t.name IS NULL)
SELECT n.o_custkey, n.o_orderkey, n.stem, n.ext, free.name AS archived FROM n LEFT JOIN free ON free.o_custkey = n.o_custkey AND free.stem = n.stem AND free.k = n.k""")
def archive_names(spark, sf):
    o = F.col("o_orderkey")
    orders = _table(spark, sf, "orders")
    files = orders.select("o_custkey", "o_orderkey", F.concat(F.lit("f"), (o % 2).cast("string")).alias("stem"), F.lit("mkv").alias("ext"))
    taken = orders.select("o_custkey", F.when(o % 3 == 0, "f0.mkv").when(o % 3 == 1, "f1.2.mkv").otherwise("x").alias("name"))
    return progress.archive_names(files, taken, ["o_custkey"], ["o_orderkey"])


@query("""SELECT event_id, event_type || user_id % 10 AS message, CASE WHEN row_number() OVER (PARTITION BY event_type || user_id % 10 ORDER BY ts, event_id) = 1 THEN 'warn' ELSE 'debug' END AS level FROM events""")
def first_warnings(spark, sf):
    m = _table(spark, sf, "events").select("event_id", "ts", F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("message"))
    return progress.first_warnings(m, ["ts", "event_id"]).select("event_id", "message", "level")


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS id, c_custkey % 3 > 0 AS hardware, c_acctbal > 0 AS passes, c_nationkey FROM customer)
SELECT c_nationkey, min(id) FILTER (hardware AND passes) AS id, CASE WHEN min(id) FILTER (hardware AND passes) IS NULL THEN CASE WHEN count(id) = 0 THEN 'missing' WHEN count(*) FILTER (hardware AND id IS NOT NULL) = 0 THEN 'software' ELSE 'unfit' END END AS reason FROM d GROUP BY c_nationkey""")
def first_device(spark, sf):
    k = F.col("c_custkey")
    return progress.first_device(_table(spark, sf, "customer").select("c_nationkey", F.when(k % 5 > 0, k).alias("id"), (k % 3 > 0).alias("hardware"), (F.col("c_acctbal") > 0).alias("passes")), ["c_nationkey"])


@query("""WITH f AS (SELECT DISTINCT 'a' || user_id % 30 || '/b' || user_id % 7 || '/c' || user_id AS folder FROM events), x AS (SELECT folder FROM f WHERE substr(folder, 2, 1) <> '1'),
a AS (SELECT DISTINCT string_split(folder, '/') AS p FROM f), l AS (SELECT DISTINCT string_split(folder, '/') AS p FROM x),
every AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS folder FROM a, generate_series(1, 3) g(n)), live AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS folder FROM l, generate_series(1, 3) g(n))
SELECT folder FROM every WHERE folder NOT IN (SELECT folder FROM live)""")
def emptied_folders(spark, sf):
    u = F.col("user_id").cast("string")
    parts = [F.concat(F.lit("a"), (F.col("user_id") % 30).cast("string")), F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string")), F.concat(F.lit("c"), u)]
    every = _table(spark, sf, "events").select(F.explode(F.array(*[F.concat_ws("/", *parts[: n + 1]) for n in range(3)])).alias("folder")).distinct()
    files = _table(spark, sf, "events").select(F.concat_ws("/", *parts).alias("folder")).where(F.substring("folder", 2, 1) != "1")
    return progress.emptied_folders(every, files)
