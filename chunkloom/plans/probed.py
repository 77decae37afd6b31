"""Captured reports: made of the tables the driver supplies, read back, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogued import _table, query
from .decided import LINES, _lines
from chunkloom.operators import catalog
from chunkloom.sources import probes, reports


def _gathered(df, keys, order, item, name):
    """A JSON report of a few dozen entries for each key."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))).alias("l"))
    return rows.select(*keys, F.to_json(F.struct(F.transform("l", lambda e: e["x"]).alias(name))).alias("report"))


@query(f"""WITH {LINES} SELECT l_orderkey, l_linenumber - 1 AS ordinal, CASE WHEN l_partkey % 9 > 0 THEN l_suppkey END AS pts, l_partkey AS dts, CAST(floor(l_extendedprice) AS BIGINT) AS size, CASE WHEN l_partkey % 4 = 0 THEN 'KD' ELSE '' END AS flags FROM lines""")
def packet_report(spark, sf):
    c = F.col
    item = F.struct(F.when(c("l_partkey") % 9 > 0, c("l_suppkey")).alias("pts"), c("l_partkey").alias("dts"), F.floor("l_extendedprice").cast("string").alias("size"), F.when(c("l_partkey") % 4 == 0, "KD").alias("flags"))
    return probes.packets(_gathered(_lines(spark, sf), ["l_orderkey"], "l_linenumber", item, "packets"), ["l_orderkey"])


@query(f"""WITH {LINES} SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ordinal, l_partkey AS track, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber END AS number, 'l' || l_suppkey % 5 AS legacy, CASE WHEN l_suppkey % 2 = 0 THEN 'i' || l_suppkey % 7 END AS ietf FROM lines WHERE l_returnflag = 'N'""")
def identified_tracks(spark, sf):
    c = F.col
    own = F.struct(F.when(c("l_suppkey") % 3 > 0, c("l_linenumber")).alias("number"), F.concat(F.lit("l"), (c("l_suppkey") % 5).cast("string")).alias("language"), F.when(c("l_suppkey") % 2 == 0, F.concat(F.lit("i"), (c("l_suppkey") % 7).cast("string"))).alias("language_ietf"))
    item = F.struct(c("l_partkey").alias("id"), F.when(c("l_returnflag") == "N", "subtitles").otherwise("audio").alias("type"), own.alias("properties"))
    return probes.identified_tracks(_gathered(_lines(spark, sf), ["l_orderkey"], "l_linenumber", item, "tracks"), ["l_orderkey"], "subtitles")


@query(f"""WITH {LINES} SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ordinal, 'c' || l_partkey % 9 AS codec_name, CASE WHEN l_suppkey % 2 = 0 THEN 'eng' END AS language, CASE WHEN l_partkey % 3 = 0 THEN 17 WHEN l_partkey % 3 = 1 THEN NULL ELSE 255 END AS number FROM lines WHERE l_returnflag = 'A'""")
def subtitle_streams(spark, sf):
    c = F.col
    item = F.struct(
        c("l_linenumber").alias("index"), F.when(c("l_returnflag") == "A", "subtitle").otherwise("video").alias("codec_type"), F.concat(F.lit("c"), (c("l_partkey") % 9).cast("string")).alias("codec_name"),
        F.when(c("l_partkey") % 3 == 0, "0x11").when(c("l_partkey") % 3 == 1, "none").otherwise("0xFf").alias("id"), F.struct(F.when(c("l_suppkey") % 2 == 0, "eng").alias("language")).alias("tags"), F.lit(1).alias("odd"),
    )
    rows = reports.streams(_gathered(_lines(spark, sf), ["l_orderkey"], "l_linenumber", item, "streams"), ["l_orderkey"], "subtitle")
    return rows.select("l_orderkey", c("ordinal").cast("long").alias("ordinal"), "codec_name", c("tags")["language"].alias("language"), probes.stream_number(c("id")).alias("number"))


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS nominal, CAST(o_orderkey % 500 AS DOUBLE) / 1000 AS c, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 700 AS DOUBLE) / 1000 END AS v, o_orderkey % 2 = 0 AS mkv, o_custkey % 5 AS sar, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 9 ELSE 0 END AS top FROM orders)
SELECT o_orderkey, CAST(CASE WHEN nominal THEN 25 ELSE 24000 END AS INTEGER) AS num, CAST(CASE WHEN nominal THEN 1 ELSE 1001 END AS INTEGER) AS den, greatest(CAST(round(coalesce(v, c) * 1000) - round(c * 1000) AS BIGINT), 0) AS offset_ms, CASE WHEN mkv THEN CAST(round(c * 1000) AS BIGINT) ELSE 0 END AS container_start_ms,
  CASE WHEN sar > 0 THEN CAST(sar AS INTEGER) END AS sar_num, CASE WHEN sar > 0 THEN 9 END AS sar_den, top, CASE WHEN top > 0 THEN (1080 - top - 0 - (top % 2)) - (1080 - top - (top % 2)) % 2 ELSE 1080 END AS vis_h FROM s""")
def video_report(spark, sf):
    c, o = F.col, F.col("o_orderkey")
    cut = F.when(c("o_custkey") % 3 == 0, F.array(F.struct((o % 9).alias("crop_top"), F.lit(0).alias("crop_bottom"), F.lit(0).alias("crop_left"))))
    v = F.struct(
        F.when(o % 3 == 0, "0/0").otherwise("24000/1001").alias("avg_frame_rate"), F.lit("25/1").alias("r_frame_rate"), F.when(o % 4 > 0, (o % 700 / 1000).cast("string")).alias("start_time"),
        F.when(c("o_custkey") % 5 > 0, F.concat((c("o_custkey") % 5).cast("string"), F.lit(":9"))).otherwise("N/A").alias("sample_aspect_ratio"), cut.alias("side_data_list"),
    )
    form = F.struct(F.when(o % 2 == 0, "matroska,webm").otherwise("mov").alias("format_name"), (o % 500 / 1000).cast("string").alias("start_time"))
    report = F.to_json(F.struct(F.array(v).alias("streams"), form.alias("format"))).alias("report")
    rows = probes.visible_pictures(probes.video_streams(_table(spark, sf, "orders").select("o_orderkey", report), ["o_orderkey"]), F.lit(1920), F.lit(1080))
    return rows.select("o_orderkey", "fps.num", "fps.den", "offset_ms", "container_start_ms", "sar_num", "sar_den", "top", F.col("visible.h").alias("vis_h"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
l AS (SELECT user_id, max(event_id) FILTER (event_type = 'click') AS c, max(event_id) FILTER (event_type = 'view') AS v FROM events GROUP BY user_id)
SELECT user_id, c % 90 AS tff, c % 70 AS bff, c % 50 AS progressive, CAST(v % 1000 AS INTEGER) AS w, CAST(v % 500 AS INTEGER) AS h FROM l WHERE c IS NOT NULL AND v IS NOT NULL""")
def measurement_logs(spark, sf):
    k = F.col("event_id")
    num = lambda x: x.cast("string")
    idet = F.concat(F.lit("[x] Multi frame detection: TFF:  "), num(k % 90), F.lit(" BFF: "), num(k % 70), F.lit(" Progressive:   "), num(k % 50), F.lit(" Undetermined: 3"))
    crop = F.concat(F.lit("[y] x1:0 crop="), num(k % 1000), F.lit(":"), num(k % 500), F.lit(":0:2"))
    line = F.when(F.col("event_type") == "click", idet).when(F.col("event_type") == "view", crop).otherwise("other")
    lines = _table(spark, sf, "events").select("user_id", k.alias("line_no"), line.alias("line"))
    return reports.field_votes(lines, ["user_id"]).join(reports.crop_boxes(lines, ["user_id"]).select("user_id", "w", "h"), "user_id")


@query("""SELECT p_partkey, p_retailprice AS score, CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS DOUBLE) END AS banding, CAST(p_partkey % 7 AS INTEGER) AS frame, p_size % 3 > 0 AS chapters FROM part""")
def score_reports(spark, sf):
    c = F.col
    size = c("p_size").cast("double")
    plain = F.map_from_arrays(F.array(F.lit("cambi"), F.lit("cambi_source"), F.lit("psnr")), F.array(size, F.lit(1e0), F.lit(2e0)))
    two = F.map_from_arrays(F.array(F.lit("cambi"), F.lit("cambi_x")), F.array(size, size))
    frames = F.to_json(F.struct(F.array(F.struct((c("p_partkey") % 7).alias("frameNum"), F.when(c("p_size") % 4 > 0, plain).otherwise(two).alias("metrics"))).alias("frames")))
    rows = _table(spark, sf, "part").select("p_partkey", frames.alias("report"), F.to_json(F.array(F.array(F.lit(1e0)), F.array(F.lit(2e0), c("p_retailprice")))).alias("scores"), F.to_json(F.struct(F.when(c("p_size") % 3 > 0, F.array(F.lit("c"))).alias("chapters"))).alias("chapters"))
    score = rows.select("p_partkey", reports.last_score(c("scores")).alias("score"), probes.has_chapters(c("chapters")).alias("chapters"))
    return score.join(reports.banding(rows, ["p_partkey"]).select("p_partkey", "frame", c("score").alias("banding")), "p_partkey")


@query("""WITH f AS (SELECT 'p' || c_custkey % 40 AS profile, c_custkey FROM customer)
SELECT profile, bool_or(c_custkey % 9 = 0) AS usable, CASE WHEN NOT bool_or(c_custkey % 9 = 0) AND bool_or(c_custkey % 9 IN (1, 2) AND c_custkey % 5 > 0) THEN 'videos without settings' END AS reason, bool_or(c_custkey % 9 IN (1, 2) AND c_custkey % 5 > 0) AS holds_video FROM f GROUP BY profile""")
def profile_folders(spark, sf):
    k = F.col("c_custkey")
    profile = F.concat(F.lit("p"), (k % 40).cast("string"))
    files = _table(spark, sf, "customer").select(
        F.when(k % 9 == 2, F.concat(profile, F.lit("/deep"))).otherwise(profile).alias("rel_dir"), F.when(k % 9 == 0, "settings").otherwise(F.concat(F.lit("f"), k.cast("string"))).alias("stem"),
        F.when(k % 9 == 0, "toml").when(k % 9 < 3, "MKV").otherwise("txt").alias("ext"), F.when(k % 9 == 0, 1).otherwise(k % 5).alias("size"),
    )
    other = spark.createDataFrame([("processed/x", "a", "mkv", 5)], "rel_dir string, stem string, ext string, size long")
    return catalog.profile_folders(files.unionByName(other), "settings.toml")
