"""Scalar rules, interval edits and lookups on the tables the driver supplies, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogued import SCENES, _frames, _scenes, _table, query
from .decided import LINES, _lines
from chunkloom.functions import color, media
from chunkloom.operators import catalog, intervals, matching, metrics, rules, search, state, timeline, tracks
from chunkloom.sources import reports


def _pick(values, i):
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


@query("""WITH j AS (SELECT o_orderkey FROM orders), d AS (SELECT o_orderkey, o_custkey % 3 AS size, CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN false END AS delivered FROM orders WHERE o_orderkey % 2 = 0)
SELECT j.o_orderkey, coalesce(delivered, false) AS awaits_archiving FROM j LEFT JOIN d ON d.o_orderkey = j.o_orderkey AND size > 0 WHERE d.o_orderkey IS NULL OR coalesce(delivered, false)""")
def jobs_without_output(spark, sf):
    o, orders = F.col("o_orderkey"), _table(spark, sf, "orders")
    done = orders.where(o % 2 == 0).select("o_orderkey", (F.col("o_custkey") % 3).alias("size"), F.when(o % 4 == 0, True).when(o % 4 == 1, False).alias("delivered"))
    return catalog.open_jobs(orders.select("o_orderkey"), done, ["o_orderkey"])


@query("""WITH t AS (SELECT o_orderkey, ['dts', 'pcm_s24le', 'flac', 'aac', 'truehd'][o_orderkey % 5 + 1] AS codec, CASE o_orderkey % 3 WHEN 0 THEN 'DTS-HD MA' WHEN 1 THEN 'DTS' END AS profile FROM orders)
SELECT o_orderkey, CASE WHEN codec = 'dts' THEN coalesce(profile LIKE '%MA%', false) ELSE codec IN ('pcm_s24le', 'flac', 'truehd') END AS lossless, codec IN ('pcm_s24le', 'flac', 'truehd') AS out_lossless,
  CASE codec WHEN 'flac' THEN 'FLAC' WHEN 'aac' THEN 'AAC' ELSE codec END AS shown FROM t""")
def lossless_codecs(spark, sf):
    o = F.col("o_orderkey")
    codec, profile = _pick(("dts", "pcm_s24le", "flac", "aac", "truehd"), o % 5), F.when(o % 3 == 0, "DTS-HD MA").when(o % 3 == 1, "DTS")
    return _table(spark, sf, "orders").select("o_orderkey", rules.is_lossless(codec, profile, ["flac", "truehd"]).alias("lossless"), media.output_is_lossless(codec).alias("out_lossless"), tracks.display_name(codec).alias("shown"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS w, l_suppkey % 60 AS h, l_partkey % 7 AS x, l_linenumber AS y FROM lineitem), e AS (SELECT *, w - w % 2 AS ew, h - h % 2 AS eh, x - x % 2 AS ex, y - y % 2 AS ey FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN ew > 0 AND eh > 0 AND ex + ew <= 48 AND ey + eh <= 56 THEN 'crop=' || ew || ':' || eh || ':' || ex || ':' || ey END AS crop FROM e""")
def normalized_crop(spark, sf):
    from chunkloom.functions import geometry

    c = F.col
    r = color.normalized_crop(c("l_partkey") % 50, c("l_suppkey") % 60, c("l_partkey") % 7, c("l_linenumber"), F.lit(48), F.lit(56))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", geometry.format_rectangle(r).alias("crop"))


_FOLD_ROWS = [(c, i, t) for c, ts in tracks.FOLDS.items() for i, t in enumerate(ts)]


@query(f"""WITH f(channel, choice, targets) AS (VALUES {", ".join(f"('{c}', {i}, string_split('{t}', '+'))" for c, i, t in _FOLD_ROWS)}),
n AS (SELECT unnest(['FL', 'FR', 'FC', 'LFE', 'BL', 'BR', 'SL', 'SR', 'BC', 'TBL', 'TBC', 'TC', 'WL']) AS channel, unnest(range(13)) AS seq),
s AS (SELECT p_partkey AS id, seq, channel FROM part, n WHERE (p_partkey * 7919 // (1 << seq)) % 2 = 1), h AS (SELECT id, list(channel) AS have FROM s GROUP BY id),
o AS (SELECT s.id, seq, s.channel, arg_min(targets, choice) FILTER (len(list_filter(targets, lambda x: NOT list_contains(have, x))) = 0) AS t FROM s JOIN h USING (id) LEFT JOIN f ON f.channel = s.channel GROUP BY s.id, seq, s.channel),
e AS (SELECT id, seq, channel, unnest(coalesce(t, [channel])) AS destination FROM o)
SELECT id, destination, array_to_string(list(channel ORDER BY seq), '+') AS contributors FROM e GROUP BY id, destination""")
def channel_folds(spark, sf):
    names = ("FL", "FR", "FC", "LFE", "BL", "BR", "SL", "SR", "BC", "TBL", "TBC", "TC", "WL")
    have = F.array_compact(F.array(*[F.when(F.shiftright(F.col("p_partkey") * 7919, i) % 2 == 1, F.struct(F.lit(i).alias("seq"), F.lit(n).alias("channel"))) for i, n in enumerate(names)]))
    s = _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(have).alias("c")).select("id", "c.seq", "c.channel")
    folds = spark.createDataFrame([(c, i, t.split("+")) for c, i, t in _FOLD_ROWS], "channel string, choice int, targets array<string>")
    return matching.folded(s, folds).select("id", "destination", F.array_join("contributors", "+").alias("contributors"))


@query("""SELECT p_partkey, concat_ws(' ', '--alpha ' || p_size, CASE WHEN p_size % 2 = 0 THEN '--beta 1' ELSE '--beta 0' END, '--crf 30') AS args, CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END AS flag, lpad(CAST(p_partkey + 1 AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey + 1 AS VARCHAR))) AS INTEGER), '0') AS key,
  greatest(1, CAST(round((p_size - 3) * 5.0) AS BIGINT)) AS keyint, CASE WHEN p_size * 20 > 240 THEN CAST(ceil(p_size * 20 / 240.0) AS BIGINT) ELSE 1 END AS divisor, CAST(60 + p_partkey * 100000 // 10000000 AS BIGINT) AS timeout,
  least(greatest(round(p_size * 1.13 * 4) / 4, CAST(8 AS DOUBLE)), CAST(50 AS DOUBLE)) AS grid FROM part""")
def encoder_numbers(spark, sf):
    c = F.col
    n = c("p_size").cast("string")
    params = F.create_map(F.lit("beta"), rules.scalar_text(F.lit("bool"), F.when(c("p_size") % 2 == 0, "true").otherwise("false")), F.lit("gone"), F.lit("x"), F.lit("alpha"), n)
    args = rules.flag_list(rules.set_flag(rules.without_flag(params, "gone"), "crf", F.lit("30")))
    return _table(spark, sf, "part").select(
        "p_partkey", F.array_join(args, " ").alias("args"), rules.scalar_text(F.lit("bool"), F.when(c("p_size") % 2 == 0, "true").otherwise("false")).alias("flag"), state.padded_key(c("p_partkey")).alias("key"),
        color.key_interval((c("p_size") - 3).cast("double")).alias("keyint"), color.rate_divisor((c("p_size") * 20).cast("double"), F.lit(240)).alias("divisor"), media.whole_file_timeout(c("p_partkey") * 100_000, 60).alias("timeout"),
        search.to_grid(c("p_size") * F.lit(1.13), 8.0, 50.0).alias("grid"),
    )


@query("""WITH s AS (SELECT o_orderkey, ['24000/1001', '25', '0/0', '30/0', 'x'][o_orderkey % 5 + 1] AS a, ['50/1', '0/1', '12'][o_orderkey % 3 + 1] AS b FROM orders),
n AS (SELECT *, CASE a WHEN '24000/1001' THEN 24000 WHEN '25' THEN 25 END AS an, CASE a WHEN '24000/1001' THEN 1001 WHEN '25' THEN 1 END AS ad, CASE b WHEN '50/1' THEN 50 WHEN '12' THEN 12 END AS bn, CASE b WHEN '50/1' THEN 1 WHEN '12' THEN 1 END AS bd FROM s)
SELECT o_orderkey, CAST(coalesce(an, bn) AS INTEGER) AS num, CAST(CASE WHEN an IS NOT NULL THEN ad ELSE bd END AS INTEGER) AS den, CASE a WHEN '24000/1001' THEN CAST(24000 AS DOUBLE) / 1001 WHEN '25' THEN CAST(25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value FROM n""")
def frame_rates(spark, sf):
    o = F.col("o_orderkey")
    a, b = _pick(("24000/1001", "25", "0/0", "30/0", "x"), o % 5), _pick(("50/1", "0/1", "12"), o % 3)
    return _table(spark, sf, "orders").select("o_orderkey", reports.frame_rate(a, b).alias("r"), reports.number(a).alias("value")).select("o_orderkey", "r.num", "r.den", "value")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN 'dolby_vision' WHEN l_suppkey % 7 = 0 THEN 'hdr10plus' WHEN l_linenumber % 4 = 0 THEN 'pq' WHEN l_linenumber % 4 = 1 THEN 'hlg' ELSE 'sdr' END AS kind,
  CASE WHEN l_linenumber % 4 <> 0 THEN 0 ELSE CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END END AS lacks,
  CASE l_linenumber % 4 WHEN 0 THEN 16 WHEN 1 THEN 18 WHEN 2 THEN 1 END AS transfer, CASE l_partkey % 3 WHEN 0 THEN 'bt709' WHEN 1 THEN 'bt2020' END AS known FROM lineitem""")
def hdr_kinds(spark, sf):
    c = F.col
    transfer = _pick(("smpte2084", "arib-std-b67", "bt709", "odd"), c("l_linenumber") % 4)
    lacks = color.missing_static(transfer, F.when(c("l_partkey") % 2 != 0, "x"), F.when(c("l_suppkey") % 2 != 0, "x"))
    known = color.known(F.when(c("l_partkey") % 3 == 0, "bt709").when(c("l_partkey") % 3 == 1, "unknown"), F.when(c("l_partkey") % 3 == 1, "bt2020").when(c("l_partkey") % 3 == 2, "unknown").otherwise("film"))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", color.hdr_kind(c("l_partkey") % 9 == 0, c("l_suppkey") % 7 == 0, transfer).alias("kind"), F.size(lacks).alias("lacks"), color.code(transfer, color.TRANSFER).alias("transfer"), known.alias("known"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS l, l_suppkey % 50 AS r, l_partkey % 200 AS t, l_suppkey % 170 AS b, CASE WHEN l_linenumber % 2 = 0 THEN 140 ELSE 0 END AS cy, CASE WHEN l_linenumber % 2 = 0 THEN 800 ELSE 1080 END AS ch FROM lineitem),
f AS (SELECT *, least(greatest(l, 0), 1920) AS kl, least(greatest(r, 0), 1920) AS kr, least(greatest(t - cy, 0), ch) AS kt, least(greatest(b - (1080 - cy - ch), 0), ch) AS kb FROM s),
o AS (SELECT *, CAST((kl * 960 + 960) // 1920 AS INTEGER) AS ol, CAST((kr * 960 + 960) // 1920 AS INTEGER) AS orr, CAST((kt * (ch // 2) + ch // 2) // ch AS INTEGER) AS ot, CAST((kb * (ch // 2) + ch // 2) // ch AS INTEGER) AS ob FROM f)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN orr ELSE ol END AS left_, CASE WHEN l_linenumber % 3 = 0 THEN ol ELSE orr END AS right_, CASE WHEN l_linenumber % 3 = 1 THEN ob ELSE ot END AS top_, CASE WHEN l_linenumber % 3 = 1 THEN ot ELSE ob END AS bottom_ FROM o""")
def active_area(spark, sf):
    c = F.col
    cropped = c("l_linenumber") % 2 == 0
    offsets = F.struct((c("l_partkey") % 40).alias("left"), (c("l_suppkey") % 50).alias("right"), (c("l_partkey") % 200).alias("top"), (c("l_suppkey") % 170).alias("bottom"))
    crop = F.when(cropped, F.struct(F.lit(0).alias("x"), F.lit(140).alias("y"), F.lit(1920).alias("w"), F.lit(800).alias("h")))
    scale = F.struct(F.lit(960).alias("w"), F.when(cropped, 400).otherwise(540).alias("h"))
    a = media.active_area(offsets, F.struct(F.lit(1920).alias("w"), F.lit(1080).alias("h")), crop, scale, _pick(("horizontal", "vertical", "none"), c("l_linenumber") % 3))
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"))
    return rows.select("l_orderkey", "l_linenumber", *[c(f"a.{side}").alias(f"{side}_") for side in ("left", "right", "top", "bottom")])


@query(f"""WITH {SCENES}, k AS (SELECT s.*, total - 7 AS cut FROM scenes s JOIN totals USING (user_id)), i AS (SELECT * FROM k WHERE start_frame < cut),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY index DESC) = 1 AS last FROM i)
SELECT user_id, index, start_frame, CASE WHEN last THEN cut - 1 ELSE least(end_frame, cut - 1) END AS end_frame FROM e""")
def clamped_scenes(spark, sf):
    frames = _frames(spark, sf)
    totals = frames.groupBy("user_id").agg((F.count("*") - 7).alias("total"))
    return intervals.clamped(_scenes(frames), totals, ["user_id"]).select("user_id", "index", "start_frame", "end_frame")


@query(f"WITH {SCENES} SELECT user_id, index, CASE WHEN index > 0 THEN start_frame + 3 ELSE start_frame END AS start_frame, end_frame + 3 AS end_frame FROM scenes")
def shifted_scenes(spark, sf):
    return intervals.shifted(_scenes(_frames(spark, sf)), 3).select("user_id", "index", "start_frame", "end_frame")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 300 WHEN o_custkey % 4 = 1 THEN greatest(24, CAST(round((o_orderkey % 9 + 1) * CAST(23.976 AS DOUBLE)) AS BIGINT)) END AS most,
  array_to_string([CAST(floor(o_orderkey * 5 / 100.0) AS BIGINT), CAST(floor(o_orderkey * 50 / 100.0) AS BIGINT), CAST(floor(o_orderkey * 95 / 100.0) AS BIGINT)], ',') AS places FROM orders""")
def sampling_positions(spark, sf):
    c = F.col
    most = intervals.effective_most(F.when(c("o_custkey") % 4 == 0, 300), F.when(c("o_custkey") % 4 == 1, c("o_orderkey") % 9 + 1), F.lit(23.976))
    return _table(spark, sf, "orders").select("o_orderkey", most.alias("most"), F.array_join(F.transform(intervals.sample_positions(c("o_orderkey"), [5, 50, 95]), lambda x: x.cast("string")), ",").alias("places"))


@query("""WITH g AS (SELECT o_orderkey, o_orderkey % 9 - o_custkey % 7 AS gap FROM orders)
SELECT o_orderkey, CASE WHEN abs(gap) <= 1 THEN 0 ELSE gap END AS shift, greatest(0, -CASE WHEN abs(gap) <= 1 THEN 0 ELSE gap END) AS lead, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 > 0 THEN (o_orderkey % 9 - o_orderkey % 4 - 1) * 1000 ELSE 0 END AS extracted,
  CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE o_orderkey % 7 = 0 END AS interlaced, o_orderkey % 4 >= 2 AS failed FROM g""")
def time_shifts(spark, sf):
    o = F.col("o_orderkey")
    r = timeline.realignment(o % 9, F.col("o_custkey") % 7)
    cut = media.extraction_shift_ms(F.when(o % 3 == 0, "mpegts").otherwise("mov"), (o % 9).cast("double"), F.when(o % 5 > 0, (o % 4).cast("double")), F.lit(1e0))
    flag = media.interlaced_flag(F.when(o % 4 == 0, "tt").when(o % 4 == 1, "progressive").when(o % 4 == 2, "unknown"), o % 7 == 0)
    return _table(spark, sf, "orders").select("o_orderkey", r["shift"].alias("shift"), r["lead"].alias("lead"), cut.alias("extracted"), flag.alias("interlaced"), media.tool_failed(F.when(o % 4 != 3, (o % 4).cast("int"))).alias("failed"))


@query(f"""WITH {LINES} SELECT l_orderkey, min(CASE WHEN l_partkey % 2 = 0 THEN l_tax ELSE l_discount END) AS lowest, count(CASE WHEN l_partkey % 7 > 0 THEN 1 END) IN (0, count(*)) AS usable,
  count(*) / nullif(CAST(sum(l_linenumber) - 6 AS DOUBLE), 0) AS fps FROM lines GROUP BY l_orderkey""")
def chunk_scores(spark, sf):
    c, li = F.col, _lines(spark, sf)
    low = metrics.lowest_score(li.select("l_orderkey", F.when(c("l_partkey") % 2 == 0, c("l_tax")).alias("measured"), c("l_discount").alias("jod")), ["l_orderkey"])
    known = timeline.presentation_order_known(li.select("l_orderkey", F.when(c("l_partkey") % 7 > 0, 1).alias("pts")), ["l_orderkey"])
    speed = li.groupBy("l_orderkey").agg(metrics.throughput(F.count("*"), F.sum("l_linenumber") - 6).alias("fps"))
    return low.join(known, "l_orderkey").join(speed, "l_orderkey")


@query("""WITH s AS (SELECT DISTINCT user_id, event_id // 40 AS ordinal, user_id % 3 AS id FROM events), t AS (SELECT DISTINCT user_id, event_id // 40 AS ordinal, event_id % 50 AS number FROM events),
m AS (SELECT s.user_id, s.ordinal, t.number FROM s JOIN t ON s.user_id = t.user_id AND s.id = t.number)
SELECT user_id, ordinal, min(number) AS number FROM m GROUP BY user_id, ordinal HAVING count(*) = 1""")
def single_twins(spark, sf):
    e = _table(spark, sf, "events")
    s = e.select("user_id", F.expr("event_id div 40").alias("ordinal"), (F.col("user_id") % 3).alias("id")).distinct()
    t = e.select("user_id", F.expr("event_id div 40").alias("ordinal"), (F.col("event_id") % 50).alias("number")).distinct()
    return matching.exactly_one(matching.twins(s, t, ["user_id"]), ["user_id"]).select("user_id", "ordinal", "number")


@query("""WITH n AS (SELECT c_custkey, c_name || '.' || ['mkv', 'MP4', 'txt', 'm2ts', ''][c_custkey % 5 + 1] AS name FROM customer)
SELECT c_custkey, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_extract(name, '\\.([^.]*)$', 1) AS ext, lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ('mkv', 'mp4', 'm2ts') AS accepted,
  CASE WHEN c_custkey % 3 = 0 THEN 'retry' WHEN c_custkey % 7 = 0 THEN 'retry' ELSE 'failed' END AS route, c_custkey % 4 <> 1 OR c_custkey % 6 > 2 AS due FROM n""")
def job_names(spark, sf):
    k = F.col("c_custkey")
    name = F.concat(F.col("c_name"), F.lit("."), _pick(("mkv", "MP4", "txt", "m2ts", ""), k % 5))
    due = state.is_due(F.lit(10), F.when(k % 4 == 0, 10).when(k % 4 == 1, 11).when(k % 4 == 2, 9), F.lit("p"), F.when(k % 6 > 2, "q").otherwise("p"))
    return _table(spark, sf, "customer").select("c_custkey", catalog.stem(name).alias("stem"), catalog.extension(name).alias("ext"), F.lower(catalog.extension(name)).isin(*catalog.EXTENSIONS).alias("accepted"), state.route(k % 3 == 0, F.lit(False), k % 7 == 0, F.lit(True)).alias("route"), due.alias("due"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN (l_suppkey % 2 = 0) AND (l_linenumber % 2 = 0) ELSE (l_suppkey % 2 = 0) AND (l_linenumber % 2 = 0) AND (l_orderkey % 2 = 0) END AS alike FROM lineitem""")
def same_picture(spark, sf):
    c = F.col

    def one(family, transfer, primaries, matrix):
        return F.struct(family.alias("family"), transfer.alias("transfer"), primaries.alias("primaries"), matrix.alias("matrix"), F.lit("tv").alias("range"))

    a = one(F.when(c("l_partkey") % 3 == 0, "RGB").otherwise("YUV"), F.lit("x"), F.lit(None).cast("string"), F.lit("m"))
    b = one(F.lit("YUV"), F.when(c("l_suppkey") % 2 == 0, "x").otherwise("y"), F.when(c("l_linenumber") % 2 != 0, "p"), F.when(c("l_orderkey") % 2 == 0, "m").otherwise("n"))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", color.same_picture(a, b).alias("alike"))


@query("""WITH m AS (SELECT o_orderkey, ['[ab', '[a[b]cdefgh] x]', '[short] y', 'plain [abcdefgh]', '[abcdefgh]' || chr(10) || 'z', '[abc' || chr(10) || 'defgh] q'][o_orderkey % 6 + 1] AS t FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN '[a[b]c' || chr(8230) || '] x]' WHEN 4 THEN '[abcde' || chr(8230) || ']' || chr(10) || 'z' ELSE t END AS label, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 1 THEN '--lp 1' END AS args,
  o_orderkey % 5 <> 0 OR o_orderkey % 4 < 2 AS measurable, 'YUV4MPEG2 W' || o_orderkey || ' H1080 F24000:1001 Ip C420p10' || chr(10) AS head FROM m""")
def labels_and_flags(spark, sf):
    from chunkloom.functions import geometry

    o = F.col("o_orderkey")
    text = _pick(("[ab", "[a[b]cdefgh] x]", "[short] y", "plain [abcdefgh]", "[abcdefgh]\nz", "[abc\ndefgh] q"), o % 6)
    args = media.single_cpu_args(F.lit("svt-av1"), o % 3, F.when(o % 2 == 1, F.create_map(F.lit("lp"), F.lit("2"))).otherwise(F.create_map(F.lit("crf"), F.lit("2"))))
    able = geometry.measurable(F.when(o % 5 == 0, "bwdif"), F.when(o % 4 == 0, "x"), F.when(o % 4 == 1, "x"))
    head = media.frame_header(o, F.lit(1080), F.lit(24000), F.lit(1001), geometry.header_colorspace(F.lit("420"), F.lit(10)))
    return _table(spark, sf, "orders").select("o_orderkey", media.short_label(text, 5).alias("label"), F.array_join(args, " ").alias("args"), able.alias("measurable"), head.alias("head"))


@query(f"""WITH {LINES}, m AS (SELECT l_orderkey, l_linenumber AS frame, CASE WHEN l_partkey % 4 > 0 THEN 'm' || l_partkey % 3 END AS message FROM lines),
f AS (SELECT l_orderkey, message, min(frame) AS f FROM m WHERE message IS NOT NULL GROUP BY 1, 2), d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY f) - 1 AS id FROM f)
SELECT m.l_orderkey, frame, id, lower(hex(m.message)) AS hex, m.message FROM m LEFT JOIN d ON d.l_orderkey = m.l_orderkey AND d.message = m.message""")
def message_dictionary(spark, sf):
    from chunkloom.operators import pictures

    c = F.col
    frames = _lines(spark, sf).select("l_orderkey", c("l_linenumber").alias("frame"), F.when(c("l_partkey") % 4 > 0, F.concat(F.lit("m"), (c("l_partkey") % 3).cast("string")).cast("binary")).alias("message"))
    messages, numbered = pictures.message_dictionary(frames, ["l_orderkey"])
    back = pictures.from_dictionary(messages, numbered, ["l_orderkey"]).withColumn("message", c("message").cast("string"))
    return back.join(numbered.join(messages, ["l_orderkey", "id"], "left"), ["l_orderkey", "frame"])


@query(f"""WITH {LINES}, a AS (SELECT l_orderkey, bool_or(l_partkey % 6 = 0) AS any_frame FROM lines WHERE l_linenumber - 1 < 2 GROUP BY 1)
SELECT o.o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE coalesce(any_frame, false) END AS flagged FROM orders o LEFT JOIN a ON l_orderkey = o_orderkey""")
def flagged_interlaced(spark, sf):
    o = F.col("o_orderkey")
    seen = media.any_interlaced(_lines(spark, sf).select("l_orderkey", (F.col("l_linenumber") - 1).alias("frame"), (F.col("l_partkey") % 6 == 0).alias("interlaced")), ["l_orderkey"], "frame", 2)
    rows = _table(spark, sf, "orders").join(seen, o == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", media.interlaced_flag(F.when(o % 4 == 0, "bt").when(o % 4 == 1, "progressive"), F.col("any_frame")).alias("flagged"))


@query("""WITH j AS (SELECT o_orderkey, o_custkey % 3 AS profile FROM orders), r AS (SELECT o_orderkey, o_orderkey % 40 AS due, o_custkey % 2 AS profile FROM orders WHERE o_orderkey % 3 > 0)
SELECT j.o_orderkey, j.profile FROM j LEFT JOIN r USING (o_orderkey) WHERE r.o_orderkey IS NULL OR 20 >= due OR j.profile IS DISTINCT FROM r.profile""")
def due_jobs(spark, sf):
    from chunkloom.operators import progress

    o, k = F.col("o_orderkey"), F.col("o_custkey")
    orders = _table(spark, sf, "orders")
    return progress.due_jobs(orders.select("o_orderkey", (k % 3).alias("profile")), orders.where(o % 3 > 0).select("o_orderkey", (o % 40).alias("due"), (k % 2).alias("profile")), ["o_orderkey"], F.lit(20))


@query("""WITH s AS (SELECT o_orderkey, '/in/' || o_custkey AS path, o_orderkey % 50 AS size FROM orders)
SELECT o_orderkey, o_orderkey % 4 IN (0, 3) AS same, path || chr(10) || size AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'p' END AS profile_hash, CASE WHEN o_orderkey % 5 = 0 THEN 'probe: late' ELSE 'probe' END AS text FROM s""")
def failure_records(spark, sf):
    from chunkloom.operators import progress

    o = F.col("o_orderkey")
    s = _table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("/in/"), F.col("o_custkey").cast("string")).alias("path"), (o % 50).alias("size"))
    own = progress.source_id(F.col("path"), F.col("size"))
    seen = progress.unchanged(s, s.where(o % 4 != 2).select("o_orderkey", F.when(o % 4 == 1, "other").otherwise(F.concat(F.lit(" "), own)).alias("id")), ["o_orderkey"])
    link = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text"))
    chain = F.when(o % 5 == 0, F.array(link("Other", "probe"), link("TimedOut", "late"))).otherwise(F.array(link("Transient", "x"), link("Other", "probe")))
    markers = progress.failure_markers(s.withColumn("profile_hash", F.when(o % 2 == 0, "p")).withColumn("chain", chain), ["o_orderkey"])
    return seen.select("o_orderkey", "same").join(markers, "o_orderkey")
