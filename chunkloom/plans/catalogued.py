"""The operators on the tables the driver supplies, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions import color, media
from chunkloom.operators import catalog, intervals, matching, metrics, rules, search, state, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames: numbered from 0 per user in order of time and id; size in hundredths of value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.withColumns({"frame": (F.row_number().over(w) - 1).cast("long"), "size": F.floor(F.col("value") * 100).cast("long")})


def _scenes(frames: DataFrame) -> DataFrame:
    totals = frames.groupBy("user_id").agg(F.count("*").alias("total"))
    return intervals.scenes_from_cuts(frames.where(F.col("event_type") == "error").select("user_id", F.col("frame").alias("cut")), totals, ["user_id"])


FRAMES = """frames AS (
  SELECT event_id, ts, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
    CAST(floor(value * 100) AS BIGINT) AS size FROM events)"""
SCENES = FRAMES + """,
totals AS (SELECT user_id, count(*) AS total FROM frames GROUP BY user_id),
starts AS (
  SELECT user_id, 0 AS start_frame FROM totals
  UNION SELECT user_id, frame FROM frames WHERE event_type = 'error' AND frame > 0),
scenes AS (
  SELECT s.user_id, CAST(row_number() OVER w - 1 AS BIGINT) AS index, CAST(start_frame AS BIGINT) AS start_frame,
    CAST(coalesce(lead(start_frame) OVER w, total) - 1 AS BIGINT) AS end_frame
  FROM starts s JOIN totals t ON s.user_id = t.user_id WINDOW w AS (PARTITION BY s.user_id ORDER BY start_frame))"""
SPLIT = SCENES + """,
parts AS (
  SELECT user_id, start_frame, end_frame - start_frame + 1 AS size, (end_frame - start_frame + 5) // 5 AS n,
    unnest(range(0, (end_frame - start_frame + 5) // 5)) AS i FROM scenes),
split AS (
  SELECT user_id, start_frame + i * (size // n) + least(i, size % n) AS start_frame,
    start_frame + i * (size // n) + least(i, size % n) + size // n + CASE WHEN i < size % n THEN 1 ELSE 0 END - 1 AS end_frame FROM parts),
chunks AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_frame) - 1 AS BIGINT) AS index,
    CAST(start_frame AS BIGINT) AS start_frame, CAST(end_frame AS BIGINT) AS end_frame FROM split)"""
CUM = """cum AS (
  SELECT user_id, frame + 1 AS frame, sum(size) OVER (PARTITION BY user_id ORDER BY frame) AS cum FROM frames
  UNION ALL SELECT DISTINCT user_id, 0, 0 FROM frames)"""


@query(f"WITH {SCENES} SELECT * FROM scenes")
def scenes_from_cuts(spark, sf):
    return _scenes(_frames(spark, sf))


@query(f"WITH {SPLIT} SELECT * FROM chunks")
def bounded_split(spark, sf):
    return intervals.bounded_split(_scenes(_frames(spark, sf)), ["user_id"], 5)


@query(f"WITH {FRAMES}, {CUM} SELECT user_id, CAST(frame AS BIGINT) AS frame, CAST(cum AS BIGINT) AS cum FROM cum")
def cumulative_bytes(spark, sf):
    return timeline.cumulative_bytes(_frames(spark, sf), ["user_id"], ["ts", "event_id"], "size")


@query(f"""WITH {SPLIT}, {CUM}
SELECT c.user_id, index, start_frame, end_frame, CAST(100 * (end_frame - start_frame + 1) AS BIGINT) AS encoded,
  CASE WHEN b.cum > a.cum THEN CAST(1e2 AS DOUBLE) * CAST(100 * (end_frame - start_frame + 1) AS BIGINT) / CAST(b.cum - a.cum AS BIGINT) ELSE CAST(0 AS DOUBLE) END AS pct
FROM chunks c LEFT JOIN cum a ON a.user_id = c.user_id AND a.frame = c.start_frame LEFT JOIN cum b ON b.user_id = c.user_id AND b.frame = c.end_frame + 1""")
def chunk_size_pct(spark, sf):
    frames = _frames(spark, sf)
    chunks = intervals.bounded_split(_scenes(frames), ["user_id"], 5).withColumn("encoded", (F.lit(100) * (F.col("end_frame") - F.col("start_frame") + 1)).cast("long"))
    return search.chunk_size_percent(chunks, timeline.cumulative_bytes(frames, ["user_id"], ["ts", "event_id"], "size"), ["user_id"])


@query(f"WITH {SCENES} SELECT f.event_id, f.user_id, f.frame, s.index FROM frames f JOIN scenes s ON f.user_id = s.user_id AND f.frame BETWEEN s.start_frame AND s.end_frame")
def range_assign(spark, sf):
    frames = _frames(spark, sf)
    return intervals.assign_frames(frames.select("event_id", "user_id", "frame"), _scenes(frames), ["user_id"]).select("event_id", "user_id", "frame", "index")


@query("""WITH f AS (SELECT user_id, count(*) AS total FROM events GROUP BY user_id) SELECT user_id, CAST(0 AS BIGINT) AS violations, CAST(1 AS BIGINT) AS negative_control FROM f""")
def gap_check(spark, sf):
    frames = _frames(spark, sf)
    totals = frames.groupBy("user_id").agg(F.count("*").alias("total"))
    scenes = _scenes(frames)
    w = Window.partitionBy("user_id").orderBy(F.col("index").desc())
    broken = scenes.withColumn("end_frame", F.when(F.row_number().over(w) == 1, F.col("end_frame") - 1).otherwise(F.col("end_frame")))
    good, bad = intervals.violations(scenes, totals, ["user_id"]), intervals.violations(broken, totals, ["user_id"])
    return good.join(bad.select("user_id", F.when(F.col("violations") > 0, 1).otherwise(0).cast("long").alias("negative_control")), "user_id")


@query("SELECT event_type, quantile_disc(value, 0.95) AS p FROM events GROUP BY event_type")
def nearest_rank_p95(spark, sf):
    return metrics.nearest_rank(_table(spark, sf, "events"), ["event_type"], "value")


@query("""SELECT event_type, min(value) AS least, max(value) AS most, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median FROM events GROUP BY event_type""")
def crf_summary(spark, sf):
    return metrics.summary(_table(spark, sf, "events"), ["event_type"], "value")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""")
def carry_forward(spark, sf):
    e = _table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return timeline.carry_forward(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "carried").select("event_id", "user_id", "carried")


@query(f"""WITH {FRAMES},
b AS (SELECT user_id, frame, size, coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM frames),
c AS (SELECT user_id, frame, size > 0 AND 2 * before + size < 100000 AS ok FROM b)
SELECT user_id, CAST(coalesce(min(frame) FILTER (NOT ok), count(*)) AS BIGINT) AS n FROM c GROUP BY user_id""")
def take_while_cover(spark, sf):
    return timeline.take_while_cover(_frames(spark, sf), ["user_id"], ["ts", "event_id"], "size", 50_000)


@query(f"""WITH {FRAMES}, h AS (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM frames WHERE event_type = 'error')
SELECT user_id, CAST(min(frame) AS BIGINT) AS first_frame, count(*) AS n FROM h GROUP BY user_id, g HAVING count(*) >= 3""")
def lockout_islands(spark, sf):
    e = _table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return timeline.islands(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 3)


@query("SELECT o_orderkey, CAST(60 * least(power(2, least(o_orderkey % 9, 6)), 60) AS BIGINT) AS wait_s FROM orders")
def retry_backoff(spark, sf):
    return _table(spark, sf, "orders").select("o_orderkey", state.backoff(F.col("o_orderkey") % 9, 60).alias("wait_s"))


@query("""WITH p AS (
  SELECT l_partkey, l_quantity AS crf, CAST(10 AS DOUBLE) - CAST(10 AS DOUBLE) * l_discount AS jod, l_extendedprice / CAST(1000 AS DOUBLE) AS size, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
t AS (SELECT *, CASE WHEN jod >= 9.5 AND size <= 30 THEN 0 WHEN size <= 30 THEN 1 ELSE 2 END AS tier FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY tier, CASE tier WHEN 0 THEN -crf WHEN 1 THEN -jod ELSE size END, CASE tier WHEN 2 THEN seq ELSE -seq END) AS k,
  NOT bool_or(size > 30) OVER (PARTITION BY l_partkey) OR (NOT bool_or(jod >= 9.5) OVER (PARTITION BY l_partkey) AND min(crf) OVER (PARTITION BY l_partkey) <= 1) AS hopeless FROM t)
SELECT l_partkey, crf, jod, size, jod >= 9.5 AS floor_held, CASE WHEN tier = 0 THEN 'met' WHEN tier = 2 THEN 'oversize' WHEN hopeless THEN 'unreachable' ELSE 'capped' END AS outcome FROM r WHERE k = 1""")
def constrained_argmax(spark, sf):
    p = _table(spark, sf, "lineitem").select(
        "l_partkey", F.col("l_quantity").alias("crf"), (F.lit(1e1) - F.lit(1e1) * F.col("l_discount")).alias("jod"), (F.col("l_extendedprice") / F.lit(1e3)).alias("size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return search.best_probe(p, ["l_partkey"], search.holds(F.col("jod"), 9.5), 30.0, low=1.0)


@query("""WITH b AS (SELECT l_suppkey, l_orderkey % 89 AS x, l_partkey % 97 AS y, l_linenumber + 1 AS w, l_partkey % 13 + 1 AS h FROM lineitem)
SELECT l_suppkey, min(x) AS x, min(y) AS y, CAST(max(x + w) - min(x) AS BIGINT) AS w, CAST(max(y + h) - min(y) AS BIGINT) AS h FROM b GROUP BY l_suppkey""")
def bounding_box(spark, sf):
    li = _table(spark, sf, "lineitem")
    b = li.select("l_suppkey", (F.col("l_orderkey") % 89).alias("x"), (F.col("l_partkey") % 97).alias("y"), (F.col("l_linenumber") + 1).cast("long").alias("w"), (F.col("l_partkey") % 13 + 1).alias("h"))
    return metrics.bounding_box(b, ["l_suppkey"])


@query("""WITH v AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS tff, count(*) FILTER (event_type = 'view') AS bff FROM events GROUP BY user_id)
SELECT user_id, tff, bff, CASE WHEN greatest(tff, bff) >= 10 AND greatest(tff, bff) >= least(tff, bff) THEN CASE WHEN tff >= bff THEN 'tff' ELSE 'bff' END END AS verdict FROM v""")
def vote_verdict(spark, sf):
    v = _table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("tff"), F.count_if(F.col("event_type") == "view").alias("bff"))
    return v.withColumn("verdict", metrics.verdict(F.col("tff"), F.col("bff"), least=10, factor=1))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NULL OR trim(lang) IN ('', 'und', 'de', 'es') GROUP BY lang")
def language_filter(spark, sf):
    return _table(spark, sf, "documents").where(rules.language_selected(F.col("lang"), ["de", "es"])).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars, lang FROM documents d WHERE (SELECT count(*) FROM documents e WHERE e.n_chars = d.n_chars AND e.lang = d.lang) = 1")
def unique_names(spark, sf):
    return catalog.unique_names(_table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), ["n_chars", "lang"])


def _chunks_done(spark, sf):
    li = _table(spark, sf, "lineitem")

    def counted(df):
        return df.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("frames"), F.floor(F.sum("l_quantity")).cast("long").alias("size_bytes"))

    return counted(li), counted(li.where(F.col("l_linenumber") <= 4))


DONE = """a AS (SELECT l_orderkey AS o_orderkey, count(*) AS frames, CAST(floor(sum(l_quantity)) AS BIGINT) AS size_bytes FROM lineitem GROUP BY 1),
d AS (SELECT l_orderkey AS o_orderkey, count(*) AS frames, CAST(floor(sum(l_quantity)) AS BIGINT) AS size_bytes FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1)"""


@query(f"WITH {DONE} SELECT a.* FROM a LEFT JOIN d USING (o_orderkey, frames, size_bytes) WHERE d.o_orderkey IS NULL OR size_bytes <= 0")
def pending_chunks(spark, sf):
    chunks, done = _chunks_done(spark, sf)
    return state.pending(chunks, done, ["o_orderkey"])


@query(f"WITH {DONE} SELECT a.* FROM a JOIN d USING (o_orderkey, frames, size_bytes) WHERE size_bytes > 0")
def resumed_chunks(spark, sf):
    chunks, done = _chunks_done(spark, sf)
    return state.finished(chunks, done, ["o_orderkey"])


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.event_id = o.o_orderkey AND e.user_id % 7 = o.o_custkey % 7)""")
def failure_theta_anti(spark, sf):
    o, e = _table(spark, sf, "orders").select("o_orderkey", "o_custkey"), _table(spark, sf, "events").where(F.col("event_type") == "error").select("event_id", "user_id")
    return catalog.without_failures(o, e, (F.col("event_id") == F.col("o_orderkey")) & (F.col("user_id") % 7 == F.col("o_custkey") % 7)).select("o_orderkey")


@query("""WITH r(p_brand, codec, bitrate) AS (VALUES ('Brand#11', 'flac', NULL), ('Brand#12', NULL, '96k'), ('Brand#13', 'opus', '128k'))
SELECT p_partkey, coalesce(CASE WHEN r.p_brand IS NOT NULL THEN r.codec WHEN p_size > 25 THEN 'alac' END, 'aac') AS codec,
  coalesce(CASE WHEN r.p_brand IS NOT NULL THEN r.bitrate WHEN p_size > 25 THEN '320k' END, '192k') AS bitrate FROM part p LEFT JOIN r ON p.p_brand = r.p_brand""")
def rule_overlay(spark, sf):
    own = spark.createDataFrame([("Brand#11", "flac", None), ("Brand#12", None, "96k"), ("Brand#13", "opus", "128k")], "p_brand string, codec string, bitrate string")
    out = rules.overlaid(_table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), own, "p_brand", F.col("p_size") > 25, {"codec": "alac", "bitrate": "320k"}, {"codec": "aac", "bitrate": "192k"})
    return out.select("p_partkey", "codec", "bitrate")


@query("""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS ordinal, CASE WHEN role = 'user' THEN turn END AS id FROM conversations),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS ordinal, turn AS number FROM conversations WHERE role <> 'system'),
n AS (SELECT s.conv_id FROM (SELECT conv_id, count(*) AS n FROM s GROUP BY 1) s JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY 1) t ON s.conv_id = t.conv_id AND s.n = t.n)
SELECT s.conv_id, CAST(s.ordinal AS BIGINT) AS ordinal, t.number, 'number' AS by FROM s JOIN t ON s.conv_id = t.conv_id AND s.id = t.number
UNION ALL SELECT s.conv_id, CAST(s.ordinal AS BIGINT), t.number, 'place' FROM s JOIN n ON s.conv_id = n.conv_id JOIN t ON s.conv_id = t.conv_id AND s.ordinal = t.ordinal WHERE s.id IS NULL""")
def twin_match(spark, sf):
    c = _table(spark, sf, "conversations").select("conv_id", "turn", "role")
    ordinal = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) - 1).cast("long").alias("ordinal")
    return matching.twins(c.select("conv_id", ordinal, F.when(F.col("role") == "user", F.col("turn")).alias("id")), c.where(F.col("role") != "system").select("conv_id", ordinal, F.col("turn").alias("number")), ["conv_id"])


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 3 WHEN 0 THEN l_linenumber * 10 WHEN 1 THEN l_linenumber * l_linenumber * 10 ELSE -l_linenumber * 10 END AS t FROM lineitem),
w AS (SELECT l_orderkey, t - first_value(t) OVER o AS d, row_number() OVER o - 1 AS i, lag(t) OVER o AS p, t FROM t WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, CASE WHEN bool_and(abs(d - i * 10) * 2 <= 10) THEN 'constant' WHEN bool_and(coalesce(t > p, true)) THEN 'variable' ELSE 'unordered' END AS kind FROM w GROUP BY l_orderkey""")
def vfr_test(spark, sf):
    n = F.col("l_linenumber")
    t = F.when(F.col("l_orderkey") % 3 == 0, n * 10).when(F.col("l_orderkey") % 3 == 1, n * n * 10).otherwise(-n * 10)
    return timeline.frame_rate_kind(_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t")), ["l_orderkey"], "t", F.lit(10), ["l_linenumber"])


@query("""WITH l AS (SELECT p_partkey, ['mono', 'stereo', '3.0', 'quad', '5.0', '5.1', '6.1', '7.1'][CAST(greatest(1, least(8, p_size % 10)) AS BIGINT)] AS layout FROM part)
SELECT p_partkey, layout, CASE layout WHEN 'stereo' THEN '160k' WHEN '5.1' THEN '384k' ELSE '96k' END AS bitrate FROM l""")
def layout_name(spark, sf):
    p = _table(spark, sf, "part").select("p_partkey", rules.layout_name(F.col("p_size") % 10).alias("layout"))
    rates = F.create_map(*[F.lit(x) for x in ("stereo", "160k", "5.1", "384k", "default", "96k")])
    return p.withColumn("bitrate", rules.bitrate_for(rates, F.col("layout")))


@query("""SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) - 1 AS BIGINT) AS position FROM conversations""")
def track_order(spark, sf):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return timeline.track_order(_table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [rank, F.col("turn")])


@query(f"""WITH {SPLIT}, f AS (SELECT c.user_id, index, unnest(range(start_frame, end_frame + 1)) - start_frame AS local FROM chunks c)
SELECT user_id, index, CAST(local AS BIGINT) AS local, CAST(row_number() OVER (PARTITION BY user_id ORDER BY index, local) - 1 AS BIGINT) AS pts FROM f""")
def concat_renumber(spark, sf):
    chunks = intervals.bounded_split(_scenes(_frames(spark, sf)), ["user_id"], 5)
    parts = chunks.select("user_id", "index", F.explode(F.expr("sequence(0L, end_frame - start_frame)")).alias("local"))
    return timeline.numbered_concat(parts, ["user_id"], ["index", "local"])


@query("""SELECT doc_id, 'quality' AS field, CAST(quality AS VARCHAR) AS value FROM labels WHERE quality IS DISTINCT FROM 1
UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels WHERE toxic IS DISTINCT FROM 0""")
def changed_fields(spark, sf):
    return rules.changed_fields(_table(spark, sf, "labels"), ["doc_id"], {"quality": 1, "toxic": 0})


@query("""SELECT n_nationkey, lower(lpad(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::UHUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS UBIGINT)), 16, '0')) AS hash FROM nation""")
def stable_hash(spark, sf):
    return _table(spark, sf, "nation").select("n_nationkey", state.fnv1a("n_name").alias("hash"))


@query("""SELECT c_custkey, greatest(1, least(CAST(floor((c_custkey % 32 + 1) / 6.0) AS BIGINT), CAST(floor((c_custkey % 64 + 1) / ((c_nationkey + 1) * CAST(1.5 AS DOUBLE))) AS BIGINT))) AS workers FROM customer""")
def worker_split(spark, sf):
    c = _table(spark, sf, "customer")
    return c.select("c_custkey", metrics.worker_split(F.col("c_custkey") % 32 + 1, (F.col("c_custkey") % 64 + 1).cast("double"), (F.col("c_nationkey") + 1).cast("double"), F.lit(6)).alias("workers"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size || 'k' WHEN p_size % 4 = 1 THEN p_size || '.5M' WHEN p_size % 4 = 2 THEN p_size || 'm' ELSE '' || p_size END AS rate, p_size FROM part)
SELECT p_partkey, rate, CAST(CASE p_size % 4 WHEN 0 THEN p_size * 1000 WHEN 1 THEN floor((p_size + 0.5) * 1000000) WHEN 3 THEN p_size END AS BIGINT) AS bits FROM s""")
def bitrate_parse(spark, sf):
    n = F.col("p_size").cast("string")
    rate = F.when(F.col("p_size") % 4 == 0, F.concat(n, F.lit("k"))).when(F.col("p_size") % 4 == 1, F.concat(n, F.lit(".5M"))).when(F.col("p_size") % 4 == 2, F.concat(n, F.lit("m"))).otherwise(n)
    return _table(spark, sf, "part").select("p_partkey", rate.alias("rate")).withColumn("bits", rules.parse_bitrate(F.col("rate")))


@query("""SELECT l_suppkey, CASE WHEN bool_and(l_linenumber <> 7) THEN min(l_orderkey) ELSE min(l_partkey) END AS first FROM lineitem GROUP BY l_suppkey""")
def first_time(spark, sf):
    p = _table(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("pts"), F.col("l_partkey").alias("dts"))
    return timeline.first_time(p, ["l_suppkey"])


@query("""WITH s AS (SELECT user_id, event_id // 50 AS win, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'none' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'ok' ELSE 'transient' END AS status FROM events)
SELECT user_id, win, CASE WHEN bool_or(status = 'transient') THEN 'error' WHEN NOT bool_or(status = 'ok') AND bool_or(status = 'failed') THEN 'error' WHEN NOT bool_or(status = 'ok') THEN 'nothing' WHEN bool_or(status = 'failed') THEN 'uncached' ELSE 'cached' END AS outcome FROM s GROUP BY user_id, win""")
def sample_outcome(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "signup"), "ok").when(kind == "click", "none").when(kind == "error", "failed").otherwise("transient")
    rows = _table(spark, sf, "events").select("user_id", F.expr("event_id div 50").alias("win"), status.alias("status"))
    return metrics.sample_outcome(rows, ["user_id", "win"])


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 8 + 1 AS channels FROM lineitem)
SELECT l_orderkey, 'c' || arg_max(channels, channels * 10 + l_linenumber) AS layout, max(channels) AS channels FROM s GROUP BY l_orderkey HAVING count(DISTINCT channels) > 1""")
def widest_layout(spark, sf):
    ch = F.col("l_partkey") % 8 + 1
    s = _table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), ch.alias("channels"), F.concat(F.lit("c"), ch.cast("string")).alias("layout"))
    return metrics.widest_layout(s, ["l_orderkey"])


@query("""WITH a AS (SELECT o_orderkey % 500 AS k, o_orderkey AS seq, o_orderstatus AS status FROM orders)
SELECT k, max(seq) AS seq, arg_max(status, seq) AS status FROM a GROUP BY k""")
def state_upsert(spark, sf):
    o = _table(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return state.upsert(o.where(F.col("seq") % 2 == 0), o.where(F.col("seq") % 2 == 1), ["k"], "seq")


@query("""SELECT n_chars, lang, array_to_string(list_sort(list(lpad(CAST(doc_id AS VARCHAR), 12, '0'))), ', ') AS names FROM documents WHERE n_chars IS NOT NULL GROUP BY n_chars, lang HAVING count(*) > 1""")
def collision_report(spark, sf):
    d = _table(spark, sf, "documents").where(F.col("n_chars").isNotNull()).select("n_chars", "lang", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"))
    return catalog.collisions(d, ["n_chars", "lang"], "name")


@query("""SELECT p_partkey, rule FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN NOT p_size < 40 THEN 'crf_order' END, CASE WHEN NOT p_size >= 5 THEN 'crf_range' END], lambda x: x IS NOT NULL)) AS rule FROM part)""")
def rule_violations(spark, sf):
    checks = {"crf_order": F.col("p_size") < 40, "crf_range": F.col("p_size") >= 5}
    return rules.violated(_table(spark, sf, "part").select("p_partkey", "p_size"), ["p_partkey"], checks)


@query()
def curve_search(spark, sf):
    """Search of the best setting on curves made of a part's line items (no SQL: data-dependent iteration)."""
    li = _table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").alias("crf"), (F.lit(10e0) - F.col("l_quantity") / 25).alias("jod"), (F.lit(120e0) * F.exp(-F.col("l_quantity") / 20)).alias("size"))
    return search.solve_curves(li, "l_partkey", target=9.2, cap=90.0)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'pcm_f32le' WHEN l_partkey % 40 BETWEEN 1 AND 16 OR (l_partkey % 40 = 0 AND l_returnflag = 'N') THEN 'pcm_s16le'
  WHEN l_partkey % 40 BETWEEN 17 AND 24 THEN 'pcm_s24le' ELSE 'pcm_s32le' END AS codec FROM lineitem""")
def pcm_codec(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "fltp").when(F.col("l_returnflag") == "N", "s16").otherwise("s32p")
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", media.pcm_codec(kind, F.col("l_partkey") % 40).alias("codec"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' (Opus)' WHEN 1 THEN '' ELSE p_name END AS title FROM part)
SELECT p_partkey, CASE WHEN title = '' THEN 'Opus' ELSE regexp_replace(title, '\\s*\\(Opus\\)$', '') || ' (Opus)' END AS title FROM t""")
def marked_title(spark, sf):
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" (Opus)"))).when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("p_name"))
    return _table(spark, sf, "part").select("p_partkey", media.marked_title(title, "Opus").alias("title"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 - 1 AS flip, l_suppkey % 4 * 90 AS turn FROM lineitem),
n AS (SELECT *, flip <> 0 AND turn = 180 AS half FROM t),
m AS (SELECT *, CASE WHEN half THEN 0 ELSE (360 - turn) % 360 END AS back FROM n)
SELECT l_orderkey, l_linenumber, CASE WHEN flip = 0 THEN NULL WHEN (flip > 0) <> half THEN 'horizontal' ELSE 'vertical' END AS mirror,
  CAST(CASE WHEN back > 180 THEN back - 360 ELSE back END AS INTEGER) AS roll FROM m""")
def orientation(spark, sf):
    turned = media.orientation(F.col("l_partkey") % 3 - 1, F.col("l_suppkey") % 4 * 90).alias("o")
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", turned).select("l_orderkey", "l_linenumber", "o.mirror", "o.roll")


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE l_returnflag WHEN 'A' THEN (l_partkey + 1) // 2 WHEN 'N' THEN (l_partkey + 1) // 2 ELSE l_partkey END AS BIGINT) AS w,
  CAST(CASE l_returnflag WHEN 'A' THEN (l_suppkey + 1) // 2 ELSE l_suppkey END AS BIGINT) AS h, CAST(CASE WHEN l_returnflag IN ('A', 'N') THEN l_linenumber // 2 ELSE l_linenumber END AS BIGINT) AS x FROM lineitem""")
def chroma_geometry(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "420").when(F.col("l_returnflag") == "N", "422").otherwise("444")
    g = media.chroma_geometry(kind, F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_linenumber")).alias("g")
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", g).select("l_orderkey", "l_linenumber", "g.w", "g.h", "g.x")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'extract' WHEN 'view' THEN 'extract_srt' ELSE 'mux' END AS route FROM events""")
def subtitle_route(spark, sf):
    codec = F.when(F.col("event_type") == "click", "subrip").when(F.col("event_type") == "view", "mov_text").otherwise("eia_608")
    return _table(spark, sf, "events").select("event_id", media.subtitle_route(codec).alias("route"))


@query("""WITH t AS (SELECT doc_id, string_split(trim(coalesce(text, ''), concat(chr(10), ' ', chr(9), chr(13))), chr(10)) AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) > 3 THEN '[' || (len(l) - 3) || ' earlier lines]' || chr(10) || array_to_string(l[-3:], chr(10)) ELSE array_to_string(l, chr(10)) END AS tail FROM t""")
def tail_lines(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", media.tail_lines(F.coalesce("text", F.lit("")), 3).alias("tail"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 100 > o_orderkey % 70 + 1 THEN CAST(-1000 * (o_orderkey % 7) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS shift_ms FROM orders""")
def wrapped_shift(spark, sf):
    o = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "mpegts").otherwise("matroska")
    return _table(spark, sf, "orders").select("o_orderkey", media.wrapped_shift_ms(kind, o % 100, o % 7, o % 70).alias("shift_ms"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 1500 > 650 AND o_orderkey % 900 <= 650 THEN 6 ELSE 0 END AS n FROM orders""")
def untagged_flags(spark, sf):
    o = F.col("o_orderkey")
    flags = color.untagged_flags(F.array(F.lit("--keyint")), o % 2 == 0, o % 1500, o % 900)
    return _table(spark, sf, "orders").select("o_orderkey", F.size(flags).alias("n"))
