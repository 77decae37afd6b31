"""Operator 5: line dedup with keep bitmaps, in DataFrame functions only.

Hashes of line keys are range-partitioned. As hashes are spread evenly, equal ranges are known
beforehand and nothing has to be sampled for them. Partitions are sorted by hash, then document
(from the largest), then position, and one pass in that order finds the first document of each key
and counts its documents: it needs no shuffle beside that of the ranges. The operator returns, per
document, a sparse bitmap of the lines that stay instead of text.

A key that fills a large part of a range is dealt over all partitions by document, and what the
parts found of it is put together after the pass. Such keys are looked for in the lines of one
document in SAMPLE; that only says how rows are dealt, never what is found.

Cases: a null or empty text is one empty line, which is too short to be dropped; very long texts
have as many lines as they have; repeated rows (same id, same text) are treated alike and all stay;
a null doc_id counts as one document below all others; extra columns are kept, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLANK = " \t\n\x0b\x0c\r"
#: One document in so many is looked at for frequent keys, and lines meant for a partition.
SAMPLE, PART = 64, 4_000_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def hashed_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """h1, h2, doc_id, tkey (the text's hash), pos of each line whose key has min_chars code points or more."""
    lines = docs.select("doc_id", F.xxhash64(common.text_or_empty()).alias("tkey"), F.posexplode(F.split(common.text_or_empty(), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "tkey", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(5)).alias("h2"), "doc_id", "tkey", "pos")


def frequent_keys(docs: DataFrame, min_chars: int) -> tuple[DataFrame, int]:
    """h1, h2 of keys that would fill a large part of a partition (at most four for each partition), and the number of partitions."""
    some = hashed_lines(docs.where(F.pmod(F.xxhash64("doc_id", F.lit("lines")), F.lit(SAMPLE)) == 0), min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    some = common.written(some, "line-sample")
    lines = some.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines * SAMPLE // PART)
    return some.where(F.col("n") >= max(8, lines // (4 * parts))).select("h1", "h2"), parts


def line_runs(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Lines by range of hash, in order of hash, document from the largest and position: part, h1, h2, frequent, doc_id, tkey, pos, nth (place of the document in the key's run) and n_docs (documents of the run).

    A key that isn't frequent has one run.
    """
    frequent, parts = frequent_keys(docs, min_chars)
    # at most four keys for each partition
    marked = hashed_lines(docs, min_chars).join(F.broadcast(frequent.withColumn("frequent", F.lit(True))), ["h1", "h2"], "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    of_range = F.shiftright((F.shiftright("h1", 32) + F.lit(1 << 31)) * F.lit(parts), 32)
    part = F.when(F.col("frequent"), F.pmod(of_range + F.pmod(F.xxhash64("doc_id"), F.lit(parts)), F.lit(parts))).otherwise(of_range).cast("int")
    last_first = F.col("doc_id").desc_nulls_last()
    dealt = marked.withColumn("part", part).repartitionById(parts, "part").sortWithinPartitions("part", "h1", "h2", last_first, "pos")
    run = Window.partitionBy("part", "h1", "h2")
    return dealt.withColumn("nth", F.dense_rank().over(run.orderBy(last_first))).withColumn("n_docs", F.max("nth").over(run))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, tkey (hash of the text), keep map<int,bigint> (word number to 64 bits, a set bit is a line that stays; words not there stay whole), n_dropped; only documents that lose lines.

    A line goes if its key occurs in min_docs documents or more and this document isn't the first
    (largest doc_id) that holds it.
    """
    runs = line_runs(docs, min_chars).where(F.col("frequent") | ((F.col("n_docs") >= min_docs) & (F.col("nth") > 1)))
    runs = common.written(runs.drop("nth"), "line-runs")
    split = runs.where("frequent")
    # at most four keys for each partition
    whole = split.groupBy("h1", "h2", "part").agg(F.max("n_docs").alias("n"), F.max("doc_id").alias("first_doc")).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("first_doc").alias("first_doc"))
    again = split.join(F.broadcast(whole.where(F.col("n") >= min_docs)), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    lost = runs.where("not frequent").select("doc_id", "tkey", "pos").unionByName(again.select("doc_id", "tkey", "pos"))
    words = lost.groupBy("doc_id", "tkey", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("lost"))
    return words.groupBy("doc_id", "tkey").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("keep")))).alias("keep"), F.sum(F.bit_count("lost")).cast("long").alias("n_dropped")
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The text of the lines whose bit is set."""
    bit = lambda i: F.call_function("shiftright", F.coalesce(F.try_element_at(keep, (i / 64).cast("int")), F.lit(-1).cast("long")), (i % 64).cast("int"))
    lines = F.filter(F.split(text, "\n"), lambda _, i: F.expr("1L").bitwiseAND(bit(i)) == 1)
    return F.when(keep.isNull(), text).otherwise(F.array_join(lines, "\n"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """All rows and columns of docs and, under the name returned, their bitmaps' rows."""
    name = common.free_name(docs, "bitmap")
    right = bitmaps.select(F.struct("*").alias(name))
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & (F.xxhash64(common.text_or_empty()) == F.col(f"{name}.tkey")), "left"), name


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All rows and columns of docs, and kept (text of the lines that stay), n_lines, n_dropped, which replace columns of these names."""
    both, name = with_bitmaps(docs, bitmaps)
    text = common.text_or_empty()
    new = {"kept": kept_text(text, F.col(f"{name}.keep")), "n_lines": F.size(F.split(text, "\n")).cast("long"), "n_dropped": F.coalesce(F.col(f"{name}.n_dropped"), F.lit(0).cast("long"))}
    return both.withColumns(new).drop(name)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents with repeated lines taken out of text; n_chars, where there is one, counts anew. Other columns stay."""
    both, name = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    out = both.withColumn("text", kept_text(common.text_or_empty(), F.col(f"{name}.keep")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
keys AS (
  SELECT key, max(doc_id) AS first_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.pos, keys.key IS NOT NULL AND k.doc_id <> first_doc AS gone FROM keyed k LEFT JOIN keys ON k.key = keys.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
