"""Operator 10: SimHash document fingerprints and Hamming search, in DataFrame functions only.

Each term's 64-bit hash votes on 64 bits, once per occurrence, so a term weighs as often as it
occurs. Votes are counted in packed lanes: sixteen longs of four 16-bit lanes, opened into 64
counters every LANE terms. Permuted block tables find all fingerprints within a Hamming radius:
with more blocks than the radius some blocks must agree, so a table for each choice of agreeing
blocks is an equality join. Every pair is taken from the first table that has it.

The search takes as queries the rows whose doc_id is divisible by EVERY, against all rows; it
returns numbers, not pairs.

Cases: null is empty; a text without terms has the fingerprint of zeros; very long texts are counted
in stretches; equal texts have equal fingerprints; repeated rows get a row each; a null doc_id comes
after all others and is no query; extra columns are ignored; empty tables give empty results; in the
search, null fingerprints match nothing and repeated ones are joined once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Terms counted in 16-bit lanes before these are opened.
LANE = 32_000
#: Rows whose doc_id is divisible by it are the search's queries; ids meant for a partition.
EVERY, PART = 50, 5_000_000
SPLIT = "[ \\t\\n\\x0b\\f\\r]+"


def terms(text: Column) -> Column:
    """Words between spaces, ASCII letters in lower case."""
    import string

    return F.filter(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SPLIT), lambda w: w != "")


def _lanes(hashes: Column) -> Column:
    """Array of 16 longs; lane k of long j counts the hashes with bit j + 16k."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(16)])
    mask = F.lit(0x0001000100010001)

    def add(acc, h):
        return F.struct(*[(acc[f"c{j}"] + (F.shiftrightunsigned(h, j) if j else h).bitwiseAND(mask)).alias(f"c{j}") for j in range(16)])

    return F.aggregate(hashes, zero, add, lambda acc: F.array(*[acc[f"c{j}"] for j in range(16)]))


def _bound(value: Column, use) -> Column:
    """use(value), where value is computed once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def simhash(term_array: Column) -> Column:
    """The fingerprint, as a long, of an array of terms: a bit is 1 if over half of the votes are for it."""

    def of_hashes(hashes):
        n = F.size(hashes)
        # each stretch of LANE terms gives sixteen longs, which are opened and summed
        stretches = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(LANE)), lambda i: _lanes(F.slice(hashes, i, LANE)))
        return _bound(stretches, lambda lanes: _vote(lanes, n))

    return _bound(F.transform(term_array, lambda w: F.xxhash64(w)), of_hashes)


def _vote(stretches: Column, n: Column) -> Column:
    def opened(x):
        """Counters of bits j, j + 16, j + 32, j + 48 from lane long j of all stretches."""
        lanes = F.sequence(F.lit(0), F.lit(3))
        return F.transform(lanes, lambda k: F.aggregate(stretches, F.lit(0).cast("long"), lambda acc, s: acc + F.call_function("shiftrightunsigned", F.element_at(s, x + 1), k * 16).bitwiseAND(F.lit(0xFFFF))))

    def bits(x):
        return F.aggregate(
            F.transform(opened(x), lambda count, k: F.when(count * 2 > n, F.call_function("shiftleft", F.lit(1).cast("long"), k * 16 + x)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"),
            lambda acc, y: acc.bitwiseOR(y),
        )

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(15)), bits), F.lit(0).cast("long"), lambda acc, y: acc.bitwiseOR(y))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1e0) - distance(a, b).cast("double") / F.lit(64e0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long) of each row."""
    return docs.select("doc_id", simhash(terms(common.text_or_empty())).alias("fingerprint"))


def block_masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks - radius blocks, the mask of their bits: fingerprints within the radius agree on one of them."""
    if blocks <= radius:
        raise ValueError("there must be more blocks than differing bits")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(each, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radius(stored: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """query_fingerprint, fingerprint, differing: all distinct pairs within the radius. Both tables have a column fingerprint (long); nulls match nothing."""
    known = block_masks(radius, blocks)
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(signed(m)).alias("m")) for t, m in enumerate(known)])

    def tables(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        return one.select(name, F.explode(masks).alias("x")).select(name, F.col("x.t").alias("t"), F.col(name).bitwiseAND(F.col("x.m")).alias("key"))

    pairs = tables(queries, "query_fingerprint").join(tables(stored, "fingerprint"), ["t", "key"])
    near = pairs.withColumn("differing", distance(F.col("query_fingerprint"), F.col("fingerprint"))).where(F.col("differing") <= radius)
    differ = F.col("query_fingerprint").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, t) for t, m in enumerate(known)])
    return near.where(F.col("t") == first).select("query_fingerprint", "fingerprint", "differing")


def near_counts(rows: DataFrame, every: int = EVERY, radius: int = 3, blocks: int = 5) -> DataFrame:
    """rows (doc_id, fp, ...) with near: of rows whose doc_id is divisible by every, how many other fingerprints lie within the radius of theirs; null for the rest."""
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = within_radius(rows.select(F.col("fp").alias("fingerprint")), rows.where(asked).select(F.col("fp").alias("fingerprint")), radius, blocks)
    counts = found.groupBy(F.col("query_fingerprint").alias("__fp")).agg((F.count("*") - 1).alias("near"))
    some = rows.where(asked).join(counts, F.col("fp") == F.col("__fp"), "left").drop("__fp")
    return some.unionByName(rows.where(~asked).withColumn("near", F.lit(None).cast("long")))


def next_documents(docs: DataFrame) -> DataFrame:
    """doc_id, most (code points to take from the next document, at most) and next_id of each distinct doc_id, in descending order; the last is followed by the first.

    Ids alone are range-partitioned; within a partition the next row follows, and each
    partition's first id (one row per partition) is what follows the last of the one before.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.expr("length(coalesce(text, '')) div 2")).cast("long").alias("most"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART))
    dealt = common.written(ids.repartitionByRange(n, F.col("doc_id").desc_nulls_last()).withColumn("part", F.spark_partition_id()), "ids")
    within, parts = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last()), Window.orderBy("part")
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"))  # a row per partition
    first = F.first("head").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = heads.select("part", F.when(F.lead("part").over(parts).isNull(), first).otherwise(F.lead("head").over(parts)).alias("head"))
    linked = dealt.select("*", F.lead("doc_id").over(within).alias("next"), F.lead("part").over(within).isNull().alias("last"))
    return linked.join(F.broadcast(follow), "part").select("doc_id", "most", F.when(F.col("last"), F.col("head")).otherwise(F.col("next")).alias("next_id"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, text, edited of each row: the last half of its code points (rounded down) is replaced by the first as many of the next document's, or all it has.

    The next document is that of the next smaller doc_id (null is the least, the least is followed
    by the largest); if several rows have that id, the one with the least text hash.
    """
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    links = common.written(next_documents(docs), "links").withColumnRenamed("doc_id", "of")
    source = rows.join(links, rows["doc_id"].eqNullSafe(links["next_id"]))
    tails = source.groupBy("of", "next_id").agg(F.min(F.struct(F.xxhash64("text").alias("tkey"), F.expr("substring(text, 1, cast(most as int))").alias("tail"))).alias("given"))
    both = rows.join(tails, rows["doc_id"].eqNullSafe(F.col("of")))
    half = F.expr("cast(length(text) div 2 as int)")
    new = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("given.tail"), F.lit(1), half))
    return both.select("doc_id", "next_id", "text", new.alias("edited"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, efp, next_fp, near: the fingerprints of each row's text, of its edited text and of the next document's, and the search's result."""
    rows = edited(docs).select(
        "doc_id", "next_id",
        F.xxhash64("text").alias("tkey"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        simhash(terms(F.col("text"))).alias("fp"),
        simhash(terms(F.col("edited"))).alias("efp"),
    )
    rows = common.written(rows, "fingerprints")  # each text is hashed once
    following = rows.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("tkey", "fp")).alias("next"))
    return near_counts(rows).join(following, F.col("next_id").eqNullSafe(F.col("id"))).select("doc_id", "n_chars", "edited_sha256", "fp", "efp", F.col("next.fp").alias("next_fp"), "near")


def query(spark, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(common.table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("near").alias("n_near_fingerprints"),
    )
