"""Exact links between documents whose shingle sets have a Jaccard similarity of 4/5 or more.

Prefix filtering: under one order of all shingles, two such sets share one of the first
n - ceil(4n/5) + 1 shingles of each. Any order is exact; shingles found often in a sample come last,
the rest go by hash. Equal sets are one node. In buckets of more than `large` sets all are compared
with one of them first, in ROUNDS rounds, and pairs joined by then are not compared again.
Candidates are first bounded, within the join by BITS bits: a bit is set if a hash falls on it, so a
bit that the other set lacks is a shingle that isn't shared. Then each set comes with the number of
its hashes in each of CELLS cells, and two sets share at most the sum of the lesser numbers. What may still be alike is verified on
whole sets (of 64-bit hashes), made again from the texts in question: a pair sends one text to where
the other is, and a node with very many partners is sent to several places, so no task holds more
than one node's set and a batch of texts.

Cases: null and empty texts have no shingles and no links; a text of fewer words than a shingle is
one shingle; very long texts are read whole; repeated rows are one node; an empty table has no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, decontamination, simhash_dedup

SHINGLE, ROUNDS, HOT = 5, 2, 65_536
#: Pairs (a few longs each) that are broadcast to the texts at most; more are joined by shuffling the texts.
ASKED = 500_000
#: Partners of a node that are compared with it in one place.
PARTNERS = 1000
#: Cells in which a set's hashes are counted, up to 255 in each; sets with a fuller cell aren't bounded.
CELLS = 512
BITS = 256


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of each text's shingles, sorted, each once. Words are those of the fingerprints: runs without blanks, ASCII letters in lower case."""
    plain = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), f"[{simhash_dedup.BLANK}]+", " ")
    plain = pc.utf8_trim(plain, " ")
    lists = pc.split_pattern(plain, " ")
    flat, size = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    flat, size = flat.filter(pa.array(np.repeat(some, size))), np.where(some, size, 0)  # an empty text is split into one empty word
    coded = flat.dictionary_encode()
    lower = pa.array([w.lower() if w.isascii() else w.translate(simhash_dedup.LOWER) for w in coded.dictionary.to_pylist()], pa.large_string())
    h = common.hashes_of(lower)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    ends = np.cumsum(size)
    whole, out = common.mix(decontamination.shingle_hashes(h, shingle)), []
    for begin, end in zip((ends - size).tolist(), ends.tolist(), strict=True):
        n = end - begin
        own = whole[begin : end - shingle + 1] if n >= shingle else common.mix(decontamination.shingle_hashes(h[begin:end], n)[:n])
        out.append(common.distinct(own.view(np.int64)))
    return out


def sets(docs: DataFrame, keep: str) -> DataFrame:
    """keep (a long) and the set of each row."""

    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(shingle_sets(batch.column("text")), pa.list_(pa.int64()))], [keep, "set"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} long, set array<long>")


def cell_counts(hashes: np.ndarray) -> bytes | None:
    """How many of the hashes are in each cell, a byte each; None if one holds more than a byte can say."""
    n = np.bincount(hashes.view(np.uint64).astype(np.int64) & (CELLS - 1), minlength=CELLS)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else None


def bit_set(hashes: np.ndarray) -> np.ndarray:
    """Which of BITS bits the hashes fall on, as longs; other bits of the hashes than those of the cells say where."""
    on = np.zeros(BITS, bool)
    on[(hashes.view(np.uint64) >> np.uint64(32)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(on).view(np.int64)


def may_share(na: Column, nb: Column, a: Column, b: Column) -> Column:
    """Whether two sets of these sizes and bits may be alike enough: what either has beyond the other's bits isn't shared."""
    def beyond(x: Column, y: Column) -> Column:
        parts = [F.bit_count(x[k].bitwiseAND(F.bitwise_not(y[k]))).cast("long") for k in range(BITS // 64)]
        return sum(parts[1:], parts[0])

    return (9 * (na - beyond(a, b)) >= 4 * (na + nb)) & (9 * (nb - beyond(b, a)) >= 4 * (na + nb))


def signing(hot: list[int], shingle: int):
    last = np.array(sorted(hot), np.int64)

    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = pa.int64()
        for batch in common.sliced(batches):
            sid, many, firsts, cells, bits = [], [], [], [], []
            for s in shingle_sets(batch.column("text")):
                late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                sid.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                many.append(len(s))
                cells.append(cell_counts(s))
                bits.append(bit_set(s))
                firsts.append(np.concatenate([s[~late], s[late]])[: len(s) - -(-4 * len(s) // 5) + 1] if len(s) else s)
            fp = pa.array(simhash_dedup.fingerprint_texts(batch.column("text").to_pylist(), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), fp, pa.array(sid, long), pa.array(many, long), pa.array(firsts, pa.list_(long)), pa.array(cells, pa.binary()), pa.array(bits, pa.list_(long))], ["doc_id", "th", "fp", "sid", "n", "prefix", "cells", "bits"])

    return run


def signatures(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, th (the text's hash), fp (of shingles of so many words), sid (the set's hash, null without shingles), n, the set's prefix, its cell counts and bits of each row."""
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    some = sets(texts.where("text is not null and pmod(th, 16) = 0").select("th", "text").distinct(), "th").select(F.explode("set").alias("s")).groupBy("s").count()
    hot = [r.s for r in some.where("count >= 3").orderBy(F.desc("count"), "s").limit(HOT).collect()]
    return common.written(texts.mapInArrow(signing(hot, shingle), "doc_id long, th long, fp long, sid long, n long, prefix array<long>, cells binary, bits array<long>"), "signatures")


def links(docs: DataFrame, large: int = 8, signed: DataFrame | None = None) -> DataFrame:
    """a, b: fingerprints of documents that are linked; with equal fingerprints joined, they give the same components as all pairs of 4/5 or more. signed: the documents' signatures, if there are some already."""
    rows = (signatures(docs) if signed is None else signed).where("sid is not null")
    texts = docs.select(F.xxhash64("text").alias("th"), F.col("doc_id").cast("long"), "text").where("text is not null")
    node = {"fp": F.min("fp"), "n": F.min("n"), "text": F.min(F.struct("th", "doc_id")), "cells": F.min("cells"), "bits": F.min("bits")}
    nodes = common.written(rows.groupBy("sid").agg(*[c.alias(k) for k, c in node.items()]), "nodes")
    # rows of one set may have different fingerprints (another order of words)
    own = rows.select("sid", F.col("fp").alias("a")).distinct().join(common.merged(nodes.select("sid", F.col("fp").alias("b"))), "sid").where("a != b").select("a", "b")
    tokens = rows.groupBy("sid").agg(F.min("n").cast("int").alias("n"), F.min("prefix").alias("prefix")).select(F.explode("prefix").alias("token"), "sid", "n")
    members = common.written(tokens.withColumn("many", F.count("*").over(Window.partitionBy("token"))).where("many > 1"), "members")
    found = common.written(members.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0), "jaccard")
    for k in range(ROUNDS + 1):
        roots = simhash_dedup.components(found).select(F.col("node").alias("sid"), "root")
        now = members.join(common.merged(roots), "sid", "left").withColumn("root", F.coalesce("root", "sid")).join(common.merged(nodes.select("sid", "bits")), "sid")
        if k < ROUNDS:
            # the second round's pivot is of another component than the first's
            wide = now.where(F.col("many") > large)
            first = wide.groupBy("token").agg(F.min("root").alias("least"))
            wide = wide.join(common.merged(first), "token")
            if k:
                wide = wide.where("root != least")
            pivot = wide.groupBy("token").agg(F.min(F.struct("sid", "n", "root", "bits")).alias("p"))
            pairs = wide.join(common.merged(pivot), "token").where("root != p.root").where(may_share(F.col("p.n"), F.col("n"), F.col("p.bits"), F.col("bits")))
            pairs = pairs.select(F.col("p.sid").alias("a"), F.col("sid").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"))
        else:
            left, right = (now.select("token", F.col("sid").alias(x), F.col("n").alias("n" + x), F.col("root").alias("r" + x), F.col("bits").alias("bits" + x)) for x in "ab")
            pairs = left.join(common.merged(right), "token").where("a < b and ra != rb").where(may_share(F.col("na"), F.col("nb"), F.col("bitsa"), F.col("bitsb")))
        pairs = pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = common.written(found.unionByName(verified(common.written(pairs.distinct(), "pairs"), nodes, texts)), "jaccard")
    fp = nodes.select("sid", "fp")
    ends = found.join(common.merged(fp.toDF("a", "fa")), "a").join(common.merged(fp.toDF("b", "fb")), "b").where("fa != fb").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    return ends.unionByName(own).distinct()


@common.released
def comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come as a node's text (kind 0), then its partners' (kind 1): the pairs that are alike enough."""
    now, own = None, np.zeros(0, np.int64)
    for batch in common.sliced(batches):
        a, b, found = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        for k, (kind, other) in enumerate(zip(batch.column("kind").to_pylist(), shingle_sets(batch.column("text")), strict=True)):
            if kind == 0:
                now, own = a[k], other
                continue
            if now != a[k]:
                raise ValueError("a partner came before its node")
            if 9 * len(np.intersect1d(own, other, assume_unique=True)) >= 4 * (len(own) + len(other)):
                found.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in found], pa.int64()) for x in (a, b)], ["a", "b"])


@common.released
def bounding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with sizes and cell counts: those that may share enough."""
    for batch in common.sliced(batches, 4096):
        n = sum(batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
        both = [batch.column(c) for c in ("ca", "cb")]
        known = pc.and_(*(pc.is_valid(c) for c in both)).to_numpy(zero_copy_only=False)
        most = n.copy()
        counts = [np.frombuffer(b"".join(c.filter(pa.array(known)).to_pylist()), np.uint8).reshape(-1, CELLS) for c in both]
        most[known] = np.minimum(*counts).sum(1, dtype=np.int64)
        yield batch.select(["a", "b"]).filter(pa.array(9 * most >= 4 * n))


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose cell counts don't rule them out."""
    counts = nodes.select("sid", "n", "cells")
    both = pairs.join(common.merged(counts.toDF("a", "na", "ca")), "a").join(common.merged(counts.toDF("b", "nb", "cb")), "b")
    return both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(bounding, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are alike enough."""
    pairs = common.written(bounded(pairs, nodes), "close-pairs")
    places = pairs.groupBy("a").agg((F.floor(F.count("*") / PARTNERS) + 1).cast("int").alias("many"))
    whose = nodes.select(F.col("sid").alias("of"), "text.th", "text.doc_id")
    salted = pairs.join(common.merged(places), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("many")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("of"))
    heads = places.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("of"))
    asked = common.written(salted.unionByName(heads).join(common.merged(whose), "of").drop("of"), "asked")
    small = F.broadcast(asked) if asked.count() <= ASKED else common.merged(asked)
    small = small.withColumnsRenamed({"th": "_th", "doc_id": "_id"})
    rows = texts.join(small, (texts["th"] == F.col("_th")) & texts["doc_id"].eqNullSafe(F.col("_id"))).select("a", "b", "salt", "kind", "text")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return dealt.select("a", "b", "kind", "text").mapInArrow(comparing, "a long, b long").distinct()
