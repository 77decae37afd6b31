"""Operator 6: cross-entropy difference of two matched bigram models.

Target and background model share one vocabulary (the corpus's words), one order and one smoothing.
The background model counts all documents, scaled to the target's size; the target model those
labelled as wanted. Words, contexts and word pairs are counted by their text, so what is kept grows
with the corpus. A document's score is the mean over its tokens of target loss minus background
loss: below zero it is more like the target.

Documents are dealt into groups of about GROUP bytes. A group counts its n-grams once and sends them,
packed, to as many buckets; a bucket adds up what the groups sent and answers each with the corpus's
counts in the order they came. No table is broadcast, and none is held whole by a task.

Cases: null and empty texts have no tokens and a score of zero; very long texts are scored whole, and
make their group as large; repeated rows count and are scored each; without target documents the
target model is uniform; extra columns are ignored; an empty table gives an empty result. All rows
of one doc_id are in one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Weight of the unigram model, in counts of the context word.
SMOOTH = 5.0
#: Bytes of text worked on together, and the least that a group is made for.
GROUP, LEAST = 1 << 24, 1 << 18
PACKED = "g int, b int, n int, size int, grams binary, counts binary"
ANSWER = "g int, b int, n int, counts binary, words long, n_target long, n_all long"


def contexts(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    before = np.zeros(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[begins[:-1][np.diff(begins) > 0]] = 0
    return before


class Grams:
    """The distinct n-grams of some texts, in an order that the set of texts settles: words, contexts (a word and a blank), pairs; all of them by bucket.

    A text's begin is the context of an empty word.
    """

    def __init__(self, texts: pa.Array, buckets: int):
        words, codes, self.begins = common.words_of(texts)
        lower = pc.utf8_lower(words).dictionary_encode()
        rank = pc.sort_indices(lower.dictionary)
        place = np.empty(len(rank) + 1, np.int64)
        place[rank.to_numpy()] = np.arange(1, len(rank) + 1)
        ids = place[lower.indices.to_numpy(zero_copy_only=False)[codes]] if len(codes) else np.zeros(0, np.int64)
        self.names = pa.concat_arrays([pa.array([""], pa.large_string()), lower.dictionary.take(rank).cast(pa.large_string())])
        self.ids, self.before, n = ids, contexts(ids, self.begins), len(self.names)
        self.pairs, self.pair_of = np.unique(self.before * n + ids, return_inverse=True)
        self.heads = common.distinct(self.before)
        self.head_of_pair = np.searchsorted(self.heads, self.pairs // n)
        self.word_of_pair = self.pairs % n - 1
        h = common.mix(common.hashes_of(self.names))
        hashes = [h[1:], common.mix(h[self.heads] + np.uint64(1)), common.mix(h[self.pairs // n] * np.uint64(0x9E3779B97F4A7C15) ^ h[self.pairs % n])]
        bucket = (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64)
        self.sizes = (n - 1, len(self.heads), len(self.pairs))
        self.order = np.argsort(bucket, kind="stable")
        self.at = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def texts(self) -> pa.Array:
        """The n-grams by bucket."""
        n, blank = len(self.names), pa.scalar(" ", pa.large_string())
        head = pc.binary_join_element_wise(self.names.take(pa.array(self.heads)), pa.scalar("", pa.large_string()), blank)
        pair = pc.binary_join_element_wise(self.names.take(pa.array(self.pairs // n)), self.names.take(pa.array(self.pairs % n)), blank)
        return pa.concat_arrays([self.names[1:], head, pair]).take(pa.array(self.order))

    def counts(self, some: np.ndarray | slice) -> np.ndarray:
        """How often each n-gram is in the tokens chosen, by bucket."""
        head = np.searchsorted(self.heads, self.before[some])
        own = [np.bincount(x, minlength=k) for x, k in zip((self.ids[some] - 1, head, self.pair_of[some]), self.sizes, strict=True)]
        return np.concatenate(own).astype(np.int64)[self.order]

    def parted(self, counts: np.ndarray) -> list[np.ndarray]:
        """Counts by bucket as those of words, contexts and pairs."""
        out = np.empty(len(counts), float)
        out[self.order] = counts
        return np.split(out, np.cumsum(self.sizes)[:-1])


def packed(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), "zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, "zstd"), np.uint8)


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def counting(buckets: int):
    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        """The n-grams of a group with their counts in its target documents and in all, a row for each bucket."""
        rows: dict[str, list] = {k: [] for k in ("g", "b", "n", "size", "grams", "counts")}
        if docs.num_rows:
            grams = Grams(column(docs, "text"), buckets)
            target = pc.is_in(column(docs, "doc_id"), value_set=column(wanted, "__id"), skip_nulls=True).to_numpy(zero_copy_only=False)
            n_target, n_all = grams.counts(np.repeat(target, np.diff(grams.begins))), grams.counts(slice(None))
            texts = grams.texts()
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) else np.zeros(0, np.uint8)
            g = docs.column("g")[0].as_py()
            for b in np.flatnonzero(np.diff(grams.at)).tolist():
                i, k = int(grams.at[b]), int(grams.at[b + 1])
                text = data[offsets[i] : offsets[k]]
                values = (g, b, k - i, len(text), packed(np.diff(offsets[i : k + 1]).astype(np.int32), text), packed(n_target[i:k], n_all[i:k]))
                for name, v in zip(rows, values, strict=True):
                    rows[name].append(v)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({name: pa.array(v, t) for (name, v), t in zip(rows.items(), kinds, strict=True)})

    return run


def adding(groups: int):
    def run(sent: pa.Table) -> pa.Table:
        """To every group the corpus's counts of the n-grams that it sent, and this bucket's words and tokens."""
        own, n, sizes = (sent.column(c).to_pylist() for c in ("g", "n", "size"))
        raw = [unpacked(x, 4 * k + s) for x, k, s in zip(sent.column("grams").to_pylist(), n, sizes, strict=True)]
        offsets = np.zeros(sum(n) + 1, np.int64)
        np.cumsum(np.concatenate([x[: 4 * k].view(np.int32) for x, k in zip(raw, n, strict=True)]), out=offsets[1:])
        data = np.concatenate([x[4 * k :] for x, k in zip(raw, n, strict=True)])
        coded = pa.Array.from_buffers(pa.large_string(), sum(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        parts = [unpacked(x, 16 * k).view(np.int64).reshape(2, k) for x, k in zip(sent.column("counts").to_pylist(), n, strict=True)]
        whole = np.zeros((2, len(coded.dictionary)), np.int64)
        for m in (0, 1):
            np.add.at(whole[m], codes, np.concatenate([p[m] for p in parts]))
        word = pc.equal(pc.count_substring(coded.dictionary, " "), 0).to_numpy(zero_copy_only=False)
        at, answers = dict(zip(own, np.cumsum([0, *n[:-1]]).tolist(), strict=True)), []
        many = dict(zip(own, n, strict=True))
        for g in range(groups):
            c = codes[at[g] : at[g] + many[g]] if g in at else codes[:0]
            answers.append(packed(whole[0][c], whole[1][c]))
        full = lambda v, t: pa.array(np.full(groups, v), t)
        return pa.table(
            {
                "g": pa.array(range(groups), pa.int32()),
                "b": full(sent.column("b")[0].as_py(), pa.int32()),
                "n": pa.array([many.get(g, 0) for g in range(groups)], pa.int32()),
                "counts": pa.array(answers, pa.binary()),
                "words": full(word.sum(), pa.int64()),
                "n_target": full(whole[0][word].sum(), pa.int64()),
                "n_all": full(whole[1][word].sum(), pa.int64()),
            }
        )

    return run


def losses(grams: Grams, counts: np.ndarray, words: int, tokens: int, scale: float) -> np.ndarray:
    """Each distinct pair's loss (nats) under a model; counts by bucket, all taken times scale."""
    word, head, pair = (x * scale for x in grams.parted(counts))
    likely = (word + 1) / (tokens * scale + words)
    return -np.log((pair + SMOOTH * likely[grams.word_of_pair]) / (head[grams.head_of_pair] + SMOOTH))


def scoring(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """A group's documents with their scores."""
        grams = Grams(column(docs, "text") if docs.num_rows else pa.array([], pa.string()), buckets)
        counts = np.zeros((2, len(grams.order)), np.int64)
        given = np.zeros(buckets, np.int64)
        for b, n, data in zip(*(answers.column(c).to_pylist() for c in ("b", "n", "counts")), strict=True):
            given[b] += n
            if docs.num_rows and n:
                counts[:, grams.at[b] : grams.at[b + 1]] = unpacked(data, 16 * n).view(np.int64).reshape(2, n)
        if docs.num_rows and (given != np.diff(grams.at)).any():
            raise ValueError("a group's documents have changed between counting and scoring")
        words, n_target, n_all = (pc.sum(answers.column(c)).as_py() or 0 for c in ("words", "n_target", "n_all"))
        size = np.diff(grams.begins)
        doc = np.repeat(np.arange(len(size)), size)
        scale = min(1.0, n_target / max(1, n_all)) or 1.0  # the background counts as if it were as large as the target
        of = [losses(grams, counts[m], words, (n_target, n_all)[m], (1.0, scale)[m]) for m in (0, 1)] if len(doc) else [np.zeros(0)] * 2
        target, background = (np.bincount(doc, x[grams.pair_of], len(size)) / np.maximum(size, 1) for x in of)
        return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": size, "target_loss": target, "background_loss": background, "score": target - background})

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, group: int = GROUP, least: int = LEAST) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference) of each row; target_ids has doc_id."""
    kind = dict(docs.dtypes)["doc_id"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-size // group), min(tasks, -(-size // least)))
    # a null id is no target, so its rows may be in any group
    dealt = lambda h: F.pmod(h, F.lit(groups)).cast("int").alias("g")
    whole = docs.select(dealt(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))), "doc_id", "text")
    wanted = target_ids.select(F.col("doc_id").cast(kind).alias("__id")).where("__id is not null").distinct().select(dealt(F.xxhash64("__id")), "__id")
    sent = whole.groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(counting(groups), PACKED)
    answers = sent.groupBy("b").applyInArrow(adding(groups), ANSWER)
    return whole.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(scoring(groups), f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return cross_entropy_difference(docs, labels.where(F.col("quality") == 1))
