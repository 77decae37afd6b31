"""Operator 3: benchmark decontamination by size-partitioned MinHash containment search.

Of a document only the shingles that some test item has can count, so its set is first narrowed to
these; what remains is as short as the items it holds. The narrowed sets are partitioned by size,
the items too. For each pair of partitions the containment threshold becomes a Jaccard threshold
at the partitions' upper sizes, and bands of MinHash values are chosen so that a pair at the
threshold is missed with probability MISS at most; where no banding can do that (a document that
holds very many items), the pair of partitions is searched through the items' postings instead.
Candidates are verified by exact containment of the shingles' words.

Words are runs of letters and digits in lower case; shingles have five words, and an item of fewer
words is one shingle of its own length. Items are searched in blocks of about BLOCK items and BYTES
of their text, one block after the other, so neither a task nor the driver holds more of the
benchmark. Where there are several blocks, each one's result is written to the shared folder.

Cases: null and empty texts and items match nothing; very long texts are searched whole; repeated
rows and items are matched each; extra columns are ignored, or kept in filtering, whatever their
names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD = 5, 0.8
PERMUTATIONS, MISS = 128, 1e-6
BLOCK, BYTES = 20_000, 1 << 25


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Hash of each token's lower-case word, where each text begins, the distinct words in lower case and each token's number among them."""
    words, codes, begins = common.words_of(texts)
    lower = pc.utf8_lower(words)
    h = common.hashes_of(lower)
    return (h[codes] if len(codes) else np.zeros(0, np.uint64)), begins, lower, codes


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def miss(j: float, rows: int) -> float:
    return (1 - j**rows) ** (PERMUTATIONS // rows)


class Items:
    """The search structure of a block of items."""

    def __init__(self, item_ids: list[int], texts: list[str | None], threshold: float = THRESHOLD, shingle: int = SHINGLE):
        self.threshold, self.ids, self.words, self.sets, self.sizes_used = threshold, [], [], [], set()
        h, begins, lower, codes = word_hashes(pa.array(texts, pa.string()))
        names = lower.to_pylist()
        rng = np.random.default_rng(20)
        self.mul = rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
        for i, item in enumerate(item_ids):
            own = slice(begins[i], begins[i + 1])
            n = min(shingle, begins[i + 1] - begins[i])
            if not n:
                continue
            w = [names[c] for c in codes[own].tolist()]
            self.ids.append(item)
            self.words.append({" ".join(w[k : k + n]) for k in range(len(w) - n + 1)})
            self.sets.append(common.distinct(shingle_hashes(h[own], int(n))))
            self.sizes_used.add(int(n))
        self.universe = common.distinct(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        at = [np.searchsorted(self.universe, s) for s in self.sets]
        order = np.argsort(np.concatenate(at), kind="stable") if at else np.zeros(0, np.int64)
        self.posting = np.repeat(np.arange(len(at)), [len(a) for a in at])[order] if at else np.zeros(0, np.int64)
        self.posting_at = np.searchsorted(np.concatenate(at)[order] if at else np.zeros(0), np.arange(len(self.universe) + 1))
        self.item_class = np.array([len(s).bit_length() for s in self.sets], np.int64)  # sizes below 2 ** class
        self.bands: dict[int, dict[tuple[int, int], list[int]]] = {}
        signature = [self.signature(s) for s in self.sets]
        for rows in (1, 2, 4, 8):
            table: dict[tuple[int, int], list[int]] = {}
            for i, s in enumerate(signature):
                for b, key in enumerate(self.band_keys(s, rows)):
                    table.setdefault((b, key), []).append(i)
            self.bands[rows] = table

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        return common.mix(shingles[:, None] * self.mul + self.add).min(0)

    def band_keys(self, signature: np.ndarray, rows: int) -> list[int]:
        s = signature.reshape(-1, rows)
        key = np.zeros(len(s), np.uint64)
        for k in range(rows):
            key = common.mix(key ^ s[:, k])
        return key.tolist()

    def rows_for(self, item_class: int, doc_class: int) -> int:
        """Rows of a band for items and documents of these sizes; 0: no banding is sure enough."""
        q, x = 2**item_class - 1, 2**doc_class - 1
        least = max(1, -(-2 ** (item_class - 1) * self.threshold // 1))  # the fewest shared shingles in these classes
        j = min(self.threshold * n / (n + x - self.threshold * n) for n in (2 ** (item_class - 1), q)) if x >= least else 0
        return next((r for r in (8, 4, 2, 1) if 0 < j and miss(min(j, 1.0), r) <= MISS), 0)

    def candidates(self, found: np.ndarray) -> set[int]:
        """Numbers of the items that may be contained; found: the document's places in the universe."""
        doc_class = len(found).bit_length()
        rows = {int(c): self.rows_for(int(c), doc_class) for c in np.unique(self.item_class)}
        out: set[int] = set()
        signature = self.signature(self.universe[found]) if any(rows.values()) else None
        for r in set(rows.values()) - {0}:
            hits = {i for b, key in enumerate(self.band_keys(signature, r)) for i in self.bands[r].get((b, key), ())}
            out |= {i for i in hits if rows[int(self.item_class[i])] == r}
        if 0 in rows.values():
            hits = np.unique(np.concatenate([self.posting[self.posting_at[f] : self.posting_at[f + 1]] for f in found.tolist()]))
            out |= {i for i in hits.tolist() if rows[int(self.item_class[i])] == 0}
        return out

    def search(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Of each text the items it contains: item_id, shared shingles, the item's shingles."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        h, begins, lower, codes = word_hashes(texts)
        hit_docs: dict[int, list[tuple[int, int, int]]] = {}
        for n in sorted(self.sizes_used):
            s = shingle_hashes(h, n)
            at = np.searchsorted(self.universe, s)
            at[at == len(self.universe)] = 0
            place = np.flatnonzero(self.universe[at] == s) if len(s) else np.zeros(0, np.int64)
            doc = np.searchsorted(begins, place, "right") - 1
            ok = place + n <= begins[doc + 1]
            for p, d, a in zip(place[ok].tolist(), doc[ok].tolist(), at[place[ok]].tolist(), strict=True):
                hit_docs.setdefault(d, []).append((p, n, a))
        for d, hits in hit_docs.items():
            some = self.candidates(np.unique(np.array([a for _, _, a in hits])))
            if not some:
                continue
            seen = {" ".join(lower.take(pa.array(codes[p : p + n])).to_pylist()) for p, n, _ in {a: (p, n, a) for p, n, a in hits}.values()}
            for i in sorted(some):
                shared = len(self.words[i] & seen)
                if shared >= self.threshold * len(self.words[i]):
                    out[d].append((self.ids[i], shared, len(self.words[i])))
        return out


HITS = "array<struct<item_id:bigint,shared:bigint,of:bigint>>"


def blocks_of(items: DataFrame, block: int = BLOCK) -> Iterator[tuple[bool, list[int], list[str | None]]]:
    """Whether there are several blocks, and the ids and texts of each; a block is gathered when it is asked for."""
    many, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-many // block), -(-(size or 0) // BYTES))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = part.select(F.col("item_id").cast("long"), "text").collect()
        yield n > 1, [r[0] for r in rows], [r[1] for r in rows]


def searching(ids: list[int], texts: list[str | None], keep: list[str], hits: str, threshold: float, shingle: int):
    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, threshold, shingle)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("of", pa.int64())]))
        for batch in common.sliced(batches):
            found = pa.array([[dict(zip(("item_id", "shared", "of"), x, strict=True)) for x in f] for f in items.search(batch.column("text"))], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], [*keep, hits])

    return run


def searched(docs: DataFrame, ids: list[int], texts: list[str | None], keep: list[str], hits: str, threshold: float, shingle: int) -> DataFrame:
    """keep and, under the name hits, the items of the block that a row contains."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{hits}` {HITS}"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(searching(ids, texts, keep, hits, threshold, shingle), schema)


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment: a row for each item that a row of docs contains to the threshold or more."""
    out = None
    for several, ids, texts in blocks_of(items, block):
        part = searched(docs, ids, texts, ["doc_id"], "hits", threshold, shingle).select("doc_id", F.explode("hits").alias("x"))
        part = common.written(part, "leaks") if several else part
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", F.col("x.item_id"), F.col("x.shared"), F.col("x.of").alias("item_shingles"), (F.col("x.shared") / F.col("x.of")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The rows that contain no item, all columns."""
    out, hits = docs, common.free_name(docs, "hits")
    for several, ids, texts in blocks_of(items, block):
        out = searched(out, ids, texts, docs.columns, hits, threshold, shingle).where(F.size(hits) == 0).drop(hits)
        out = common.written(out, "clean") if several else out
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM documents),
items AS (
  SELECT item_id, list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM benchmark),
item_places AS (SELECT item_id, words, least(5, len(words)) AS n, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS k FROM items WHERE len(words) > 0),
item_shingles AS (SELECT DISTINCT item_id, n, array_to_string(words[k:k + n - 1], ' ') AS shingle FROM item_places),
sizes AS (SELECT item_id, count(*) AS item_shingles FROM item_shingles GROUP BY item_id),
doc_places AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM item_shingles) WHERE len(words) >= n),
doc_shingles AS (SELECT DISTINCT doc_id, n, array_to_string(words[k:k + n - 1], ' ') AS shingle FROM doc_places),
shared AS (SELECT doc_id, item_id, count(*) AS shared FROM doc_shingles JOIN item_shingles USING (n, shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, CAST(item_shingles AS BIGINT) AS item_shingles, shared / item_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE shared * 5 >= item_shingles * 4
"""
