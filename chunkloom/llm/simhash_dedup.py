"""Operator 4: SimHash near-dedup by segment popcounts.

Fingerprints are embedded as the bit counts of SEGMENTS two-bit segments. Bits that differ change
counts by as much in sum, so the Manhattan distance of two count vectors is at most the Hamming
distance. The grid: the segments form `blocks` blocks; vectors within Manhattan distance r differ
in at most r blocks, so they lie in one cell of at least one grid whose axes are blocks - r of the
blocks. Pairs that share a cell are tested by Manhattan distance, then by Hamming distance.

Equal fingerprints are joined before; a group of very many is joined to its id by broadcast. Within a cell only links that join groups are returned (no
more than there are fingerprints), so a large group of near copies gives a forest, not all pairs.
A cell of more than `cell_limit` fingerprints is cut into parts, and each pair of parts is a task's
work, so no task holds an unbounded cell. Components come from large-star and small-star rounds,
each written to the shared folder.

Cases: null and empty texts have fingerprint zero and are linked as any other; a text of fewer
words than a shingle is one shingle; very long texts are counted in stretches; repeated rows share a
component and are returned each; a null doc_id takes part but names no component; extra columns are
ignored, or kept in filtering, whatever their names; empty tables are fine.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(f"[^{BLANK}]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LANES = np.uint64(0x0001000100010001)
#: Shingles counted in 16-bit lanes before these are opened.
STRETCH = 32_768
HALF = 0x5555555555555555
SEED = 42


def fingerprint_texts(texts: list[str | None], shingle: int = 4) -> np.ndarray:
    """The fingerprint of each text: a bit is set if it is set in over half of the shingles' hashes."""
    hashes: list[int] = []
    count = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = WORD.findall((text or "").translate(LOWER) if text and not text.isascii() else (text or "").lower())
        if not words:
            continue
        raw = [w.encode("utf-8") for w in words]
        line = b" ".join(raw)
        n = max(1, len(raw) - shingle + 1)
        count[k] = n
        if n == 1:
            hashes.append(digest(line, SEED))
            continue
        begin = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1, out=begin[1:])
        ends = (begin[shingle:] - 1).tolist()
        hashes += [digest(line[a:b], SEED) for a, b in zip(begin[: n].tolist(), ends, strict=True)]
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    h = np.array(hashes, np.uint64)
    # stretches: each text's shingles, cut where lanes would overflow
    pieces = -(-count[some] // STRETCH)
    of = np.repeat(np.arange(len(some)), pieces)
    first = np.repeat(np.cumsum(count[some]) - count[some], pieces) + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
    votes = np.zeros((len(some), 64), np.int64)
    for j in range(16):
        packed = np.add.reduceat((h >> np.uint64(j)) & LANES, first)
        for lane in range(4):
            np.add.at(votes[:, j + 16 * lane], of, ((packed >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    out[some] = ((votes * 2 > count[some, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, th (the text's hash) and fp (long) of each row."""

    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            fp = pa.array(fingerprint_texts(batch.column("text").to_pylist(), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), fp], ["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


def popcounts(fp: Column) -> Column:
    """The 32 segment counts, two bits each, in one long."""
    first, second = fp.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(HALF))
    return first.bitwiseXOR(second).bitwiseOR(F.shiftleft(first.bitwiseAND(second), 1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed counts (0, 1 or 2 in each field)."""
    x = a ^ b  # 01: differs by one; 10: by two; 11 (one and two): by one
    low = x & np.uint64(HALF)
    return np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count((x >> np.uint64(1)) & np.uint64(HALF) & ~low)


def embed(fp: np.ndarray) -> np.ndarray:
    return (fp & np.uint64(HALF)) + ((fp >> np.uint64(1)) & np.uint64(HALF))


def grid_masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks - radius blocks of segments, the mask of their counts."""
    if not radius < blocks <= 32:
        raise ValueError("there must be more blocks than differing bits, and at most 32")
    cuts = [32 * i // blocks for i in range(blocks + 1)]
    each = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(each, blocks - radius)]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the groups of a and b; each group's root is its least member."""
    while True:
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            return parent
        np.minimum.at(parent, high, low)
        parent = _roots(parent)


def cell_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by cell: a forest that joins what links within the radius join inside each cell. Rows are compared with those so many places on; after 1, 2, 4 ... places, cells that are one group by then are left alone."""
    n = len(fp)
    parent = np.arange(n)
    counts = embed(fp)
    at = np.arange(n)
    begin = common.runs(cell)
    step, check = 1, 2
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> np.ndarray:
        nonlocal held, size
        found = _join(parent, np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])) if held else parent
        held, size = [], 0
        return found

    while len(at := at[at + step < n]) and len(at := at[cell[at] == cell[at + step]]):
        near = at[manhattan(counts[at], counts[at + step]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= radius]
        if len(near):
            held.append((near, near + step))
            size += len(near)
        if size > 1_000_000 or step == check:
            parent = joined()
            if step == check:
                check *= 2
                whole = np.maximum.reduceat(parent, begin[:-1]) == np.minimum.reduceat(parent, begin[:-1])
                at = at[~np.repeat(whole, np.diff(begin))[at]]
        step += 1
    parent = joined()
    inner = np.flatnonzero(parent != np.arange(n))
    return fp[parent[inner]], fp[inner]


def linking(radius: int, most: int = 1 << 18):
    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by cell; whole cells are worked on together."""
        cells, fps, held = [], [], 0

        def flush(last: bool):
            nonlocal cells, fps, held
            cell, fp = np.concatenate(cells), np.concatenate(fps)
            cut = len(cell) if last else int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
            a, b = cell_links(cell[:cut], fp[:cut].view(np.uint64), radius)
            cells, fps, held = [cell[cut:]], [fp[cut:]], len(cell) - cut
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cells.append(batch.column("cell").to_numpy(zero_copy_only=False))
            fps.append(batch.column("fp").to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held > most:
                yield flush(False)
        if held:
            yield flush(True)

    return run


#: Cells are counted by so many buckets first; those of full buckets are then counted one by one.
BUCKETS = 65_536


def large_cells(cells: DataFrame, cell_limit: int) -> DataFrame | None:
    """cell, n of the cells of more than cell_limit rows, or None if there are none. Nearly all cells have one row, so a count of each would hold them all."""
    bucket = F.pmod("cell", F.lit(BUCKETS)).alias("bucket")
    full = common.written(cells.groupBy(bucket).agg(F.count("*").alias("n")).where(F.col("n") > cell_limit).select("bucket"), "full-buckets")
    if full.isEmpty():
        return None
    large = cells.select("cell", bucket).join(F.broadcast(full), "bucket").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_limit)
    large = common.written(large, "large-cells")
    return None if large.isEmpty() else large


def links(fps: DataFrame, radius: int = 4, blocks: int = 7, cell_limit: int = 65_536) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that give the same components as all pairs within the radius."""
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m - (1 << 64) if m >> 63 else m).alias("m")) for t, m in enumerate(grid_masks(radius, blocks))])
    rows = fps.select("fp", popcounts(F.col("fp")).alias("counts"), F.explode(masks).alias("x"))
    cells = rows.select(F.xxhash64(F.col("counts").bitwiseAND(F.col("x.m")), "x.t").alias("cell"), "fp")
    run, schema = linking(radius), "a long, b long"

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, schema)

    large = large_cells(cells, cell_limit)
    if large is None:
        return dealt(cells).distinct()
    usual = dealt(cells.join(F.broadcast(large), "cell", "left_anti"))
    # a large cell: n parts; a row meets its own part and every other, each pair of parts being a cell of its own
    parts = F.ceil(F.col("n") / F.lit(cell_limit / 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    wide = cells.join(F.broadcast(large.select("cell", parts.alias("parts"))), "cell").withColumn("mine", mine)
    wide = wide.select("cell", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    wide = wide.select(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "fp")
    return usual.unionByName(dealt(wide)).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root of every node on an edge (a, b): root is the least node that can be reached.

    Large-star and small-star rounds by turns; each halves the way to the root, and every round is
    written to the shared folder.
    """
    least, greatest = F.least("a", "b"), F.greatest("a", "b")
    now = common.written(edges.where(F.col("a") != F.col("b")).select(greatest.alias("a"), least.alias("b")).distinct(), name)
    before = None
    while before != (state := now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()):
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(common.merged(root, state.n), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(common.merged(low, state.n), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = common.written(small.where(F.col("a") != F.col("b")).distinct(), name)
    star = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return star.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Groups that hold more than this share of all fingerprints are few enough to be broadcast.
GROUPS = 4096


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 7, cell_limit: int = 65_536, more: DataFrame | None = None, fps: DataFrame | None = None) -> DataFrame:
    """doc_id, th, fp, component_id of each row: the smallest doc_id that links within the radius, or more links between fingerprints (a, b), reach. fps: the rows' doc_id, th and fp, if there are some already."""
    fps = common.written(fingerprints(docs, shingle), "fps") if fps is None else fps
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = links(classes, radius, blocks, cell_limit)
    found = components(common.written(linked if more is None else linked.unionByName(more), "links"))
    joined = common.written(classes.join(common.merged(found), classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = common.written(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "groups")
    bar = joined.count() // GROUPS + 1  # fewer than GROUPS groups can be as large
    wide = F.broadcast(ids.where(F.col("n") >= bar).drop("n"))
    narrow = joined.join(wide.select("root"), "root", "left_anti").join(common.merged(ids.where(F.col("n") < bar).drop("n")), "root")
    per_class = joined.join(wide, "root").unionByName(narrow).select("fp", "component_id")
    return fps.join(common.merged(per_class), "fp").select("doc_id", "th", "fp", "component_id")


def one_per_group(docs: DataFrame, **how) -> DataFrame:
    """The rows of the smallest doc_id of each group, all columns; rows with a null doc_id stay. Of rows that share a doc_id only those go that are in a group with a smaller one."""
    name = common.free_name(docs, "gone")
    gone = near_duplicates(docs, **how).where(F.col("doc_id") != F.col("component_id")).select("doc_id", "th").distinct().select(F.struct("*").alias(name))
    return docs.join(gone, (F.col("doc_id") == F.col(f"{name}.doc_id")) & (F.xxhash64("text") == F.col(f"{name}.th")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
