"""Shared pieces: the shared folder, table reading, word codes for Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents, and bytes of their text, worked on together inside a Python worker; bounds its memory whatever Arrow sends.
SLICE, SLICE_BYTES = 512, 1 << 23


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chunkloom-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


#: Paths of the tables that this process has written, in order.
WRITTEN: list[str] = []


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to a table in the shared folder and read it again: this cuts lineage and survives lost executors. discard() deletes such tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever kind it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession, since: int) -> None:
    """Delete the tables written since len(WRITTEN) was so; their readers must be done."""
    while len(WRITTEN) > since:
        delete(spark, WRITTEN.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_bytes(df: DataFrame) -> int:
    """About how many bytes df's files have, from their listing alone; 0 where Spark doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


#: Rows of a table that Spark may broadcast if it wants to.
SENT = 100_000


def merged(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, joined by sorting both sides; by Spark's choice if it has few rows. Spark's estimates of size know neither compression nor explode, so tables that it takes for small can be too large for the driver."""
    return df if rows is not None and rows <= SENT else df.hint("merge")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has a column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, and of at most so many bytes of text unless one row has more."""
    for batch in batches:
        if text in batch.schema.names:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        else:
            ends = np.zeros(batch.num_rows, np.int64)
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = max(at + 1, min(at + rows, most))
            yield batch.slice(at, end - at)
            at = end


def release() -> None:
    """Give memory that isn't used back to the system, as far as the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; what it held goes back to the system at its end, as a Python worker stays for the tasks that follow and would hold it beside theirs."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, as runs of letters and digits: distinct words, the code of each word in order, and where each text's words begin (one more than there are texts). Null texts have no words."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(plain, r"[^\p{L}\p{N}]+", " "))
    lists = pc.split_pattern(plain, " ")
    flat = pc.list_flatten(lists)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    if not some.all():  # an empty text is split into one empty word
        keep = np.repeat(some, sizes)
        flat, sizes = flat.filter(pa.array(keep)), np.where(some, sizes, 0)
    coded = flat.dictionary_encode()
    begins = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=begins[1:])
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), begins


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    from pandas.util import hash_array

    return hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of a well-known public hash)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)]
