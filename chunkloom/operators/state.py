"""Resumable work: done sets, fingerprints, retries, upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def finished(chunks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks recorded as done with the same frames and size, size above 0. chunks: keys, frames, size_bytes (as found)."""
    return chunks.join(done.where(F.col("size_bytes") > 0).select(*keys, "frames", "size_bytes"), [*keys, "frames", "size_bytes"], "left_semi")


def pending(chunks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.join(done.where(F.col("size_bytes") > 0).select(*keys, "frames", "size_bytes"), [*keys, "frames", "size_bytes"], "left_anti")


@F.pandas_udf(StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a over the UTF-8 bytes, 64 bits as 16 hexadecimal digits; null stays null. All texts of a batch take a byte each step."""
    import numpy as np

    raw = [t.encode("utf-8") for t in text.dropna()]
    order = np.argsort([-len(r) for r in raw], kind="stable")
    size = np.array([len(raw[i]) for i in order], np.int64)
    at = np.cumsum(size) - size
    data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.uint64)
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    for k in range(size[0] if len(size) else 0):
        n = np.searchsorted(-size, -k, "left")  # texts longer than k bytes come first
        h[:n] = (h[:n] ^ data[at[:n] + k]) * np.uint64(0x100000001B3)
    found = np.empty(len(raw), object)
    found[order] = [f"{x:016x}" for x in h.tolist()]
    out = pd.Series([None] * len(text), index=text.index, dtype=object)
    out[text.notna()] = found
    return out


@F.pandas_udf(StringType())
def fit_name(name: pd.Series, suffix: pd.Series) -> pd.Series:
    """The name cut at a character's end so that with the suffix it has 255 bytes at most."""
    return pd.Series([n.encode("utf-8")[: 255 - len(s.encode("utf-8"))].decode("utf-8", "ignore") + s if n is not None and s is not None else None for n, s in zip(name, suffix, strict=True)], dtype=object)


def work_name(stem: Column, prefix: str = "") -> Column:
    """The name of a job's folder: prefix and stem, or these cut and marked with the stem's hash."""
    name = F.concat(F.lit(prefix), stem)
    return F.when(F.octet_length(name) <= 255, name).otherwise(fit_name(name, F.concat(F.lit("-"), fnv1a(stem))))


def backoff(failures: Column, poll: int) -> Column:
    """Seconds until the next try."""
    return (F.lit(poll) * F.least(F.pow(F.lit(2e0), F.least(failures, F.lit(6))), F.lit(60e0))).cast("long")


def is_due(now: Column, due: Column, profile: Column, profile_then: Column) -> Column:
    return due.isNull() | (now >= due) | ~profile.eqNullSafe(profile_then)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The table with rows' versions in place of older ones; seq tells which is newer."""
    both = table.unionByName(rows)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def route(shutting_down: Column, moved: Column, transient: Column, markable: Column) -> Column:
    """Where a failed job goes: back to the queue, or to the failure markers."""
    return F.when(shutting_down | moved | transient | ~markable, "retry").otherwise("failed")


def profile_fingerprint(changed: Column) -> Column:
    """The hash of the changed settings, in order of their names."""
    return fnv1a(F.array_join(F.transform(F.array_sort(F.map_entries(changed)), lambda e: F.concat_ws("=", e["key"], e["value"])), "\n"))


def padded_key(index: Column) -> Column:
    """Five digits from 1 on; longer numbers aren't cut."""
    return F.format_string("%05d", index + 1)
