"""Operator 8: byte-level BPE by padded numpy matrices.

Pre-tokens of like length form the rows of a padded matrix of ids. In each round every row merges
its leftmost pair of least rank, found in an open-addressing hash table of pairs; the row is then
compacted, and rows without a pair left leave the matrix. Ids are decoded by gathering bytes.

Cases: null is empty (no ids, the hash of nothing); very long texts are encoded whole, and so is a
pre-token of any length; repeated rows are encoded each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .tokenizing import Splitter

NONE = np.int32(2**31 - 1)
KEEP = 300_000
#: Longer pieces are merged alone.
LONG = 192


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pairs:
    """A hash table from a pair of ids to the id of their joined bytes, searched for whole arrays at once."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64(2**bits - 1)
        self.keys, self.values = np.full(2**bits, -1, np.int64), np.full(2**bits, NONE, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self.slot(key)
        while len(key):  # place one key per free slot, the others try the next slot
            free = self.keys[slot] == -1
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            key, value, slot = key[~put], value[~put], (slot[~put] + 1) & self.mask

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the two don't merge or either is missing (-1)."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        key[((left < 0) | (right < 0)).ravel()] = -2
        slot = self.slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1) & (key != -2))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(shape)


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif piece:
                buckets.setdefault(len(piece) if len(piece) <= 8 else 1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            if width > LONG:
                for i in rows:
                    out[i] = self.merge_long(self.of_byte[np.frombuffer(pieces[i], np.uint8)]).astype("<u4").tobytes()
                continue
            for at in range(0, len(rows), 65536):
                part = rows[at : at + 65536]
                size = np.array([len(pieces[i]) for i in part])
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width) < size[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                ids, size = self.merge(ids, size)
                flat = ids[np.arange(width) < size[:, None]].astype("<u4").tobytes()
                end = np.cumsum(size * 4)
                for i, a, b in zip(part, (end - size * 4).tolist(), end.tolist(), strict=True):
                    out[i] = flat[a:b]
        return out

    def merge(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all rows to the end; ids beyond a row's size are -1."""
        done, size = ids.copy(), size.copy()
        rows = np.arange(len(ids))
        rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(1)  # the leftmost of the least
            here = np.arange(len(rows))
            least = rank[here, at]
            left = least == NONE
            if left.any():  # these rows are done
                gone = rows[left]
                done[gone] = -1
                done[gone, : ids.shape[1]] = ids[left]
                rows, ids, rank, at, least = rows[~left], ids[~left], rank[~left], at[~left], least[~left]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            size[rows] -= 1
            width = ids.shape[1] - 1  # compaction: each row loses the place right of the merge
            take = np.arange(width) + (np.arange(width) > at[:, None])
            ids = np.take_along_axis(ids, take, 1)
            ids[here, at] = least
            if width == 1:
                rank = np.full((len(rows), 1), NONE, np.int32)
                continue
            take = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            rank = np.take_along_axis(rank, take, 1)
            for first in (at - 1, at):
                ok = (first >= 0) & (first < width - 1)
                r, c = here[ok], first[ok]
                rank[r, c] = self.pairs.ranks(ids[r, c], ids[r, c + 1])
        return done, size

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row. All places of the least pair merge in one round if no new pair precedes it in rank; else only the leftmost."""
        while len(ids) > 1:
            rank = self.pairs.ranks(ids[:-1], ids[1:])
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            if len(at) > 1:  # of overlapping places, those an even number of steps into a chain
                chain = common.runs(at - np.arange(len(at)))
                begin = np.repeat(chain[:-1], np.diff(chain))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
                before = at[at > 0] - 1
                after = at[at + 2 < len(ids)] + 2
                full = np.full(max(len(before), len(after), 1), least, np.int32)
                new = [self.pairs.ranks(ids[before], full[: len(before)]), self.pairs.ranks(full[: len(after)], ids[after]), self.pairs.ranks(full[:1], full[:1])]
                if min((x.min() for x in new if len(x)), default=NONE) < least:
                    at = at[:1]
            ids = ids.copy()
            ids[at] = least
            ids = np.delete(ids, at + 1)
        return ids

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, gathered from the joined vocabulary."""
        size = self.sizes[ids]
        end = np.cumsum(size)
        place = np.repeat(self.starts[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        return self.joined[place]


class TextEncoder:
    """Texts to ids; pre-tokens seen before are looked up, up to KEEP of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder, self.pieces, self.known = Encoder(ranks), Splitter(pattern), {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self.pieces(t) for t in texts]
        if len(self.known) > KEEP:
            self.known.clear()
        new = list(set().union(*pieces) - self.known.keys())
        self.known.update(zip(new, self.encoder.encode([p.encode("utf-8") for p in new]), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


def encoding(ranks: dict[bytes, int], pattern: str, digest: bool):
    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder(ranks, pattern)
        decode = encode.encoder.decode
        for batch in common.sliced(batches, 256):
            ids = encode(batch.column("text").to_pylist())
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            keys = [c for c in batch.schema.names if c != "text"]
            kept = [batch.column(c) for c in keys]
            if digest:
                sha = [hashlib.sha256(x).hexdigest() for x in ids]
                back = [hashlib.sha256(decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([*kept, n, pa.array(sha), pa.array(back)], [*keys, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*kept, n, pa.array(ids, pa.binary())], [*keys, "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of each row; with digest the hashes of the ids and of the bytes decoded from them instead of ids."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary")
    return docs.select("doc_id", "text").mapInArrow(encoding(read_ranks(ranks_path), pattern, digest), schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text from the ids of encode(). Bytes that aren't UTF-8 become replacement characters."""
    ranks = read_ranks(ranks_path)

    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Encoder(ranks).decode
        for batch in common.sliced(batches):
            text = [gather(np.frombuffer(x or b"", "<u4")).tobytes().decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digest=True)
