"""Operator 7: token ids in files of byte or bit planes.

A segment holds the ids of whole documents, cut into blocks of a fixed number of ids. Each block's
ids are transposed into planes (one per byte, or per bit), each plane is compressed with zstandard,
and an index says where each block's planes are. A file of the table is what one task wrote: a row
per segment, so Spark's commit protocol also covers lost executors and speculative tasks.

Segment: magic (8 bytes); kind of plane, ids per block, documents, ids, blocks (5 unsigned 64-bit);
size of the packed document index (unsigned 64-bit) and that index (ids, then token counts, 64-bit
each, zstandard); the block index (for each block and plane the size of its packed bytes, unsigned
32-bit); the packed planes. All numbers are little-endian.

Cases: null is empty (the end id only); documents with one id keep their order by text hash;
a null doc_id comes first; an empty table gives an empty result; extra columns are ignored; a
document of any length stays in one segment.
"""

from __future__ import annotations

import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokenizing import LATIN, tokenizer

MAGIC = b"PLANES\x01\x00"
#: Chunks and words in each of the two generations that an encoder remembers.
KEEP = 400_000
#: Fixed value: the split pattern of the word-end BPE file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII characters that are a word after letters.
MARKS = frozenset(string.punctuation)
#: The ASCII characters that LATIN leaves out.
NOT_ALL_BLANK = "\x1c\x1d\x1e\x1f"
WIDTH = {"byte": 4, "bit": 32}
#: Stored bytes of the documents that are meant for a file.
PART_BYTES = 1 << 27


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def pack(doc_ids: list[int | None], ids: list[bytes], kind: str = "byte", block: int = 65536) -> bytes:
    """A segment of these documents; ids are little-endian unsigned 32-bit."""
    press = zstandard.ZstdCompressor(level=3).compress
    every = np.frombuffer(b"".join(ids), "<u4")
    known = np.array([x is not None for x in doc_ids], bool)
    docs = press(np.r_[np.array([x or 0 for x in doc_ids], "<i8"), np.array([len(x) // 4 for x in ids], "<i8"), known.astype("<i8")].tobytes())
    packed = [press(p) for at in range(0, len(every), block) for p in planes_of(every[at : at + block], kind)]
    head = struct.pack("<5Q", list(WIDTH).index(kind), block, len(ids), len(every), -(-len(every) // block))
    return b"".join([MAGIC, head, struct.pack("<Q", len(docs)), docs, np.array([len(p) for p in packed], "<u4").tobytes(), *packed])


def unpack(segment: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document of a segment, in order."""
    if segment[:8] != MAGIC:
        raise ValueError("not a segment of planes")
    kind_no, block, n_docs, n_ids, n_blocks = struct.unpack_from("<5Q", segment, 8)
    kind = list(WIDTH)[kind_no]
    (n,) = struct.unpack_from("<Q", segment, 48)
    at = 56 + n
    open_ = zstandard.ZstdDecompressor().decompress
    doc_ids, counts, known = np.frombuffer(open_(segment[56:at]), "<i8").reshape(3, n_docs)
    width = WIDTH[kind]
    sizes = np.frombuffer(segment, "<u4", n_blocks * width, at)
    at += 4 * n_blocks * width
    ids = np.zeros(n_ids, "<u4")
    for b in range(n_blocks):
        planes = []
        for size in sizes[b * width : (b + 1) * width].tolist():
            planes.append(open_(segment[at : at + size]))
            at += size
        here = min(block, n_ids - b * block)
        ids[b * block : b * block + here] = from_planes(planes, here, kind)
    end = np.cumsum(counts)
    for i in range(n_docs):
        yield (int(doc_ids[i]) if known[i] else None), ids[end[i] - counts[i] : end[i]]


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: visible Latin-1 letters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 0x100 + k for k, b in enumerate(rest)}


class Known(dict):
    """Ids of chunks and of words (a word is a chunk that isn't split); those not known yet are taken from the older ones, or asked of the encoder and kept."""

    def __init__(self, ask, older: dict[str, bytes]):
        super().__init__()
        self.ask, self.older = ask, older

    def __missing__(self, c: str) -> bytes:
        if (found := self.older.get(c)) is None:
            found = self.ask(c)
        self[c] = found
        return found


class WordEncoder:
    """Texts to ids as the library gives them; chunks between white space and the words in them are looked up in two generations of about KEEP."""

    def __init__(self, blob: bytes):
        import json

        self.library, self.split = tokenizer(blob), regex.compile(WORD_PATTERN).findall
        rules = json.loads(blob)
        pattern = json.dumps(rules.get("pre_tokenizer"))
        if json.dumps(WORD_PATTERN) not in pattern or "</w>" not in json.dumps(rules["model"].get("end_of_word_suffix")):
            raise ValueError("this tokenizer splits words in another way than WORD_PATTERN")
        self.specials = [t["content"] for t in rules["added_tokens"]]
        self.model, self.visible = self.library.model, byte_letters()
        self.raw = [struct.pack("<I", k) for k in range(self.library.get_vocab_size())]
        self.known = Known(self.ask, {})

    def word(self, w: str) -> bytes:
        """The ids of one word: it is normalised and split already, so the library's model alone is asked."""
        letters = w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(self.visible)  # visible ASCII letters stand for themselves
        raw = self.raw
        return b"".join([raw[p.id] for p in self.model.tokenize(letters)])

    def ask(self, c: str) -> bytes:
        """The ids of a chunk that isn't known."""
        if c.isalpha():
            return self.word(c)
        if c[-1] in MARKS and c[:-1].isalpha():
            return self.known[c[:-1]] + self.known[c[-1]]
        words = self.split(c)
        return self.word(c) if words == [c] else b"".join(map(self.known.__getitem__, words))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self.known) > KEEP:
                older, self.known = self.known, Known(self.ask, self.known)
                older.older = {}  # else no generation would ever go
            if not text:
                out.append(b"")
            elif any(s in text for s in self.specials) or not (LATIN.fullmatch(text) if not text.isascii() else not any(s in text for s in NOT_ALL_BLANK)):
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join(map(self.known.__getitem__, unicodedata.normalize("NFC", text).lower().split())))
        return out


def writing(blob: bytes, end_id: int, kind: str, block: int, segment_ids: int):
    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, end = TaskContext.get().partitionId(), WordEncoder(blob), np.array([end_id], "<u4").tobytes()
        doc_ids, ids, held, before = [], [], 0, 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([pack(doc_ids, ids, kind, block)], pa.binary())],
                ["part", "first", "n_ids", "segment"],
            )

        for batch in common.sliced(batches, 256):
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                doc_ids.append(doc_id)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= segment_ids:
                    yield segment()
                    doc_ids, ids, held, before = [], [], 0, before + held
        if doc_ids:
            yield segment()

    return run


@common.released
def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.sliced(batches, 1):
        at = batch.column("start")[0].as_py()
        found = list(unpack(batch.column("segment")[0].as_py()))
        n = np.array([len(x) for _, x in found], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in found], pa.int64()), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for _, x in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())],
            ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
        )


def without_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in reading(batches):
        yield batch.drop_columns(["ids"])


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, kind: str = "byte", block: int = 65536, segment_ids: int = 1 << 18) -> None:
    """Encode the documents in ascending doc_id order and write their ids to path."""
    with open(tokenizer_path, "rb") as f:
        blob = f.read()
    order = ["doc_id", "__t"]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), common.stored_bytes(docs) // PART_BYTES)
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("__t")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = dealt.select("doc_id", "text").mapInArrow(writing(blob, end_id, kind, block, segment_ids), "part int, first long, n_ids long, segment binary")
    rows.write.option("compression", "uncompressed").option("parquet.block.size", str(32 << 20)).parquet(path)


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of each document, from the files alone."""
    segments = spark.read.schema("part int, first long, n_ids long, segment binary").parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # a row for each file, so one task orders them and they can be broadcast
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("first")).alias("start"), "segment")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return placed.mapInArrow(reading, schema + ", ids binary") if with_ids else placed.mapInArrow(without_ids, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read(spark, path, with_ids=False)
