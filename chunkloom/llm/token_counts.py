"""Operator 2: token counts without token ids.

Each slice of documents is split into pre-tokens; every distinct pre-token's pieces are counted
once, the counts are joined to the documents' pre-token frequencies, and the products are summed.
The distinct pre-tokens are those of a task, not of the corpus: a table of (document, pre-token)
over the whole corpus is larger than the corpus, and shuffling it would take more disk than the
texts. Counts of a task's earlier slices are kept, up to KEEP pre-tokens. Texts of any script are
split, with stand-ins for characters that libraries class differently (tokenizing.py).

Cases: null is empty, with 0 tokens; very long texts are counted whole; a special token's string
inside a text is one token, as the library does by default; repeated rows are counted each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokenizing import Splitter, tokenizer

KEEP = 300_000


def counting(blob: bytes, pattern: str, specials: list[str]):
    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokenizer(blob)
        split = Splitter(pattern)
        parts = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        pieces: dict[str, int] = {}
        for batch in common.sliced(batches):
            texts = batch.column("text").to_pylist()
            n_special, frequency = [0] * len(texts), []
            for i, text in enumerate(texts):
                between = parts.split(text) if text and parts and parts.search(text) else [text]
                n_special[i] = len(between) - 1
                frequency.append(Counter(split(text)) if len(between) == 1 else Counter(p for part in between for p in split(part)))
            if len(pieces) > KEEP:
                pieces.clear()
            new = list(set().union(*frequency) - pieces.keys())
            for p, e in zip(new, library.encode_batch(new, add_special_tokens=False), strict=True):
                pieces[p] = len(e.ids)
            count = [k + sum(n * pieces[p] for p, n in f.items()) for k, f in zip(n_special, frequency, strict=True)]
            n_bytes = [len(t.encode("utf-8")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(count, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of each row. The tokenizer is a byte-level BPE file whose pre-tokens follow public_tokenizers.PATTERN."""
    import json

    import public_tokenizers

    with open(tokenizer_path, "rb") as f:
        blob = f.read()
    specials = [t["content"] for t in json.loads(blob)["added_tokens"]]
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(counting(blob, public_tokenizers.PATTERN, specials), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
