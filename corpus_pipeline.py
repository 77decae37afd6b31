"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import bpe, common, decontamination, jaccard_links, line_dedup, simhash_dedup, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go."""
    return toxicity.without_toxic(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them; n_chars counts anew."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (by fingerprint, or 4/5 of five-word shingles) the document of the smallest id stays."""
    signed = jaccard_links.signatures(docs)
    return simhash_dedup.one_per_group(docs.select(*COLUMNS), fps=signed.select("doc_id", "th", "fp"), more=jaccard_links.links(docs, signed=signed))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.without_contaminated(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with the hashes of the ids and of the bytes decoded from them."""
    import public_tokenizers

    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: The fitted model and the hash family can't be written in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote meanwhile, and the output of the stage before, is deleted once its own output is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, since = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}", len(common.WRITTEN)
        stage(spark, docs, sf_dir).write.parquet(path)
        common.discard(spark, since)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
