"""A corpus pipeline of five stages; each gets what its predecessor kept and returns the columns of documents, the last one the digests of the encoded texts.

1. toxicity: documents that score 0.5 or more go.
2. line dedup: boilerplate lines of each source go; documents stay, those of nothing but boilerplate whole, as they are copies that the next stage thins.
3. near copies: links at a similarity of 0.80 of the sets of five-word runs (op5 links at 0.85); of each component the document of the smallest id stays; documents without words stay.
4. decontamination: documents that hold eight words in a row of a benchmark item, or windows of two items, go.
5. byte-level BPE: encoded and decoded; ids and bytes as digests.

ORACLE_SQL is None: a trained classifier and the tokenizer have no SQL form; tests compare the stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from intervalia.llm import bpe, decontam, linededup, nearcopy, toxicity
from intervalia.llm.common import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(*toxicity.training_rows(docs, table(spark, sf_dir, "labels"), toxicity.held_in()))
    return toxicity.keep(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean(docs, spare=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopy.keep_one(docs, nearcopy.SHINGLE_SHARE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("byte_bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpointed(docs) if k else docs, sf_dir)
    return docs
