"""From raw documents to token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept.

1. Quality rules: documents that the rules reject go.
2. Exact dedup: of equal texts one stays.
3. N-gram Jaccard join (five words, similarity 0.8 or more): of each group of near copies one stays.
4. Mixing: no document goes; the rows, and so the written files, come in the order that
   interleaves the sources by their target weights.
5. Byte-level BPE: token counts and digests of each document's ids and of what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from argloom.llm._spark import cut, table
from argloom.llm.bpe import token_digests
from argloom.llm.cuckoo_dedup import drop_exact_copies
from argloom.llm.jaccard_join import keep_one_of_each
from argloom.llm.pfair_mixing import mix
from argloom.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the mixing nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage keeps is written to the shared folder once, and the next one reads it from there."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
