"""A corpus preparation pipeline out of the corpus operators; ``run`` applies its stages to ``documents``.

Every stage takes what the one before kept, as a table in the shared folder, and all but the last return the columns of ``documents``:

1. toxicity: documents that score 0.7 or more go;
2. n-gram Jaccard join: of each component of documents that share 80 % of their five-word shingles, the least doc_id stays;
3. PII: identifiers in the text are replaced by their kinds;
4. mixing: documents are repeated or left out so that sources come near their target weights;
5. packing: the pieces of training sequences of 2048 ids.

Empty tables go through every stage and give no pieces. Null ids are kept; null texts count as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from invoicelake.llm import mixing, packing, pii, set_join, toxicity
from invoicelake.llm.common import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels, threshold=0.7)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = set_join.near_duplicate_classes(docs, size=5, percent=80)
    return set_join.without(docs, classes.filter("doc_id <> component_id").select("doc_id"))


def without_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, seq_len=2048)


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("PII", without_identifiers),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: Token ids and learned scores are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        before, docs = docs, work.store(stage(spark, docs, sf_dir))
        work.drop(before)
    pieces = STAGES[-1][1](spark, docs, sf_dir)  # stores what it places
    work.drop(docs)
    return pieces
