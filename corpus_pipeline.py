"""From raw documents to token ids: five stages, each on all that its predecessor kept.

1. `quality`: documents that the quality rules reject go; of the others, lines that stand in very many
   documents of the host are removed.
2. `near_duplicates`: of each group of documents linked by similar 5-word shingles, the one with the smallest id stays.
3. `personal_data`: spans of personal data and keys are replaced by their kind.
4. `mixing`: documents are dropped or repeated until the sources have their target weights.
5. `tokens`: texts become ids of a byte-level BPE vocabulary; the decoded bytes are reported as a digest.

Each function takes `(spark, docs, sf_dir)`; all but the last return the columns of `documents`. `run` writes every
stage as Parquet into the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cribado.llm import bpe, mixing, personal, quality, shingles
from cribado.session import materialize

#: Rank file of the vocabulary.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are frequent in their host. NULL and empty texts do not pass;
    equal rows and rows without ids are judged each; an empty table stays empty, and columns keep names and order."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by shingles, the one of the smallest id (of equal or no ids, the first stored). Rows
    without words are linked with nothing and stay; an empty table stays empty, and columns keep names and order."""
    return shingles.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and keys replaced by their kind, trained on all rows it gets. NULL and empty texts, equal rows and rows
    without ids stay as they are; an empty table stays empty, and columns keep names and order."""
    return personal.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target takes it, none or twice included. NULL texts have no words and go; rows without ids
    count by themselves; an empty table stays empty, and columns keep names and order."""
    return mixing.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `n_tokens`, digests and `ids` per row; repeated rows, NULL ids and NULL texts (no ids) stay, an empty table
    gives none."""
    return bpe.encode_and_decode(docs, VOCABULARY, keep_ids=True)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

#: SQL cannot express sampling by prefix sums in this order, nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs) if number < len(STAGES) else docs
    return docs
