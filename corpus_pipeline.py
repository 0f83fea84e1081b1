"""A training corpus from `documents`: toxic documents go, one of each group of near copies stays,
secrets are masked, sources are mixed to their target weights, and what is left is packed.

Every stage gets all rows that its predecessor kept, with the columns of documents, and is
written to the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodequery.llm import mixing, ngram_join, packing, secrets, toxicity
from lodequery.llm.common import materialise, table


#: Near copies of a corpus: sets of five-word shingles at least 80 % alike. The contract of op6_ngram_join (4 words, 85 %) binds only that query.
COPY_WORDS, COPY_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on all documents' labels, doesn't reject. Null and empty texts stay."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_calm(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays. Null and empty texts are no group."""
    return ngram_join.one_of_each(docs, size=COPY_WORDS, percent=COPY_PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars to match."""
    return secrets.redact(secrets.scan(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times or not at all."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack)]

#: Trained models, components and hashed choices aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
