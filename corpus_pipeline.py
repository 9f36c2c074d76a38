"""From documents to packed training sequences, in five written stages.

Each stage takes the documents that its predecessor kept, all of them, and decides over them as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import shared_dir

#: The stages need trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None

#: Key of the pseudonyms; a user sets a secret of their own.
KEY = "tickloom-demonstration-key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the table of labels, does not reject."""
    from tickloom.llm.toxicity import without_toxic

    return without_toxic(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    from tickloom.llm.exact import deduplicated

    return deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.8 of five-word shingles, the one with the smallest id."""
    from tickloom.llm.minhash import one_per_group

    return one_per_group(docs, shingle=5)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the texts."""
    from tickloom.llm.pii import pseudonymize

    return pseudonymize(docs, KEY).select(*[f"`{c}`" for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    from tickloom.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("personal data", pseudonyms),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
