"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written as Parquet and read again.

Defined results: a null, empty or blank text is scored like any other, is nobody's near copy, holds no item and no personal
data, and packs as its end token; rows are judged by their texts, so repeated rows are near copies of each other and rows
without an id or with an id of others are judged alike; columns beside those of documents pass through all stages but the
last, whatever their names; without labels the network stays as it starts, without benchmark items nothing is
contaminated; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depmill.llm import decontamination, jaccard, packing, pii, toxicity
from depmill.llm.scratch import written

#: Near copies of the stage jaccard_join share this part (in hundredths) of their shingles of so many words; op7's own
#: contract (4 words, 85) holds for its query alone.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a network that learns from the labelled ones that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.trained(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, that with the least id."""
    return jaccard.one_of_each(docs, words=WORDS, percent=PERCENT)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced; n_chars is that of the text before."""
    return pii.pseudonymised(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", drop_benchmark_copies),
    ("pii", replace_pii),
    ("packing", pack),
]

#: The stages train a network, tile strings, draw keyed surrogates and encode tokens, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
