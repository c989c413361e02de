"""A corpus pipeline out of five operators: each stage's result is written as Parquet and read again as the next one's documents.

Quality classifier, exact dedup, n-gram Jaccard join (five words, similarity 0.8 and more),
mixing sources to target weights, byte-level BPE encoding and decoding. All stages but the last return the columns
of documents.

Cases: the operators' docstrings say what becomes of nulls, ties, repeated rows and very long
texts. Copies of a document that mixing makes are rows of their own. In the Jaccard stage one
text of a component stays, one of its smallest doc_id; rows of null doc_id, and texts without
words, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import bpe, exact_dedup, jaccard, mixing, quality_classifier
from chronolake.llm.common import cut, scratch, table
from chronolake.llm.queries import tokenizer_path

WORDS, NUM, DEN = 5, 80, 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_rows(docs, WORDS, NUM, DEN)
    # the texts that go; of a doc_id that has several, each by its own component
    gone = cut(found.where("not stays").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__text")).distinct())
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (jaccard.text_hash() == gone["__text"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs, mixing.PRODUCTION)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: The trained classifier and the tokenizer cannot be stated in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
