"""A corpus pipeline over ``documents``: toxicity, quality, near duplicates, personal data, packing.

Each stage takes what its predecessor kept and applies its decisions to all of it. What a stage returns is written
to the shared folder and read again, so that a lost executor costs one stage's work at most.

Defined results of every stage: documents may have null or repeated ids, null or empty texts and nulls in any other
column; further columns of the input are dropped. Toxicity and quality treat a null text like an empty one. Near
duplicates keep the smallest id of each group (a null id only if the group has no other), once where id and text
repeat, and every document without words. Personal data leaves texts without spans as they are, null included. Packing
takes a null text for an empty one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import neardup, packing, pii, quality, toxicity
from millrace.llm.common import new_path, table
from millrace.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all, if there is nothing to learn from."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs.select(*COLUMNS)
    return quality.classify(docs, model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, 0.8).

    Rows are told apart by id and text, so that near copies under one id are decided each; rows alike in both stay once.
    """
    text = F.coalesce("text", F.lit(""))
    own = F.struct(F.col("doc_id").isNull().alias("without"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("text"), F.col("text").isNull().alias("empty"))
    docs = docs.select(*COLUMNS, own.alias("own"))
    found = neardup.dedup(docs.select("own", "text"), "own")
    kept = found.where("kept").groupBy("own").agg(F.count("*").alias("rows"))
    docs = docs.join(kept, "own")
    once = docs.where("rows = 1").select(*COLUMNS)
    return once.unionByName(docs.where("rows > 1").dropDuplicates(["own"]).select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind in brackets."""
    found = pii.find(docs, COLUMNS)
    text = F.when(F.size("spans") > 0, pii.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    n_chars = F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, "doc_id", "text", packing.Packing(tokenizer("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
#: Learned scores and tokenizers have no SQL: tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
