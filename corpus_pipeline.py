"""A corpus from quality filter to token ids: each stage works on all that the one before it kept.

In every stage null texts and null doc_ids, empty and very long texts, repeated rows and empty tables are as its operator
defines them; extra columns go with their rows up to the last stage, which returns ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readdup.llm import bpe, jaccard, mixing, quality, repeats
from readdup.llm.common import documents, stored


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored like all others."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, machine, column="_score").where(F.col("_score") >= quality.THRESHOLD).drop("_score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard 0.8 on five-word shingles connect; those without words are in no group and stay."""
    return jaccard.one_of_each(docs, 5, 80, 100)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that documents with smaller doc_ids have; null texts become empty, characters that a cut halves go."""
    kept = repeats.remove_repeats(docs, as_text=True)
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them, to the next whole number; those without words are not taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document of the mix, as often as it stands there."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]
#: Trained scores, byte strings and merges have no SQL; tests hold every stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next one."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
