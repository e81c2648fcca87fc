"""From raw documents to packed training sequences, in stages.

Each stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollspark.llm import decontam, jaccard_trie, langid, packing, pseudonyms
from rollspark.llm.common import table
from rollspark.session import checkpoint_dir

#: A text whose n-grams lie this far from every language is in none of them.
LEAST_FIT = 0.2
PSEUDONYM_KEY = "rollspark"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the labelled documents teach; null, letterless and unfitting texts go."""
    out = langid.identify(docs, langid.learn(docs), keep=tuple(docs.columns), pred="__lang", score="__fit")
    return out.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__fit") >= LEAST_FIT)).drop("__lang", "__fit")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (one without an id only if none has one) of each group linked by five-word shingles at 0.8; of repeated rows one.

    Rows are told apart by id and text, so another text with the same id stays.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    groups = jaccard_trie.linked_components(keyed, doc_id="__key", n=5, percent=80).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("__key").alias("key"))
    first = (groups.join(keyed.select("__key", "doc_id").distinct(), "__key")
             .groupBy("component_id").agg(F.min(rank).alias("least")).select(F.col("least.key").alias("__key")))
    left = keyed.join(first, "__key", "left_semi").drop("__key")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return left.withColumn("__row", F.row_number().over(same)).where((F.col("doc_id").isNull() & F.col("text").isNull()) | (F.col("__row") == 1)).drop("__row")


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms of their format; ``n_chars`` follows the text."""
    out = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY, check_cards=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    import public_tokenizers
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_overlaps),
    ("PII", replace_personal_values),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express language profiles, the trie's result over whole tables, tokenizers or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = os.path.join(checkpoint_dir(spark), "pipeline", f"{i}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
