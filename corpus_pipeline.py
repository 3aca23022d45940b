"""A corpus pipeline: language ID, near duplicates, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs; all but the last return the columns of documents.

Defined cases: rows without text, and empty and letterless ones, go with the first stage;
rows are told apart by doc_id and text together, so a null or repeated doc_id loses no
document; of repeated rows one stays; other columns pass through all stages but the last;
an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.llm import langid, mixing, ngram_join, packing, pii
from lodewright.llm.text import held_out
from lodewright.storage import materialize, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found and not rejected, with the language found."""
    found = langid.identify(docs, langid.train(docs, ~held_out("doc_id", 4, 2)))
    return found.filter("NOT rejected").select(*(F.col("lang_pred").alias("lang") if c == "lang" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group that the n-gram join links."""
    return ngram_join.first_of_each(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of entities; n_chars follows the text."""
    found = pii.pseudonymise(docs, pii.session_key(spark))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated sample keeps."""
    return mixing.sample(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", surrogates),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Compression, min-hashing, keyed surrogates and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has written besides its result is deleted with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = kept(materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
