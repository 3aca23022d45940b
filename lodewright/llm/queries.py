"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.llm import ann, fingerprint, langid, mixing, ngram_join, packing, pii, quality, sharding, toxicity
from lodewright.llm.text import held_out
from lodewright.storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The shards that documents are dealt to.
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = ann.build_index(vectors, "vec_id", "embedding", 20)
    return ann.search_index(index, vectors.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", 20)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    stats = materialize(quality.features(table(spark, sf_dir, "documents").select("doc_id", "text")), "quality-stats")
    forest = quality.fit(stats, table(spark, sf_dir, "labels"), "quality", ~held_out("doc_id", 5, 0))
    scored = quality.score(stats, forest)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its entities replaced by surrogates."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark), counted="entities")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and fate of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    learned = langid.train(docs, ~held_out("doc_id", 4, 2))
    found = langid.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, copies and links of every document."""
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out("doc_id", 5, 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nearest_neighbours, op2_document_fingerprints, op3_best_fit_packing, op4_quality_classifier, op5_pii, op6_sharding, op7_source_mixing, op8_language_id, op9_ngram_jaccard_join, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    """Placement by a given lookup table can be said in SQL (two hexadecimal digits a slot); how the table is filled is tested by brute force."""
    table = "".join(f"{shard:02x}" for shard in sharding.lookup_table(SHARDS))
    slot = f"(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {sharding.SLOTS})"
    return {"op6_sharding": f"SELECT doc_id, {slot}::INT AS slot, ('0x' || substr('{table}', {slot} * 2 + 1, 2))::INT AS shard FROM documents"}
