"""A corpus pipeline: toxic documents go, then exact copies, then near copies; the rest is packed into training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftline.llm import exact_dedup, packing, simhash, toxicity
from driftline.sources.shared import remove, shared_folder


#: Rows of a batch that goes between the JVM and Python. Spark's 10,000 documents take tens of MB on either side and on the way.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size, for all stages alike: executors keep the memory that a stage before has touched."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from this table's labels, scores under 0.5.

    Null and empty texts stay, as nothing in them matches; repeated rows get one score and go or stay together; a row
    without an id is scored but not learned from. Without labels nothing goes. An empty table stays empty.
    """
    _small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space the longest one, then that of the smallest id.

    Null and empty texts are equal. Rows without an id come last; of wholly equal rows one stays. An empty table stays empty.
    """
    _small_batches(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHashes are linked, over others too, the one of the smallest id.

    Null and empty texts have one fingerprint. Rows without an id come last; of equal rows one stays. An empty table
    stays empty.
    """
    _small_batches(spark)
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    A null or empty text is one piece, its end; repeated rows get places of their own. An empty table gives no place.
    """
    _small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), text_bytes=PACKED_BYTES, cached=PACKED_WORDS)


#: Text that packing works on at once, in bytes: less than by itself, as executors still hold memory of the stages before.
PACKED_BYTES = 2 << 20
#: Words whose ids each Python worker keeps, for the same reason.
PACKED_WORDS = 50_000

STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash_near_dedup", drop_near_copies), ("best_fit_packing", pack)]

#: SQL can express neither the lexicon nor the fingerprints; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again, and removed once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if written:
            remove(spark, written)
        written = folder
    return docs
